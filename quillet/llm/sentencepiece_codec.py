"""SentencePiece encoding and decoding (operator 3): unigram Viterbi over a double-array trie.

The vocabulary file's pieces and scores are used as they are; nothing is trained. The Viterbi path has the largest sum of
scores: the most probable segmentation where scores are log-probabilities, as in a unigram vocabulary. The default file is
a merge vocabulary, the only piece file at hand: its scores are negative merge ranks, so its path has the smallest sum of
ranks, in double precision. Another file is a parameter. A text is encoded as the
format defines it: a whitespace mark before the text, spaces as marks, the path of pieces with the highest sum of
scores (the earlier start wins a tie), and bytes for characters that no piece covers. Decoding joins the pieces,
turns byte pieces into bytes and marks into spaces, and drops the first mark.

No piece has a mark after another character (checked when the vocabulary is loaded), so the best path never crosses
the beginning of a run of spaces and each piece of text from one run to the next is solved on its own. A block of
texts is cut into such chunks, every different chunk is solved once, and all chunks of a block advance through the
trie together as numpy arrays.

Scale: one pass without a shuffle; the broadcast trie has a size fixed by the vocabulary file.

Defined cases: a null text gives null ids and counts as empty; an empty text has no pieces; a text's own U+2581
characters decode as spaces, as the format has it; of paths with equal sums the one with the earlier start wins; repeated
rows get repeated results; an empty table gives an empty result; columns named as a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, without
from .text import _powers, mix, slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
SHORT = 64
TRY = 1024
RESULT = ["ids", "n_pieces", "n_byte_pieces", "round_trip"]


@dataclass
class Vocabulary:
    """Piece bytes (marks as spaces), scores, and a double-array trie over them.

    ``base[s] + byte`` is the state after ``byte`` if ``check`` names ``s`` there; ``value`` is the id of the piece that
    ends in a state, -1 for none. ``byte_ids``: the id of each byte piece.
    """

    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    unknown: float
    flat: np.ndarray
    offset: np.ndarray


def double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Double-array trie of ``words`` (bytes to id)."""
    children: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    for w, i in words.items():
        node = 0
        for b in w:
            nxt = children[node].get(b)
            if nxt is None:
                nxt = len(children)
                children[node][b] = nxt
                children.append({})
                ends.append(-1)
            node = nxt
        ends[node] = i
    size = len(children) * 2 + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    free = np.ones(size, bool)
    free[0] = False
    value[0] = ends[0]
    low, queue = 1, [(0, 0)]
    for node, state in queue:
        kids = children[node]
        if not kids:
            continue
        codes = np.array(sorted(kids))
        start = max(1, low - int(codes[0]))
        while True:
            if start + TRY + 256 >= size:
                size *= 2
                base, check, value = (np.concatenate([x, np.full(size - len(x), f, np.int32)]) for x, f in ((base, 0), (check, -1), (value, -1)))
                free = np.concatenate([free, np.ones(size - len(free), bool)])
            fits = free[start + codes[0] : start + codes[0] + TRY].copy()
            for c in codes[1:].tolist():
                fits &= free[start + c : start + c + TRY]
            if fits.any():
                at = start + int(np.argmax(fits))
                break
            start += TRY
        base[state] = at
        for c in codes.tolist():
            free[at + c] = False
            check[at + c] = state
            value[at + c] = ends[kids[c]]
            queue.append((kids[c], at + c))
        while low < size and not free[low]:
            low += 1
        if len(codes) > 1:
            low = max(low, at - 4096)
    return base, check, value


def load_vocabulary(path: str) -> Vocabulary:
    """Read a SentencePiece vocabulary file (on the driver)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores, byte_ids, words = [], [], np.full(256, -1), {}
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        scores.append(model.get_score(i))
        if model.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            pieces.append(bytes([int(p[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            pieces.append(b"")
        else:
            raw = p.replace(MARK, " ").encode()
            if b" " in raw.lstrip(b" ") or b"\n" in raw:
                raise ValueError(f"piece {p!r} goes on after a mark or holds a line end")
            pieces.append(raw)
            words[raw] = i
    if (byte_ids < 0).any():
        raise ValueError("the vocabulary has no byte fallback")
    score = np.array(scores, np.float64)
    base, check, value = double_array(words)
    offset = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    return Vocabulary(pieces, score, byte_ids, base, check, value, float(score[list(words.values())].min()) - UNKNOWN_PENALTY, np.frombuffer(b"".join(pieces), np.uint8), offset)


def char_size(first: np.ndarray) -> np.ndarray:
    """Bytes of the UTF-8 character that begins with each byte."""
    return 1 + (first >= 0xC0).astype(np.int64) + (first >= 0xE0) + (first >= 0xF0)


def viterbi_long(v: Vocabulary, chunk: np.ndarray) -> list[int]:
    """Best path of one long chunk, position by position."""
    n = len(chunk)
    data = chunk.tolist()
    best, back = [-np.inf] * (n + 1), [(-1, -1)] * (n + 1)
    best[0] = 0.0
    size = char_size(chunk).tolist()
    for s in range(n):
        if best[s] == -np.inf or 0x80 <= data[s] < 0xC0:
            continue
        state, single = 0, False
        for e in range(s, n):
            nxt = int(v.base[state]) + data[e]
            if v.check[nxt] != state or (state == 0 and v.base[0] == 0):
                break
            state = nxt
            i = int(v.value[state])
            if i >= 0:
                single |= e + 1 - s == size[s]
                if best[s] + v.scores[i] > best[e + 1]:
                    best[e + 1], back[e + 1] = best[s] + v.scores[i], (s, i)
        end = min(s + size[s], n)
        if not single and best[s] + v.unknown > best[end]:
            best[end], back[end] = best[s] + v.unknown, (s, -1)
    out, e = [], n
    while e > 0:
        s, i = back[e]
        out += [i] if i >= 0 else [int(v.byte_ids[data[k]]) for k in range(e - 1, s - 1, -1)]
        e = s
    return out[::-1]


def viterbi(v: Vocabulary, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best paths of many chunks: all ids in order, and the number of ids of each chunk."""
    n = len(start)
    short = np.flatnonzero(size <= SHORT)
    first = np.concatenate([[0], np.cumsum(size[short] + 1)])  # a chunk's nodes: one before each byte, one at its end
    best = np.full(int(first[-1]), -np.inf)
    back = np.full(int(first[-1]), -1, np.int32)
    piece = np.full(int(first[-1]), -1, np.int32)
    best[first[:-1]] = 0
    lens, begin = size[short], start[short]
    live = np.arange(len(short))
    for s in range(int(lens.max()) if len(short) else 0):
        live = live[lens[live] > s]
        head = data[begin[live] + s]
        w = live[(head < 0x80) | (head >= 0xC0)]
        w = w[best[first[w] + s] > -np.inf]
        own, state, single = best[first[w] + s], np.zeros(len(w), np.int64), np.zeros(len(w), bool)
        chars = char_size(data[begin[w] + s])
        act = np.arange(len(w))
        for e in range(s, SHORT):
            act = act[lens[w[act]] > e]
            if not len(act):
                break
            nxt = v.base[state[act]].astype(np.int64) + data[begin[w[act]] + e]
            ok = v.check[nxt] == state[act]
            act, nxt = act[ok], nxt[ok]
            state[act] = nxt
            ends = v.value[nxt]
            hit = ends >= 0
            a, i = act[hit], ends[hit]
            single[a] |= e + 1 - s == chars[a]
            node, score = first[w[a]] + e + 1, own[a] + v.scores[i]
            better = score > best[node]
            node = node[better]
            best[node], back[node], piece[node] = score[better], s, i[better]
        a = np.flatnonzero(~single)
        if len(a):
            node, score = first[w[a]] + np.minimum(s + chars[a], lens[w[a]]), own[a] + v.unknown
            better = score > best[node]
            node = node[better]
            best[node], back[node], piece[node] = score[better], s, -1
    # walk all paths back together
    word, pos, ids = [], [], []
    w, e = np.arange(len(short)), lens.copy()
    while len(w):
        node = first[w] + e
        s, i = back[node].astype(np.int64), piece[node]
        known = i >= 0
        word.append(w[known]), pos.append(s[known]), ids.append(i[known])
        for k in range(4):
            u = np.flatnonzero(~known & (s + k < e))
            word.append(w[u]), pos.append(s[u] + k), ids.append(v.byte_ids[data[begin[w[u]] + s[u] + k]])
        more = s > 0
        w, e = w[more], s[more]
    word, pos, ids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (word, pos, ids))
    word = short[word] if len(word) else word
    for k in np.flatnonzero(size > SHORT):
        path = viterbi_long(v, data[start[k] : start[k] + size[k]])
        word = np.concatenate([word, np.full(len(path), k)])
        pos = np.concatenate([pos, np.arange(len(path))])
        ids = np.concatenate([ids, path])
    order = np.lexsort((pos, word))
    return ids[order].astype(np.int32), np.bincount(word.astype(np.int64), minlength=n)


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices first[0], first[0]+1, ... of each run in turn."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def encode(v: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order, and the number of ids of each text."""
    data, row_end = marked(texts)
    n = len(row_end)
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    space, line = data == 0x20, data == 0x0A
    cut = np.ones(len(data), bool)
    cut[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    begins = np.concatenate([[0], row_end[:-1]])
    cut[begins[begins < row_end]] = True
    start = np.flatnonzero(cut)
    size = np.diff(np.concatenate([start, [len(data)]]))
    up, down = _powers(1 << max(20, len(data).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    _, one, inv = np.unique(mix((total[start + size] - total[start]) * down[start]), return_index=True, return_inverse=True)
    ids, count = viterbi(v, data, start[one], size[one])
    first = np.cumsum(count) - count
    row = np.searchsorted(row_end, start, side="right")
    per = np.bincount(row, weights=count[inv], minlength=n).astype(np.int64)
    return ids[ragged(first[inv], count[inv])], per


def marked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with the first mark (as a space) before each text that isn't empty; the end of each text."""
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARK, " ")
    size = np.asarray(pc.binary_length(texts), dtype=np.int64)
    texts = pc.if_else(pa.array(size > 0), pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())), texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def decode(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """Bytes of all ids in a row, marks as spaces, first marks kept."""
    size = np.diff(v.offset)[ids]
    return v.flat[ragged(v.offset[ids], size)]


def decode_texts(v: Vocabulary, lists: list[list[int] | None]) -> list[str | None]:
    """Texts of id lists; broken UTF-8 from byte pieces becomes U+FFFD."""
    out = []
    for ids in lists:
        raw = None if ids is None else decode(v, np.asarray(ids, np.int64)).tobytes()
        out.append(None if raw is None else raw[raw[:1] == b" " :].decode("utf-8", "replace"))
    return out


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def encode_documents(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """Documents with ``ids``, ``n_pieces``, ``n_byte_pieces`` and ``round_trip`` (decoding the ids gives the text)."""
    small_batches(docs.sparkSession)
    base = without(docs, RESULT)
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path or default_path()))
    names = base.columns
    at = names.index(text_col)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        is_byte = np.zeros(len(v.scores), bool)
        is_byte[v.byte_ids] = True
        for batch in batches:
            for b in slices(batch, names[at], 1 << 20):
                texts = b.column(at)
                ids, per = encode(v, texts)
                edge = np.concatenate([[0], np.cumsum(per)])
                row = np.repeat(np.arange(len(per)), per)
                n_bytes = np.bincount(row, weights=is_byte[ids], minlength=len(per)).astype(np.int64)
                size = np.diff(v.offset)[ids]
                got, end = decode(v, ids), np.cumsum(np.bincount(row, weights=size, minlength=len(per)).astype(np.int64))
                data, want_end = marked(texts)
                same = np.zeros(len(per), bool)
                for i in range(len(per)):
                    a, c = (end[i - 1], want_end[i - 1]) if i else (0, 0)
                    same[i] = end[i] - a == want_end[i] - c and bool((got[a : end[i]] == data[c : want_end[i]]).all())
                same &= ~np.asarray(pc.fill_null(pc.match_substring(texts, MARK), False), bool)
                null = pc.is_null(texts)
                lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids))
                lists = pc.if_else(null, pa.scalar(None, lists.type), lists)
                yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(per), pa.array(n_bytes), pa.array(same)], [*names, *RESULT])

    extra = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("n_byte_pieces", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    return base.mapInArrow(coded, T.StructType([*base.schema.fields, *extra]))


def decode_documents(coded: DataFrame, path: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Rows with ``out_col``, the text of their ids."""
    small_batches(coded.sparkSession)
    base = without(coded, [out_col])
    shared = coded.sparkSession.sparkContext.broadcast(load_vocabulary(path or default_path()))
    names = base.columns
    at = names.index(ids_col)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(decode_texts(shared.value, b.column(at).to_pylist()), pa.string())], [*names, out_col])

    return base.mapInArrow(texts, T.StructType([*base.schema.fields, T.StructField(out_col, T.StringType())]))


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs).select("doc_id", *RESULT)


QUERIES = {"op3_sentencepiece": op3_sentencepiece}
SQL: dict[str, str] = {}
