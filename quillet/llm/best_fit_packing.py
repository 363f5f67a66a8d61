"""Best-fit packing (operator 11): documents into token sequences of a fixed length, reduced by Martello-Toth dominance.

Documents become token ids and an end id; only longer ones than a sequence are cut. Packing depends on the pieces' lengths
alone, so the instance is the number of pieces of each length: ``max_len`` numbers, whatever the number of documents.

Reduction: a set F of pieces that holds piece j dominates the other sets with j if each of them can be cut into groups that
fit one by one into the pieces of F; then some best packing has F as a sequence and F is fixed for good. For j from the
longest on, with room R beside it, a is the longest piece that fits and b the longest that fits beside both:

- nothing fits: {j}; a fills R, or only one more piece fits: {j, a};
- two more at most: {j, a} if a is at least as long as every pair that fits, else {j, a, b} if no two pieces longer than b fit.

The step is repeated until no piece is fixed; equal lengths are fixed together. What is left is packed by best fit in falling
length: a piece goes into the fullest sequence that holds it. Equal sequences are one entry with a number of times, so the
whole plan is a few thousand rows at most and is worked out on the driver in exact integers. ``lower_bound`` tells how many
sequences any packing needs.

Tokens: where the tokenizer splits bytes by a pattern (no normaliser, no added space), a text is cut before white space that
follows a printable ASCII character or a Latin-1 letter, and before a common mark that follows a letter: a token always begins
there. Every different cut of a batch is encoded once and kept.

Scale: one pass tokenises and numbers the pieces of each (task, length); their counts are summed to ``max_len`` numbers for the
driver; a join of narrow rows on (task, length) turns them into places, which a broadcast plan of bounded size turns into
sequences. Texts and ids are not shuffled.

Defined cases: a null or empty text is one piece with the end id alone; very long texts are cut, a batch of their own; rows
that repeat an id or a text are documents of their own; among pieces of equal length any order is as good, the order of
tasks and rows is taken; an empty table gives an empty result; columns other than the id are not kept, whatever their names.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, small_batches
from .text import _SPACE, slices

BATCH_BYTES = 1 << 20
#: 1 white space, 2 other printable ASCII, 3 ASCII letters, 0 all else; marks that are no part of a special token or contraction.
_KIND = np.where(_SPACE, 1, 0).astype(np.uint8)
_KIND[0x21:0x7F] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 3
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ",.;:!?)\""]] = True
CACHED_IDS, CACHED_CUTS = 4_000_000, 600_000


class Encoder:
    """Token ids of texts by a ``tokenizers`` definition (its JSON text)."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads would each keep memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        parsed = json.loads(definition)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)  # a byte-level token has one character for each byte
        split = parsed.get("pre_tokenizer") or {}
        self.cuts = parsed.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space", True) and split.get("use_regex", True)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in texts], add_special_tokens=False)]

    def _learn(self, fresh: list[bytes]) -> None:
        """Encode cuts. Those with white space before and a sure end behind are encoded as one text, and parted by the tokens' widths."""
        sure = [x for x in fresh if _SPACE[x[0]] and _KIND[x[-1]] >= 2] if self.cuts else []
        rest = [x for x in fresh if not (_SPACE[x[0]] and _KIND[x[-1]] >= 2)] if self.cuts else fresh
        ids, sizes = [], []
        if sure:
            found = self._encoded([b"".join(sure)])[0]
            ends = np.searchsorted(np.cumsum(self.width[found]), np.cumsum([len(x) for x in sure])) + 1
            ids.append(found)
            sizes.append(np.diff(ends, prepend=0))
        if rest:
            found = self._encoded(rest)
            ids += found
            sizes.append(np.array([len(x) for x in found], np.int64))
        size = np.concatenate(sizes)
        end = self.used + int(size.sum())
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(end, np.uint32)])
        self.ids[self.used : end] = np.concatenate(ids)
        self.start = np.concatenate([self.start, self.used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.known.update(zip(sure + rest, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        self.used = end

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text with a closing entry)."""
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
        edge = offsets - offsets[0]
        begins = np.zeros(len(data) + 1, bool)
        if self.cuts and len(data) > 2:
            kind, before = _KIND[data], data[1:-1]
            latin = (data[:-2] == 0xC3) & (before != 0x97) & (before != 0xB7)  # two signs among the letters
            letter = (kind[1:-1] == 3) | latin
            begins[2:-1] = (kind[2:] == 1) & ((kind[1:-1] >= 2) | latin) | (kind[2:] == 2) & letter & _MARK[data[2:]]
        begins[edge] = True
        begins[-1] = False
        at = np.flatnonzero(begins)
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        bounds = np.append(at, len(data))
        cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        words = cut.dictionary.to_pylist()
        if self.used > CACHED_IDS or len(self.known) > CACHED_CUTS:
            self._clear()
        fresh = [x for x in words if x not in self.known]
        if fresh:
            self._learn(fresh)
        code = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[np.asarray(cut.indices)]
        sizes = self.size[code]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.start[code] - ends[:-1], sizes)]
        return ids, ends[np.searchsorted(at, edge)]


def dominating(counts: np.ndarray, j: int, capacity: int) -> tuple[int, ...] | None:
    """Lengths that, beside a piece of length ``j``, make a set that dominates all others with it; None if none is proven."""
    room, own = capacity - j, counts.copy()
    own[j] -= 1
    lengths = np.flatnonzero(own)
    fits = lengths[lengths <= room]
    if not len(fits):
        return ()
    a = int(fits[-1])
    small = np.repeat(lengths[:3], np.minimum(own[lengths[:3]], 3))[:3]
    most = int(np.count_nonzero(np.cumsum(small) <= room))
    if a == room or most == 1:
        return (a,)
    if most > 2:
        return None
    # the longest pair: for each length the longest beside it (itself only if there are two)
    own_fits = fits[np.searchsorted(fits, room - fits, side="right") > 0]
    mates = fits[np.searchsorted(fits, room - own_fits, side="right") - 1]
    single = (mates == own_fits) & (own[own_fits] < 2)
    down = np.searchsorted(fits, own_fits) - 1
    mates = np.where(single, np.where(down >= 0, fits[np.maximum(down, 0)], -capacity), mates)
    if a >= int((own_fits + mates).max(initial=0)):
        return (a,)
    own[a] -= 1
    rest = np.flatnonzero(own[: room - a + 1])
    if not len(rest):
        return None
    b = int(rest[-1])
    own[a] += 1
    longer = np.flatnonzero(own[b + 1 :])[:2] + b + 1
    two = np.repeat(longer, np.minimum(own[longer], 2))[:2]
    return (a, b) if len(two) < 2 or int(two.sum()) > room else None


def reduce_by_dominance(counts: Sequence[int], capacity: int) -> tuple[list[tuple[int, tuple[int, ...]]], np.ndarray]:
    """([(times, lengths)], counts left): sequences that some best packing has, and the pieces that stay open."""
    left, fixed, changed = np.array(counts, np.int64), [], True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while left[j] and (beside := dominating(left, j, capacity)) is not None:
                need = Counter((j, *beside))
                times = min(int(left[x]) // n for x, n in need.items())
                for x, n in need.items():
                    left[x] -= times * n
                fixed.append((times, (j, *beside)))
                changed = True
    return fixed, left


def best_fit(counts: Sequence[int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """[(times, lengths)] by best fit in falling length: each piece goes into the fullest sequence with room for it."""
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def put(times: int, held: tuple[int, ...], room: int, length: int, n: int) -> None:
        open_.setdefault(room - n * length, []).append((times, held + (length,) * n))

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        for room in sorted(r for r in open_ if r >= length) if left else ():
            each, stay = room // length, []
            for times, held in open_.pop(room):
                full = min(times, left // each)
                left -= full * each
                times -= full
                if full:
                    put(full, held, room, length, each)
                if times and 0 < left < each:
                    put(1, held, room, length, left)
                    times, left = times - 1, 0
                if times:
                    stay.append((times, held))
            if stay:
                open_.setdefault(room, []).extend(stay)
            if not left:
                break
        if left:
            each = capacity // length
            if left >= each:
                put(left // each, (), capacity, length, each)
            if left % each:
                put(1, (), capacity, length, left % each)
    return [g for groups in open_.values() for g in groups]


def lower_bound(counts: Sequence[int], capacity: int) -> int:
    """Sequences that any packing needs: for every t, pieces over capacity - t are alone, those over half a sequence are apart,
    and pieces of t or more fill at most the room that these leave."""
    n, best = np.array(counts, dtype=object), 0
    size = np.arange(capacity + 1)
    for t in range(capacity // 2 + 1):
        alone, half = int(n[size > capacity - t].sum()), (size > capacity // 2) & (size <= capacity - t)
        mid = (size >= t) & (size <= capacity // 2)
        apart = int(n[half].sum())
        over = int((n * size)[mid].sum()) - (apart * capacity - int((n * size)[half].sum()))
        best = max(best, alone + apart + max(0, -(-over // capacity)))
    return best


def packing_plan(counts: Sequence[int], capacity: int) -> tuple[np.ndarray, int]:
    """(rows, number of sequences). A row (length, rank, each, sequence, offset) says that pieces of the length from the
    rank on go, ``each`` in a row, into the sequences from ``sequence`` on, at ``offset``."""
    fixed, left = reduce_by_dominance(counts, capacity)
    used, rows, at = Counter(), [], 0
    for times, lengths in fixed + best_fit(left, capacity):
        offset = 0
        for length, n in sorted(Counter(lengths).items(), reverse=True):
            rows.append((length, used[length], n, at, offset))
            used[length] += times * n
            offset += length * n
        at += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5), at


def pieces_of(docs: DataFrame, tokenizer_json: str, id_col: str, text_col: str, max_len: int, end_id: int, keep_ids: bool) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, slot[, ids]): all pieces, numbered inside each (task, length)."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    names = ["_id", "piece", "start", "length", "ids_crc32", "part", "slot", *(["ids"] if keep_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = Encoder(shared.value), TaskContext.get().partitionId(), np.zeros(max_len + 1, np.int64)
        for whole in batches:
            for b in slices(whole, "_text", BATCH_BYTES):
                ids, first = encoder.encode(b.column(1))
                n = np.diff(first) + 1
                ends = np.cumsum(n)
                closed = np.full(int(ends[-1]), end_id, "<u4")
                inside = np.ones(len(closed), bool)
                inside[ends - 1] = False
                closed[inside] = ids
                pieces = -(-n // max_len)
                row = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = n - (pieces - 1) * max_len
                start = np.where(piece > 0, head[row] + (piece - 1) * max_len, 0)
                length = np.where(piece > 0, max_len, head[row])
                at = (ends - n)[row] + start
                raw = memoryview(closed).cast("B")
                crc = [zlib.crc32(raw[4 * i : 4 * (i + m)]) for i, m in zip(at.tolist(), length.tolist(), strict=True)]
                by = np.argsort(length, kind="stable")
                kinds, starts, sizes = np.unique(length[by], return_index=True, return_counts=True)
                slot = np.empty(len(row), np.int64)
                slot[by] = np.arange(len(row)) - np.repeat(starts - seen[kinds], sizes)
                seen[kinds] += sizes
                columns = [b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), part), pa.int32()), pa.array(slot)]
                if keep_ids:
                    edges = np.append(at, len(closed)).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(closed.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    d = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    schema = f"_id {d.schema['_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, slot long" + (", ids array<int>" if keep_ids else "")
    return d.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): where each piece of each document lies. ``start``: the
    document's ids before the piece; ``keep_ids`` adds the ids. ``tokenizer_json``: the definition, as text."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = saved(pieces_of(docs, tokenizer_json, id_col, text_col, max_len, end_id, keep_ids))
    own = saved(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = [0] * (max_len + 1)
    for r in own.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most max_len rows
        counts[r["length"]] = r["n"]
    plan, _ = packing_plan(counts, max_len)
    shared = spark.sparkContext.broadcast(plan)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(own.select("part", "length", before.alias("before")), ["part", "length"]).withColumn("rank", F.col("before") + F.col("slot"))
    ranked = ranked.select("_id", "piece", "start", "length", "ids_crc32", "rank", *(["ids"] if keep_ids else []))
    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if keep_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        head = np.searchsorted(rows[:, 0], np.arange(max_len + 2))
        key = rows[:, 0] * (1 << 52) + rows[:, 1]
        for b in batches:
            length, rank = np.asarray(b.column(3)), np.asarray(b.column(5))
            at = np.maximum(np.searchsorted(key, length * (1 << 52) + rank, side="right") - 1, head[length])
            _, first, each, sequence, offset = rows[at].T
            place_in = rank - first
            columns = [*b.columns[:5], pa.array(sequence + place_in // each), pa.array(offset + place_in % each * length), *b.columns[6:]]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = ranked.schema["_id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids array<int>" if keep_ids else "")
    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the training sequences of a packing with ids; a sequence is one group of at most ``max_len`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op11_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), definition)


SQL: dict[str, str] = {}
QUERIES = {"op11_best_fit_packing": op11_best_fit_packing}
