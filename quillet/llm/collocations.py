"""Phrase collocation mining (operator 13): Apriori-safe candidates counted by double-array tries over all text positions.

Texts are lower-cased (A-Z), cut at marks and line ends into pieces and at blanks into words; counts are per language.

1. Words are counted; those with ``min_count`` occurrences are frequent.
2. Level by level, phrases of n words whose two parts of n - 1 words are frequent (Apriori) are counted by hash; hashes with
   ``min_count`` occurrences are safe. The test for the level before is a bitmap of a fixed size, which lets some more pass, never less.
3. One pass lists the texts of safe hashes, the candidates. Counting has found, for each hash, the smallest hash of a text that
   holds it; only that text (and a copy of it in another task) lists the phrase, told by a bitmap of such pairs. No phrase with
   ``min_count`` occurrences is missing.
4. Candidates are numbered and taken in shards of at most ``SHARD`` phrases. A shard becomes a double-array trie (built in a task): the first
   word's state is its code, each further word is three bytes of its code. The trie is broadcast, all positions of a batch of
   texts advance through it together, byte by byte, with numpy; accepting states are bincounted, and tasks' counts summed.
5. Spark joins the counts of parts, scores cuts in exact decimals, drops what longer candidates cover, and ranks.

Scale: each level shuffles a row of 20 bytes for each different safe hash of a task, not the texts. Bitmaps (16 MB) and tries
(``SHARD`` phrases) have a fixed size; candidates beyond one shard cost a pass over the texts for each shard. The parts' counts
are joined by their text; words with over 1 / 2^17 of all occurrences, at most 2^17 of them, are broadcast, so that no common
first word is a hot key.

Hashes are those of ``text`` (64 bits, with the language): two words of one shard share a code with a chance below 10^-6.

Defined cases: a null or empty text has no words; a null language is ``und``; very long texts are a batch of their own;
repeated rows count as often as they are there; equal scores go by count, then by the phrase's bytes; an empty table gives
an empty result; further columns of the table are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillet.functions.ranks import global_rank

from .common import saved, small_batches, small_side
from .periodic_runs import joined
from .text import _LOWER, Words, mix, slices

BATCH_BYTES = 1 << 21
BITS = 27
HELD = 4_000_000
SHARD = 1 << 20
HOT = 1 << 17
_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BREAK = _PIECE.copy()
_BREAK[[0x20, 0x09]] = True


class PieceWords(Words):
    """Words of texts with ``piece``, a number for each piece of each text, and ``key``, a hash of language and word."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        n = self.n_rows = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if n else np.zeros(0, np.uint8)
        ends = offsets - offsets[0]
        # a line end after each text keeps its last piece apart from the next text
        data = np.full(len(raw) + n, 0x0A, np.uint8)
        keep = np.ones(len(data), bool)
        keep[ends[1:] + np.arange(n)] = False
        data[keep] = raw
        self.data = _LOWER[data]
        gap = _BREAK[data]
        edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.doc = np.searchsorted(ends[1:] + np.arange(1, n + 1), self.start, side="right")
        self.piece = np.cumsum(_PIECE[data])[self.start]
        self.first = np.searchsorted(self.doc, np.arange(n + 1))
        kinds = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
        self.langs = kinds.dictionary
        self.lang = np.asarray(kinds.indices)[self.doc] if len(self.doc) else np.zeros(0, np.int64)
        seeds = np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs.to_pylist()], np.uint64)
        self.key = mix(self.hash ^ seeds[self.lang]) if len(self.lang) else np.zeros(0, np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.key, dtype=np.uint64)])
        whole = mix(total[self.first[1:]] - total[self.first[:-1]]) >> np.uint64(33)
        #: 31 bits of a hash of the text that holds each word
        self.text = whole[self.doc].astype(np.int64)

    def levels(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(hash, first word) of all phrases of one, two, .. n words inside pieces."""
        at, h = np.arange(len(self.key)), self.key
        yield h, at
        for k in range(1, n):
            inside = at + k < len(self.key)
            at, h = at[inside], h[inside]
            inside = self.piece[at + k] == self.piece[at]
            at, h = at[inside], h[inside]
            h = mix(h * np.uint64(3) + self.key[at + k])
            yield h, at


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[PieceWords]:
    for whole in batches:
        for b in slices(whole, "text", BATCH_BYTES):
            yield PieceWords(b.column(0), b.column(1))


def _place(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """2^BITS bits with those of all hashes (``h``) set; it reaches the driver as at most 2^(BITS - 6) words."""
    at = F.shiftrightunsigned("h", 64 - BITS)
    words = hashes.groupBy(F.shiftrightunsigned(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(shiftrightunsigned(h, {64 - BITS}) & 63))")).alias("b")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[np.asarray(words.column("w"))] = np.asarray(words.column("b")).view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _place(h)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def count_words(texts: DataFrame) -> DataFrame:
    """(lang, phrase, h, f): words and their numbers of occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in batches_of(batches):
            h, at, n = np.unique(w.key, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([w.langs.take(pa.array(w.lang[at])), joined(w, at, np.arange(len(at)), len(at)), pa.array(h.view(np.int64)), pa.array(n)], ["lang", "phrase", "h", "f"])

    d = texts.mapInArrow(run, "lang string, phrase string, h long, f long")
    return d.groupBy("lang", "phrase", "h").agg(F.sum("f").alias("f"))


def summed(h: np.ndarray, f: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different hashes, the sums of their counts, the smallest of their texts."""
    by = np.argsort(h, kind="stable")
    h = h[by]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
    if not len(start):
        return h, f[by], text[by]
    return h[start], np.add.reduceat(f[by], start), np.minimum.reduceat(text[by], start)


def safe_hashes(texts: DataFrame, below: np.ndarray, n: int, min_count: int) -> DataFrame:
    """(h, text) of phrases of ``n`` words, both parts of n - 1 words in the bitmap ``below``, that occur ``min_count`` times;
    ``text`` is the smallest hash of a text that holds one."""
    shared = texts.sparkSession.sparkContext.broadcast(below)

    def packed(h: np.ndarray, f: np.ndarray, text: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(f), pa.array(text.astype(np.int32))], ["h", "f", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, parts, held = shared.value, [], 0
        for w in batches_of(batches):
            *_, (low, low_at), (h, at) = w.levels(n)
            ok = np.zeros(len(w.key) + 1, bool)
            ok[low_at] = in_bitmap(bits, low)
            own = ok[at] & ok[at + 1]
            parts.append(summed(h[own], np.ones(int(own.sum()), np.int64), w.text[at[own]]))
            held += len(parts[-1][0])
            if held > HELD:
                parts = [summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
                held = len(parts[0][0])
                if held > HELD // 2:
                    yield packed(*parts[0])
                    parts, held = [], 0
        if parts:
            yield packed(*summed(*(np.concatenate(x) for x in zip(*parts, strict=True))))

    d = texts.mapInArrow(run, "h long, f long, text int")
    return d.groupBy("h").agg(F.sum("f").alias("f"), F.min("text").alias("text")).where(F.col("f") >= min_count).select("h", "text")


def _pair(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    return mix(h ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def pairs_of(safe: DataFrame) -> DataFrame:
    """(h): a hash of each safe hash and the text that lists it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_pair(np.asarray(b.column(0)).view(np.uint64), np.asarray(b.column(1))).view(np.int64))], ["h"])

    return safe.select("h", "text").mapInArrow(run, "h long")


def list_phrases(texts: DataFrame, bits: list[np.ndarray]) -> DataFrame:
    """(lang, phrase, h): phrases of two words and more that their text is to list, by their level's bitmap of pairs; a task
    lists each hash once."""
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = shared.value
        seen = [np.zeros(0, np.uint64) for _ in maps]
        for w in batches_of(batches):
            for k, (h, at) in enumerate(w.levels(len(maps) + 1)):
                if not k:
                    continue
                ok = in_bitmap(maps[k - 1], _pair(h, w.text[at]))
                own, first = np.unique(h[ok], return_index=True)
                known = seen[k - 1]
                fresh = np.ones(len(own), bool) if not len(known) else known[np.minimum(np.searchsorted(known, own), len(known) - 1)] != own
                own, at = own[fresh], at[ok][first[fresh]]
                if not len(own):
                    continue
                seen[k - 1] = np.sort(np.concatenate([known, own])) if len(known) < HELD else own
                pick = (at[:, None] + np.arange(k + 1)).ravel()
                yield pa.RecordBatch.from_arrays([w.langs.take(pa.array(w.lang[at])), joined(w, pick, np.repeat(np.arange(len(at)), k + 1), len(at)), pa.array(own.view(np.int64))], ["lang", "phrase", "h"])

    return texts.mapInArrow(run, "lang string, phrase string, h long").distinct()


@dataclass
class Trie:
    """Double-array trie of phrases: ``codes`` are the sorted keys of their words; a first word's state is its place there.
    The state after a byte is ``base[state] + byte`` if ``check`` names the state there; ``value``: the phrase that ends in it, or -1."""

    codes: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    n: int


def build_trie(langs: pa.Array, phrases: pa.Array) -> Trie:
    """Trie of different phrases, in numpy: nodes level by level, then places for the children of each node, many children first."""
    w = PieceWords(phrases, langs)
    codes, code = np.unique(w.key, return_inverse=True)
    first, n_words = w.first[:-1], w.counts()
    root = max(len(codes), 256)
    node, n_nodes, edges = code[first].astype(np.int64), root, []
    for k in range(1, int(n_words.max(initial=1))):
        for shift in (16, 8, 0):
            own = np.flatnonzero(n_words > k)
            byte = (code[first[own] + k] >> shift) & 255
            key, child = np.unique(node[own] * 256 + byte, return_inverse=True)
            node = node.copy()
            node[own] = n_nodes + child
            edges.append((key >> 8, key & 255, n_nodes + np.arange(len(key))))
            n_nodes += len(key)
    parent, byte, child = (np.concatenate(x) for x in zip(*edges, strict=True)) if edges else (np.zeros(0, np.int64),) * 3
    by = np.argsort(parent, kind="stable")
    parent, byte, child = parent[by], byte[by], child[by]
    owner, start, size = np.unique(parent, return_index=True, return_counts=True)
    base = place_children(byte, start, size, root)
    of = np.repeat(np.arange(len(owner)), size)
    slot = np.arange(n_nodes)
    slot[child] = base[of] + byte
    total = int(slot.max(initial=root)) + 257
    trie = Trie(codes, np.zeros(total, np.int32), np.full(total, -1, np.int32), np.full(total, -1, np.int32), len(phrases))
    trie.base[slot[owner]] = base
    trie.check[slot[child]] = slot[parent]
    trie.value[slot[node]] = np.arange(len(phrases))
    return trie


def place_children(byte: np.ndarray, start: np.ndarray, size: np.ndarray, low: int) -> np.ndarray:
    """A base for each node so that no two children (base + byte) share a slot; slots from ``low`` on. Nodes of 64 children
    have a row of 256 slots; others try random places, all of one size at once, and nodes with one child fill what is free."""
    rng, base = np.random.default_rng(0), np.full(len(size), -1, np.int64)
    wide = np.flatnonzero(size >= 64)
    middle = int(size[(size > 1) & (size < 64)].sum())
    total = low + 256 * len(wide) + 3 * middle + int((size == 1).sum()) + 1024
    free = np.ones(total, bool)
    free[:low] = False
    base[wide] = low + 256 * np.arange(len(wide))
    span = lambda nodes: np.repeat(start[nodes] - np.cumsum(size[nodes]) + size[nodes], size[nodes]) + np.arange(size[nodes].sum())
    free[np.repeat(base[wide], size[wide]) + byte[span(wide)]] = False
    claim = np.full(total, -1, np.int64)
    for n in range(63, 1, -1):
        left = np.flatnonzero(size == n)
        codes = byte[start[left][:, None] + np.arange(n)]
        for _ in range(1000):
            if not len(left):
                break
            at = rng.integers(low, total - 256, len(left))
            slots = at[:, None] + codes
            fits = np.flatnonzero(free[slots].all(axis=1))
            claim[slots[fits]] = fits[:, None]
            won = fits[(claim[slots[fits]] == fits[:, None]).all(axis=1)]
            base[left[won]] = at[won]
            free[slots[won]] = False
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, codes = left[stay], codes[stay]
        if len(left):  # no luck: rows of their own behind the others
            base[left] = len(free) + 256 * np.arange(len(left))
            grown = np.ones(256 * len(left), bool)
            free, claim = np.concatenate([free, grown]), np.concatenate([claim, np.full(len(grown), -1)])
            free[base[left][:, None] + codes] = False
            total = len(free)
    one = np.flatnonzero(size == 1)
    base[one] = np.flatnonzero(free)[: len(one)] - byte[start[one]]
    return base


def count_shard(texts: DataFrame, trie: Trie, first_place: int) -> DataFrame:
    """(place, f): occurrences of the shard's phrases, each task's sum a row."""
    shared = texts.sparkSession.sparkContext.broadcast(trie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        total = np.zeros(t.n, np.int64)
        for w in batches_of(batches):
            if not len(w.key) or not t.n:
                continue
            code = np.searchsorted(t.codes, w.key)
            code[code == len(t.codes)] = 0
            code[t.codes[code] != w.key] = -1
            at = np.flatnonzero(code >= 0)
            state = code[at]
            k = 1
            while len(at):
                inside = at + k < len(code)
                at, state = at[inside], state[inside]
                inside = (w.piece[at + k] == w.piece[at]) & (code[at + k] >= 0)
                at, state = at[inside], state[inside]
                for shift in (16, 8, 0):
                    to = t.base[state] + ((code[at + k] >> shift) & 255)
                    ok = t.check[to] == state
                    at, state = at[ok], to[ok]
                found = t.value[state]
                total += np.bincount(found[found >= 0], minlength=t.n)
                k += 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen + first_place), pa.array(total[seen])], ["place", "f"])

    return texts.mapInArrow(run, "place long, f long")


def tries_of(placed: DataFrame, shard: int) -> DataFrame:
    """(shard, n, codes, base, check, value): the tries of all shards of ``placed`` (place, lang, phrase), a task each."""

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place").combine_chunks()
        t = build_trie(rows.column("lang").combine_chunks(), rows.column("phrase").combine_chunks())
        parts = [pa.array([x.tobytes()], pa.binary()) for x in (t.codes, t.base, t.check, t.value)]
        return pa.Table.from_arrays([rows.column("shard").slice(0, 1), pa.array([t.n], pa.int64()), *parts], ["shard", "n", "codes", "base", "check", "value"])

    d = placed.select(F.expr(f"place div {shard}").alias("shard"), "place", "lang", "phrase")
    return d.groupBy("shard").applyInArrow(build, "shard long, n long, codes binary, base binary, check binary, value binary")


def count_phrases(texts: DataFrame, candidates: DataFrame, shard: int) -> DataFrame:
    """Candidates (lang, phrase) with ``f``, counted shard by shard."""
    placed = saved(global_rank(saved(candidates), "lang", "phrase", name="place"))
    tries = saved(tries_of(placed, shard))
    counts = placed.select("place", F.lit(0).cast("long").alias("f")).limit(0)
    for i in range(-(-placed.count() // shard)):
        row = tries.where(F.col("shard") == i).toArrow().to_pylist()[0]  # at most ``shard`` phrases
        trie = Trie(np.frombuffer(row["codes"], np.uint64), *(np.frombuffer(row[c], np.int32) for c in ("base", "check", "value")), row["n"])
        own = count_shard(texts, trie, i * shard)
        counts = counts.union(saved(own.groupBy("place").agg(F.sum("f").alias("f"))))
    return placed.join(counts, "place").select("lang", "phrase", "f")


def _part(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, f) with a, l, r, n, score of their lowest cut. ``words``: (lang, phrase, f), ``totals``: (lang, n)."""
    size = F.size(F.split("phrase", " "))
    w = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", _part(w, F.lit(1), F.col("k")).alias("first"), _part(w, F.col("k") + 1, size).alias("rest"))
    every = words.select("lang", "phrase", "f").unionByName(phrases.select("lang", "phrase", "f"))
    total = words.agg(F.sum("f")).first()[0] or 0
    hot = saved(words.where(F.col("f") > total // HOT).select("lang", "phrase", "f"))  # at most HOT words
    for part, name in (("first", "l"), ("rest", "r")):
        near = F.broadcast(hot.select("lang", F.col("phrase").alias(part), F.col("f").alias("_hot")))
        cuts = cuts.join(near, ["lang", part], "left")
        key = F.when(F.col("_hot").isNull(), F.col(part)).otherwise(F.concat(F.lit("\0"), "phrase"))
        far = every.select("lang", F.col("phrase").alias("_key"), F.col("f").alias("_cold"))
        cuts = cuts.withColumn("_key", key).join(far, ["lang", "_key"], "left").withColumn(name, F.coalesce("_hot", "_cold")).drop("_hot", "_cold", "_key")
    # 38 digits: exact for counts below 10^16
    score = F.expr("CAST(a AS DECIMAL(16, 0)) * CAST(a AS DECIMAL(16, 0)) * CAST(1000000 AS DECIMAL(7, 0)) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))")
    cuts = cuts.withColumn("score", score.cast("long"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return best.join(small_side(totals), "lang").select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")


def not_covered(phrases: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase) of candidates that no longer candidate with ``percent`` of their occurrences holds."""
    w = F.split("phrase", " ")
    size = F.size(w)
    bounds = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda s: F.struct(s.alias("s"), n.alias("n")))))
    held = phrases.where(size > 2).select("lang", "f", F.explode(F.transform(bounds, lambda b: _part(w, b["s"], b["n"]))).alias("phrase"))
    most = held.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return phrases.join(most, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("f"))).select("lang", "phrase")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 10, max_words: int = 3, top: int | None = 2000, cover_percent: int = 50, shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases by score; the first ``top``, or all for None."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    every = saved(count_words(texts))
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    words = every.where(F.col("f") >= min_count)
    below, safe = bitmap(words), []
    for n in range(2, max_words + 1):
        safe.append(saved(safe_hashes(texts, below, n, min_count)))
        below = bitmap(safe[-1])
    hashes = safe[0].select("h")
    for s in safe[1:]:
        hashes = hashes.union(s.select("h"))
    listed = list_phrases(texts, [bitmap(pairs_of(s)) for s in safe]).join(hashes.distinct(), "h", "left_semi").select("lang", "phrase").distinct()
    phrases = saved(count_phrases(texts, listed, shard).where(F.col("f") >= min_count))
    out = scored(phrases, words, totals).join(not_covered(phrases, cover_percent), ["lang", "phrase"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    if top is None:
        return out.select("lang", rank.alias("rank"), "phrase", "a", "l", "r", "n", "score")
    r = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return out.withColumn("_r", r).where(F.col("_r") <= top).select("lang", F.col("_r").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op13_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\v\f\r]')) AS piece
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
g AS (
  SELECT lang, ws[i : i + k - 1] AS g, count(*) AS f
  FROM w, unnest([1, 2, 3]) AS s(k), unnest(range(1, len(ws) - k + 2)) AS t(i)
  GROUP BY ALL),
tot AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE len(g) = 1 GROUP BY lang),
c AS (SELECT lang, g, f AS a FROM g WHERE len(g) >= 2 AND f >= 10),
cuts AS (
  SELECT c.lang, c.g, a, k, x.f AS l, y.f AS r,
         (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM c, unnest(range(1, len(c.g))) AS t(k), g AS x, g AS y
  WHERE x.lang = c.lang AND x.g = c.g[1 : k] AND y.lang = c.lang AND y.g = c.g[k + 1 : len(c.g)]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
held AS (
  SELECT lang, b AS g, max(a) AS most
  FROM (SELECT lang, a, unnest([g[1 : 2], g[2 : 3]]) AS b FROM c WHERE len(g) = 3) z GROUP BY ALL),
kept AS (
  SELECT best.*, array_to_string(best.g, ' ') AS phrase
  FROM best LEFT JOIN held ON best.lang = held.lang AND best.g = held.g
  WHERE most IS NULL OR 100 * most < 50 * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN tot ON kept.lang = tot.lang
QUALIFY rank <= 2000"""
}
QUERIES = {"op13_collocations": op13_collocations}
