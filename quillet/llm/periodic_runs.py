"""Periodic run detection (operator 12): internal pattern matching over the words of each text.

A run is a stretch of words with smallest period q and at least ``min_exponent`` periods that no neighbouring word extends.
Prefix doubling gives the suffix array of every text and, for each power of two, which blocks of words are equal. A run
with 2^k <= q < 2^(k+1) holds an aligned (dyadic) block of 2^k words that occurs again q words later, so each aligned
block asks for its next two occurrences in the window [2^k, 2^(k+1)) behind it: a range successor in a wavelet tree over
the suffix array, inside the interval of the block. Two occurrences at most half a block apart belong to an arithmetic
progression with the block's own period p; then q is the distance of the ends of the two stretches of period p, as these
ends are the only place where a longer period can align them. Otherwise there are no more than these two. Every candidate
is extended to both sides by the equal blocks (binary lifting) and kept if it is long enough; of stretches with the same
bounds the smallest period stays.

All blocks and all texts of a batch are numpy arrays that move together; a word is an exact dictionary code, not a hash.
Time is n log n for n words of a text, whatever its repetitions, and memory grows with the longest text of a task alone.

Scale: one pass, no shuffle, nothing broadcast.

Defined cases: a null or empty text has no words, no runs and collapses to the empty text; very long texts are a batch of
their own; texts with the same words (repeated rows) get the same result each; runs that overlap are all reported, and of
equally long ones the first start counts as longest; an empty table gives an empty result; columns named as a result
column are replaced, others stay.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, without
from .text import _SPACE, Words, slices

BATCH_BYTES = 1 << 20
RESULT = ["n_words", "runs", "collapsed"]
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_codes(words: Words) -> np.ndarray:
    """Code of each word: equal words of a batch, and only these, have the same."""
    sizes = words.end - words.start
    if not len(sizes):
        return np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    packed = words.data[~_SPACE[words.data]]
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(packed)])
    return np.asarray(array.dictionary_encode().indices).astype(np.int64)


class Repeats:
    """Suffix array of the words of several texts, and ``rank[k][i]``: first place in it of the suffixes that share their
    first 2^k words with suffix i. A class never spans two texts; classes of one are final, so that later rounds sort the others alone."""

    def __init__(self, codes: np.ndarray, doc: np.ndarray, first: np.ndarray):
        n = len(codes)
        self.n, self.end = n, first[1:][doc]
        key = doc * (int(codes.max(initial=0)) + 1) + codes
        self.order = np.argsort(key, kind="stable")
        rank, size = np.empty(n, np.int64), None
        rank[self.order], size = self._classes(key[self.order], np.arange(n))
        self.rank, self.size = [np.append(rank, -1)], [size]
        slots = np.flatnonzero(size[rank[self.order]] > 1)
        step = 1
        while len(slots):
            own = self.order[slots]
            second = np.where(own + step < self.end[own], rank[np.minimum(own + step, n - 1)], -1)
            key = rank[own] * (n + 1) + second + 1
            by = np.argsort(key, kind="stable")
            own = own[by]
            self.order[slots] = own
            rank = rank.copy()
            rank[own], size = self._classes(key[by], slots)
            self.rank.append(np.append(rank, -1))
            self.size.append(size)
            slots = slots[size[rank[own]] > 1]
            step *= 2

    def _classes(self, keys: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first slot of each key's class, class size by first slot) of sorted keys."""
        fresh = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
        start = slots[np.flatnonzero(fresh)]
        own = start[np.cumsum(fresh) - 1]
        size = np.zeros(self.n, np.int64)
        size[start] = np.diff(np.append(np.flatnonzero(fresh), len(keys)))
        return own, size

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from i and from j on (i < j, same text)."""
        length = np.zeros(len(i), np.int64)
        for k in range(len(self.rank) - 1, -1, -1):
            r = self.rank[k]
            length += (r[i + length] == r[j + length]).astype(np.int64) << k
        return length

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words before i and before j. A block that leaves its text is in a class of its own."""
        length = np.zeros(len(i), np.int64)
        for k in range(len(self.rank) - 1, -1, -1):
            r = self.rank[k]
            a = i - length - (1 << k)
            length += ((a >= 0) & (r[np.maximum(a, 0)] == r[np.maximum(a + j - i, 0)])).astype(np.int64) << k
        return length


class WaveletTree:
    """Values below 2^bits by their bits from the highest: each level keeps the number of zeros before every place and
    hands zeros, then ones, to the next."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros: list[np.ndarray] = []
        for b in range(self.bits - 1, -1, -1):
            zero = (values >> b) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]).astype(np.int32))
            values = np.concatenate([values[zero], values[~zero]])

    def successor(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Smallest value >= ``least`` in each range [lo, hi), -1 without one: how many are smaller, then the next in order."""
        left, right, smaller = lo, hi, np.zeros(len(lo), np.int64)
        for z, b in zip(self.zeros, range(self.bits - 1, -1, -1), strict=True):
            one = (least >> b) & 1 == 1
            zl, zr = z[left], z[right]
            smaller += np.where(one, zr - zl, 0)
            left, right = np.where(one, z[-1] + left - zl, zl), np.where(one, z[-1] + right - zr, zr)
        found = (smaller < hi - lo) & (least < 1 << self.bits)
        left, right, rest, value = lo, hi, np.where(found, smaller, 0), np.zeros(len(lo), np.int64)
        for z, b in zip(self.zeros, range(self.bits - 1, -1, -1), strict=True):
            zl, zr = z[left], z[right]
            one = rest >= zr - zl
            rest = np.where(one, rest - (zr - zl), rest)
            left, right = np.where(one, z[-1] + left - zl, zl), np.where(one, z[-1] + right - zr, zr)
            value |= one.astype(np.int64) << b
        return np.where(found, value, -1)


def find_runs(codes: np.ndarray, doc: np.ndarray, first: np.ndarray, min_len: int = 6, min_exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start, then period; starts count over the whole batch."""
    none = (np.zeros(0, np.int64),) * 3
    if not len(codes):
        return none
    n_words = np.diff(first)
    texts, tree = Repeats(codes, doc, first), None
    place = np.arange(len(codes)) - first[doc]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k, (rank, size) in enumerate(zip(texts.rank, texts.size, strict=True)):
        m = 1 << k
        # a run holds a block with its two next occurrences, or min_len equal words where the period is one
        times = max(min_exponent - 1, 3) if k else max(min_exponent, min_len)
        at = np.flatnonzero((place & (m - 1) == 0) & (n_words[doc] >= max(min_len, min_exponent * m)) & (place + m <= n_words[doc]))
        at = at[size[rank[at]] >= times]
        if not len(at):
            if m * min_exponent > n_words.max():
                break
            continue
        tree = tree or WaveletTree(texts.order)
        lo = rank[at]
        hi = lo + size[lo]
        one = tree.successor(lo, hi, at + m)
        ok = (one >= 0) & (one < at + 2 * m)
        at, one, lo, hi = at[ok], one[ok], lo[ok], hi[ok]
        two = tree.successor(lo, hi, one + 1)
        two = np.where(two < at + 2 * m, two, -1)
        found.append((at, one - at))
        far = (two >= 0) & (two - one > m // 2)
        found.append((at[far], two[far] - at[far]))
        near = (two >= 0) & ~far
        x, c, p = at[near], one[near], (two - one)[near]
        ends = (x + p + texts.forward(x, x + p), c + p + texts.forward(c, c + p))
        q = ends[1] - ends[0]
        ok = (q >= m) & (q < 2 * m) & (x + q < texts.end[x])
        found.append((x[ok], q[ok]))
    if not found:
        return none
    x, q = (np.concatenate(c) for c in zip(*found, strict=True))
    start, end = x - texts.backward(x, x + q), x + q + texts.forward(x, x + q)
    ok = end - start >= np.maximum(min_len, min_exponent * q)
    start, end, q = start[ok], end[ok], q[ok]
    by = np.lexsort((q, end, start))
    start, end, q = start[by], end[by], q[by]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[fresh], end[fresh], q[fresh]
    by = np.lexsort((q, start))
    return start[by], (end - start)[by], q[by]


def joined(words: Words, pick: np.ndarray, doc: np.ndarray, n_rows: int) -> pa.Array:
    """Texts of the picked words (indices, text by text), with one space between two of them."""
    sizes = words.end[pick] - words.start[pick] + 1
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(int(ends[-1]), 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[ends[1:] - 1] = False
    out[inside] = words.data[np.arange(len(out))[inside] + np.repeat(words.start[pick] - ends[:-1], sizes - 1)]
    # a text's bytes end before the space behind its last word
    last = np.ones(len(pick), bool)
    last[:-1] = doc[1:] != doc[:-1]
    keep = np.ones(len(out), bool)
    keep[(ends[1:] - 1)[last]] = False
    length = np.bincount(doc, weights=sizes, minlength=n_rows).astype(np.int64)
    length -= length > 0
    offsets = np.concatenate([[0], np.cumsum(length)])
    return pa.LargeStringArray.from_buffers(n_rows, pa.py_buffer(offsets), pa.py_buffer(out[keep])).cast(pa.string())


def periodic_runs(docs: DataFrame, text_col: str = "text", min_len: int = 6, min_exponent: int = 4) -> DataFrame:
    """Documents with ``n_words``, ``runs`` (start, length, period in words, by start and period) and ``collapsed``: the
    words, joined by spaces, without those that any run repeats after its first period."""
    if min_exponent < 4:
        raise ValueError("shorter runs than four periods need not hold a block with two further occurrences")
    small_batches(docs.sparkSession)
    base = without(docs, RESULT)
    at, names = base.columns.index(text_col), [*base.columns, *RESULT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text_col, BATCH_BYTES):
                w = Words(b.column(at), lower=False)
                start, length, period = find_runs(word_codes(w), w.doc, w.first, min_len, min_exponent)
                gone = np.zeros(len(w.start) + 1, np.int64)
                np.add.at(gone, start + period, 1)
                np.add.at(gone, start + length, -1)
                pick = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                row = w.doc[start]
                runs = pa.StructArray.from_arrays([pa.array(start - w.first[row]), pa.array(length), pa.array(period)], fields=list(_RUN))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)), runs)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(w.counts()), lists, joined(w, pick, w.doc[pick], b.num_rows)], names)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema], "n_words long", "runs array<struct<start: long, length: long, period: long>>", "collapsed string"])
    return base.mapInArrow(run, schema)


def looped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The query's table: with h = crc32 of the id's decimal text and g = h div 10, a text with h % 10 = 0 and n words goes
    on from word a = g % n by repeating its next 1 + (n - a) div (3 + g % 8) words. Other texts stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for row, (key, text) in enumerate(zip(b.column(0).to_pylist(), texts, strict=True)):
                h = zlib.crc32(b"" if key is None else str(key).encode())
                if h % 10 or not text:
                    continue
                w = Words(pa.array([text]), lower=False)
                n, g = len(w.start), h // 10
                if n:
                    a = g % n
                    i = np.arange(n)
                    pick = np.where(i >= a, a + (i - a) % (1 + (n - a) // (3 + g % 8)), i)
                    texts[row] = joined(w, pick, np.zeros(n, np.int64), 1)[0].as_py()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, text_col])

    d = docs.select(id_col, text_col)
    return d.mapInArrow(run, d.schema)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = periodic_runs(looped(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    top = F.get(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.when(x["length"] > y["length"], -1).otherwise(1)).when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).otherwise(F.signum(x["period"] - y["period"]).cast("int"))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    d = out.withColumn("_top", top)
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_top.start").alias("start"), F.col("_top.length").alias("length"), F.col("_top.period").alias("period"),
        F.expr("1000 * _top.length div _top.period").alias("exponent_milli"), sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


SQL: dict[str, str] = {}
QUERIES = {"op12_periodic_runs": op12_periodic_runs}
