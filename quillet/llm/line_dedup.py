"""Line dedup (operator 10) with two Bloom filters.

Pass 1 hashes every line key into a once-seen and a twice-seen Bloom filter: each task keeps both for its own lines, as
positions by segment, and tasks' segments are merged (a position that two tasks have seen once is seen twice). Pass 2
tests every line against the twice-seen filter; only suspected repeats are shuffled, as 128-bit digests with their
document id, for exact confirmation and for the choice of the document that keeps the line. Pass 3 rewrites the texts.

Scale: no line reaches a shuffle before it is suspected. What a task sends for a segment is at most a bitmap of
``SEGMENT_BITS`` for each filter, and its sorted positions where these are smaller; segments are merged in two steps, so
that one task merges about the square root of all parts. The filters have ``filter_bytes`` each whatever the input, and
travel as positions or bitmaps, whichever is smaller. They fill up at about 16 bits a line; beyond that they let more
lines through to the exact step and results stay the same. A line that a third of all documents share is one row for each
of them in the exact step, aggregated in each task before the shuffle; the join that brings its verdict back is a plain
equi-join that adaptive execution may split.

Defined cases: a null or empty text is one empty line and stays; a null doc_id counts as one document below every
other id; rows that repeat a doc_id are one document; an empty table gives an empty result; columns named as a result
column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, small_batches, without

_STRIP = bytes([0x20, *range(0x09, 0x0E)])
SEGMENT_BITS = 1 << 20
N_HASHES = 3
HELD = 1 << 20
PARTS = 256


def _key(line: bytes, min_len: int) -> bytes | None:
    """Digest of a line's key, or None if the key is too short to be compared."""
    key = line.strip(_STRIP).lower()
    if len(key) < min_len or (len(key) < 4 * min_len and len(key.decode("utf-8", "replace")) < min_len):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _bits(digests: list[bytes], n_segments: int) -> np.ndarray:
    """(n, N_HASHES) bit positions; all bits of a line lie in one segment (a blocked Bloom filter)."""
    h = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    seg = (h[:, 0] % np.uint64(n_segments)).astype(np.int64)
    step = np.stack([(h[:, 1] >> np.uint64(21 * i)) & np.uint64(SEGMENT_BITS - 1) for i in range(N_HASHES)], 1)
    return seg[:, None] * SEGMENT_BITS + step.astype(np.int64)


def pack_positions(at: np.ndarray) -> bytes:
    """Sorted positions of one segment: their differences, byte planes apart (the high ones are mostly zero), or a bitmap
    where that is smaller. A bitmap has its own length, which positions never have."""
    if len(at) * 4 < SEGMENT_BITS // 8:
        return np.diff(at, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    flags = np.zeros(SEGMENT_BITS, np.uint8)
    flags[at] = 1
    return np.packbits(flags).tobytes()


def unpack_positions(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    if len(raw) == SEGMENT_BITS // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8)))
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64))


def segments(once: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    """(seg, once, twice) rows of sorted positions over all segments."""
    seg = np.unique(once // SEGMENT_BITS)
    cuts = [np.searchsorted(x, np.concatenate([seg, seg[-1:] + 1]) * SEGMENT_BITS) for x in (once, twice)]
    cut = lambda x, c, i: pack_positions(x[c[i] : c[i + 1]] - seg[i] * SEGMENT_BITS)
    return pa.RecordBatch.from_arrays([pa.array(seg), *(pa.array([cut(x, c, i) for i in range(len(seg))], pa.binary()) for x, c in zip((once, twice), cuts, strict=True))], ["seg", "once", "twice"])


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Positions seen at all, and seen twice or more, of several (seen, seen twice)."""
    at, n = np.unique(np.concatenate([p[0] for p in parts]), return_counts=True)
    return at, np.union1d(at[n > 1], np.concatenate([p[1] for p in parts]))


def _raw(text) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def keys_of(text, min_len: int) -> set[bytes]:
    return {k for line in _raw(text).split(b"\n") if (k := _key(line, min_len))}


def twice_seen(docs: DataFrame, text_col: str, min_len: int, n_segments: int) -> dict[int, bytes]:
    """The twice-seen filter: packed positions of its segments that have any."""

    def own_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's once-seen and twice-seen positions; they are sent on where they become many."""
        parts, held = [], 0
        for b in batches:
            found = [k for text in b.column(0).to_pylist() for k in keys_of(text, min_len)]
            if not found:
                continue
            # each bit counts once for each line, however many of the line's hashes meet in it
            bits = np.sort(_bits(found, n_segments), axis=1)
            fresh = np.ones(bits.shape, bool)
            fresh[:, 1:] = bits[:, 1:] != bits[:, :-1]
            at, n = np.unique(bits[fresh], return_counts=True)
            parts.append((at, at[n > 1]))
            held += len(at)
            if held > 2 * HELD:
                parts = [merged(parts)]
                held = len(parts[0][0])
                if held > HELD:
                    yield segments(*parts[0])
                    parts, held = [], 0
        if parts:
            yield segments(*merged(parts))

    def merge(table: pa.Table) -> pa.Table:
        seg = table.column("seg")[0].as_py()
        once, twice = merged([(unpack_positions(a), unpack_positions(b)) for a, b in zip(table.column("once").to_pylist(), table.column("twice").to_pylist(), strict=True)])
        return pa.table({"seg": pa.array([seg]), "part": pa.array([0], pa.int32()), "once": pa.array([pack_positions(once)], pa.binary()), "twice": pa.array([pack_positions(twice)], pa.binary())})

    schema = "seg long, part int, once binary, twice binary"
    own = docs.select(F.col(f"`{text_col}`")).mapInArrow(own_filters, "seg long, once binary, twice binary")
    own = own.withColumn("part", F.floor(F.spark_partition_id() / PARTS).cast("int"))
    some = own.groupBy("seg", "part").applyInArrow(merge, schema)
    whole = some.groupBy("seg").applyInArrow(merge, schema).where(F.length("twice") > 0)
    return {r.seg: bytes(r.twice) for r in whole.select("seg", "twice").collect()}  # at most filter_bytes altogether


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 20, min_docs: int = 3, filter_bytes: int = 64 << 20) -> DataFrame:
    """Documents with repeated lines removed, and ``n_lines`` (before) and ``n_dropped``.

    A line whose stripped, A-Z lower-cased key has at least ``min_len`` code points and is found in at least
    ``min_docs`` documents stays only in the largest id that holds it.
    """
    sc = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    n_segments = max(1, filter_bytes * 8 // SEGMENT_BITS)
    filt = sc.broadcast(twice_seen(docs, text_col, min_len, n_segments))

    def suspects_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(n_segments * SEGMENT_BITS // 8, np.uint8)  # pages without a bit take no memory
        for seg, raw in filt.value.items():
            at = unpack_positions(raw) + seg * SEGMENT_BITS
            np.bitwise_or.at(bitmap, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        for b in batches:
            ids, keys = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = keys_of(text, min_len)
                keys += own
                ids += [doc] * len(own)
            if keys:
                bits = _bits(keys, n_segments)
                hit = ((bitmap[bits >> 3] >> (7 - (bits & 7)).astype(np.uint8)) & 1).all(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type).filter(pa.array(hit)), pa.array(keys, pa.binary()).filter(pa.array(hit))], ["id", "key"])

    id_type = docs.schema[id_col].dataType.simpleString()
    suspects = saved(docs.select(F.col(f"`{id_col}`"), text).mapInArrow(suspects_of, f"id {id_type}, key binary").distinct())
    verdicts = saved(suspects.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs).select("key", "keeper"))
    drops = (
        suspects.join(verdicts, "key").where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("id").alias("_q_id")).agg(F.collect_list("key").alias("_q_drop"))
    )
    base = without(docs, ["n_lines", "n_dropped"])
    joined = base.join(drops, base[f"`{id_col}`"].eqNullSafe(drops["_q_id"]), "left").drop("_q_id")
    names = [*base.columns, "n_lines", "n_dropped"]
    at = names.index(text_col)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            before, dropped, texts = [], [], []
            for text, drop in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                old = _raw(text).split(b"\n")
                before.append(len(old))
                if drop:
                    gone = set(drop)
                    new = [x for x in old if _key(x, min_len) not in gone]
                    dropped.append(len(old) - len(new))
                    texts.append(b"\n".join(new).decode("utf-8", "surrogatepass"))
                else:
                    dropped.append(0)
                    texts.append(text)
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(before, pa.int64()), pa.array(dropped, pa.int64())], names)

    schema = T.StructType([*base.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(rewrite, schema)


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = {
    "op10_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ix
  FROM documents),
k AS (
  SELECT doc_id, ix, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
v AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (
  SELECT k.*, v.keeper IS NOT NULL AND k.doc_id <> v.keeper AS gone
  FROM k LEFT JOIN v ON k.key = v.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY ix) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id"""
}
QUERIES = {"op10_line_dedup": op10_line_dedup}
