"""MinHash near-duplicates (operator 5) with Order MinHash sketches and banded alignment.

A document is its sequence of five-word shingles, each labelled with its occurrence number. Each of ``SKETCHES`` sketch
entries takes the two smallest labelled shingles under its own hash and keeps them in text order, so that entries of
two texts agree when contents and order do. Documents that share one of the first ``BUCKETS`` entries meet; pairs with
at least ``AGREE`` equal entries are candidates, and are verified on the texts by a banded alignment of their
shingles: similarity = aligned / (shingles of both - aligned) >= 0.8. The band is the number of shingles that a pair
at that similarity can leave unaligned, so it loses nothing.

Scale: exact copies are one document from the start. Buckets are streams of rows sorted by key; inside one, sketches
are compared in numpy blocks and only candidates leave the task. In buckets of over ``SMALL`` documents each document
first brings its best ``FIRST_PARTNERS`` partners; after these links are drawn together to classes, every candidate
pair between two classes of such a bucket is tested on its whole shingle sequences, so that no link that could join
classes is left out. No bucket is one task: at first a bucket of over ``block_rows`` documents is dealt into blocks
which share a few pivots, and later each block of the documents outside its largest class meets each block of all its
documents in a tile of its own, bounded in rows and in words. Texts of candidates alone are joined to the pairs: their
ids pick them without a shuffle while there are up to a million.

Defined cases: a text without words, and a row without an id, is alone; a text of under five words is one shingle;
the smallest id of a class stays; rows that repeat an id and a text are one document and share its result; columns
named as a result column are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches, small_side, without
from .components import connected_components
from .text import Words, mix, slices

WIDTH = 5
SKETCHES, BUCKETS, AGREE = 24, 12, 7
SMALL, FIRST_PARTNERS = 48, 8
BLOCK_ROWS, BLOCK_WORDS, PIVOT_SHARE = 2048, 1 << 21, 64
RESULT = ["class_id", "class_kept"]
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(occurrence-labelled hash, row) of all shingles in text order; a text of 1 to 4 words is one shingle."""
    h, at = w.ngrams(WIDTH)
    row = w.doc[at]
    few = np.flatnonzero((w.counts() > 0) & (w.counts() < WIDTH))
    if len(few):
        extra = np.array([mix(np.bitwise_xor.reduce(mix(w.hash[w.first[r] : w.first[r + 1]] + np.arange(w.first[r + 1] - w.first[r], dtype=np.uint64))[None, :], axis=1))[0] for r in few], np.uint64)
        h, row = np.concatenate([h, extra]), np.concatenate([row, few])
        by = np.argsort(row, kind="stable")
        h, row = h[by], row[by]
    key = h ^ mix(row.astype(np.uint64) + np.uint64(77))
    by = np.argsort(key, kind="stable")
    sorted_ = key[by]
    new = np.ones(len(key), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    rank = np.arange(len(key)) - np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    seen = np.zeros(len(key), np.int64)
    seen[by] = rank
    again = seen > 0
    h[again] = mix(h[again] + seen[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return h, row


def sketches(h: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """(rows, SKETCHES) entries; rows without shingles get zeros."""
    out = np.zeros((n_rows, SKETCHES), np.uint64)
    if not len(h):
        return out
    have, first = np.unique(row, return_index=True)
    size = np.diff(np.concatenate([first, [len(h)]]))
    group = np.repeat(np.arange(len(have)), size)
    big = np.uint64(0xFFFFFFFFFFFFFFFF)
    for k in range(SKETCHES):
        x = (h ^ _SEEDS[k]) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        one = np.minimum.reduceat(x, first)
        is_one = x == one[group]
        x2 = np.where(is_one, big, x)
        two = np.minimum.reduceat(x2, first)
        pos = np.arange(len(h))
        at_one = np.minimum.reduceat(np.where(is_one, pos, len(h)), first)
        at_two = np.minimum.reduceat(np.where(x2 == two[group], pos, len(h)), first)
        ahead = at_one < at_two
        a, b = np.where(ahead, one, two), np.where(ahead, two, one)
        out[have, k] = mix(mix(a) * np.uint64(3) + b + np.uint64(k))
    return out


def longest_rise(values: list[int]) -> int:
    tails: list[int] = []
    for v in values:
        i = bisect_left(tails, v)
        if i == len(tails):
            tails.append(v)
        else:
            tails[i] = v
    return len(tails)


def similarities(a: pa.Array, b: pa.Array, threshold: float) -> np.ndarray:
    """Similarity of the texts a[i] and b[i] by banded alignment of their shingles."""
    n = len(a)
    (ha, ra), (hb, rb) = shingles(Words(a)), shingles(Words(b))
    na, nb = np.bincount(ra, minlength=n), np.bincount(rb, minlength=n)
    pa_, pb_ = np.arange(len(ha)) - np.searchsorted(ra, ra), np.arange(len(hb)) - np.searchsorted(rb, rb)
    ka, kb = ha ^ mix(ra.astype(np.uint64)), hb ^ mix(rb.astype(np.uint64))
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=False, return_indices=True)
    band = ((1 - threshold) / (1 + threshold) * (na + nb)).astype(np.int64) + 1
    inside = np.abs(pa_[ia] - pb_[ib]) <= band[ra[ia]]
    ia, ib = ia[inside], ib[inside]
    order = np.argsort(ia)
    ia, ib = ia[order], ib[order]
    pair = ra[ia]
    aligned = np.bincount(pair, minlength=n)
    falls = np.unique(pair[1:][(pair[1:] == pair[:-1]) & (ib[1:] < ib[:-1])])
    for p in falls.tolist():
        s, e = np.searchsorted(pair, [p, p + 1])
        aligned[p] = longest_rise(ib[s:e].tolist())
    return aligned / np.maximum(na + nb - aligned, 1)


def agreeing(block: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Number of equal sketch entries of each row of ``block`` with each row of ``sig``."""
    same = np.zeros((len(block), len(sig)), np.int16)
    for k in range(SKETCHES):
        same += block[:, k][:, None] == sig[:, k][None, :]
    return same


def first_pairs(t: pa.Table) -> list[np.ndarray]:
    """Candidate pairs of one block, and whether it left some out: in a large one, each row brings its best partners and its two best pivots."""
    ids, sig, pivots = column(t, "rep"), signatures(t), np.flatnonzero(np.asarray(t.column("pivot").combine_chunks().cast(pa.int8())))
    g = len(ids)
    left, right, cut = [], [], False
    for s in range(0, g, 512):
        same = agreeing(sig[s : s + 512], sig)
        ok = same >= AGREE
        ok[np.arange(len(ok)), np.arange(s, s + len(ok))] = False
        if g > SMALL:
            for i in np.flatnonzero(ok.sum(axis=1) > FIRST_PARTNERS).tolist():
                cut = True
                found = np.flatnonzero(ok[i])
                ok[i, found[np.argsort(-same[i, found], kind="stable")[FIRST_PARTNERS:]]] = False
                hubs = np.intersect1d(found, pivots)
                ok[i, hubs[np.argsort(-same[i, hubs], kind="stable")[:2]]] = True
        i, j = np.nonzero(ok)
        left.append(ids[i + s]), right.append(ids[j])
    x, y = np.concatenate(left), np.concatenate(right)
    return [np.minimum(x, y), np.maximum(x, y), np.full(len(x), cut)]


def links_between(t: pa.Table, threshold: float) -> list[np.ndarray]:
    """All links of one tile that join two classes, found on whole shingle sequences: its ``seeker`` rows, which are outside
    the bucket's largest class, with its other rows. Two outside rows are tested once, and a pair in the first bucket that it shares."""
    ids, wide, comp, entry = column(t, "rep"), signatures(t, np.uint32), column(t, "comp").copy(), int(t.column("k")[0].as_py())
    sig = wide.astype(np.uint16)
    seeker, outside = (np.asarray(t.column(c).combine_chunks().cast(pa.int8())).astype(bool) for c in ("seeker", "outside"))
    lists = t.column("h").combine_chunks()
    flat = np.asarray(lists.flatten()).view(np.uint64)
    edge = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))])
    size = np.diff(edge)
    seekers, others = np.flatnonzero(seeker), np.flatnonzero(~seeker)
    code, mark = None, None
    left, right = [], []
    for s in range(0, len(seekers), 256):
        rows = seekers[s : s + 256]
        same = agreeing(sig[rows], sig[others])
        for k, i in enumerate(rows.tolist()):
            hit = np.flatnonzero(same[k] >= AGREE)
            near = others[hit]
            ok = (comp[near] != comp[i]) & (~outside[near] | (ids[near] > ids[i])) & (np.minimum(size[near], size[i]) >= threshold * np.maximum(size[near], size[i]))
            ok &= ~(wide[near, :entry] == wide[i, :entry]).any(axis=1)
            hit, near = hit[ok], near[ok]
            if not len(near):
                continue
            if code is None:
                code = np.unique(flat, return_inverse=True)[1]
                mark = np.zeros(len(flat), bool)
            mark[code[edge[i] : edge[i + 1]]] = True
            near = near[np.argsort(-same[k, hit], kind="stable")]
            for c in range(0, len(near), 256):
                part = near[c : c + 256]
                part = part[comp[part] != comp[i]]
                if not len(part):
                    continue
                start = np.cumsum(size[part]) - size[part]
                h = np.repeat(edge[part] - start, size[part]) + np.arange(int(size[part].sum()))
                both = np.add.reduceat(mark[code[h]], start, dtype=np.int64)
                for j in part[both >= threshold * (size[part] + size[i] - both)].tolist():
                    if comp[i] == comp[j]:
                        continue
                    a, b = flat[edge[i] : edge[i + 1]], flat[edge[j] : edge[j + 1]]
                    _, ia, ib = np.intersect1d(a, b, return_indices=True)
                    m = longest_rise(ib[np.argsort(ia)].tolist())
                    if m >= threshold * (len(a) + len(b) - m):
                        left.append(ids[i]), right.append(ids[j])
                        comp[comp == comp[j]] = comp[i]
            mark[code[edge[i] : edge[i + 1]]] = False
    return [np.array(left, ids.dtype), np.array(right, ids.dtype)]


def column(t: pa.Table, name: str) -> np.ndarray:
    return np.asarray(t.column(name).combine_chunks())


def signatures(t: pa.Table, kind: type = np.uint16) -> np.ndarray:
    return np.asarray(t.column("sig").combine_chunks().flatten(), np.int32).reshape(-1, SKETCHES).astype(kind)


def number(n, of: int):
    """Number of blocks of ``of`` that hold ``n``."""
    return F.greatest(F.ceil(n / F.lit(of)), F.lit(1)).cast("int")


def in_blocks(entries: DataFrame, block_rows: int) -> DataFrame:
    """(key, rep, sig, pivot): rows of buckets of over ``block_rows`` documents are dealt into blocks with a key of their
    own; about block_rows / PIVOT_SHARE of a bucket's rows are pivots, which are in every block of it."""
    wide = entries.groupBy("key").agg(F.count(F.lit(1)).alias("g")).where(F.col("g") > block_rows).select("key", number(F.col("g"), block_rows).alias("blocks"))
    d = entries.join(small_side(saved(wide)), "key", "left").withColumn("pivot", F.coalesce(F.pmod(F.xxhash64(F.lit(7), "rep"), F.col("blocks") * PIVOT_SHARE) == 0, F.lit(False)))
    own = F.pmod(F.xxhash64(F.lit(9), "rep"), F.coalesce("blocks", F.lit(1))).cast("int")
    d = d.withColumn("block", F.explode(F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))))
    return d.select(F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", "block")).alias("key"), "rep", "sig", "pivot", F.col("blocks").isNotNull().alias("wide"))


def in_tiles(placed: DataFrame, block_rows: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(key, k, rep, sig, comp, outside, seeker): a tile for each block of a bucket's rows outside its largest class and each
    block of all its rows. ``placed``: (key, k, rep, n, sig, comp). Buckets that were compared whole or are one class have none."""
    per = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("w"))
    open_ = per.groupBy("key").agg(F.sum("g").alias("g"), F.sum("w").alias("w"), F.max(F.struct("g", "comp", "w")).alias("top"), F.count(F.lit(1)).alias("classes")).where((F.col("g") > min(SMALL, block_rows)) & (F.col("classes") > 1))
    n = lambda g, w: F.greatest(number(g, block_rows), number(w, block_words))
    open_ = saved(open_.select("key", F.col("top.comp").alias("top"), n(F.col("g"), F.col("w")).alias("all"), n(F.col("g") - F.col("top.g"), F.col("w") - F.col("top.w")).alias("out")))
    d = placed.join(small_side(open_), "key").withColumn("outside", F.col("comp") != F.col("top"))
    hashed = F.xxhash64(F.lit(11), "rep")
    own = lambda c: F.pmod(hashed, F.col(c)).cast("int")
    each = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    met = F.transform(each("out"), lambda o: F.struct(F.lit(False).alias("seeker"), o.alias("o"), own("all").alias("a")))
    seeks = F.when(F.col("outside"), F.transform(each("all"), lambda a: F.struct(F.lit(True).alias("seeker"), own("out").alias("o"), a.alias("a"))))
    d = d.withColumn("t", F.explode(F.concat(met, F.coalesce(seeks, F.array().cast("array<struct<seeker:boolean,o:int,a:int>>")))))
    return d.select(F.xxhash64("key", "t.o", "t.a").alias("key"), "k", "rep", "sig", "comp", "outside", F.col("t.seeker").alias("seeker"))


def streamed(work, names: list[str]):
    """Apply ``work`` to each bucket of a partition that is sorted by key; buckets of one row are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts)
            keys = column(t, "key")
            edge = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            found = [work(t.slice(int(edge[i]), int(edge[i + 1] - edge[i]))) for i in np.flatnonzero(np.diff(edge) > 1).tolist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.asarray(batch.column("key"))
            last = int(np.flatnonzero(keys == keys[-1])[0])  # rows from here on may go on in the next batch
            if held and held[-1].column("key")[-1].as_py() != keys[0]:
                yield from flush(held)
                held = []
            if last:
                yield from flush([*held, batch.slice(0, last)])
                held = [batch.slice(last)]
            else:
                held.append(batch)
        if held:
            yield from flush(held)

    return run


def shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, "text", 1 << 19):
            h, row = shingles(Words(b.column("text")))
            edge = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(edge), pa.array(h.view(np.int64)))], ["rep", "h"])


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Documents with ``class_id`` (the smallest id of the class) and ``class_kept`` (whether this one stays)."""
    small_batches(docs.sparkSession)
    base = without(docs, RESULT)
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rid = F.xxhash64(F.lit(5), ident, F.coalesce(text, F.lit("")))
    id_type = docs.schema[id_col].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1 << 19):
                w = Words(b.column("text"))
                n = w.counts()
                pos = (np.arange(len(w.hash)) - np.repeat(w.first[:-1], n)).astype(np.uint64)
                marks = []
                for salt in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(w.hash + (pos + np.uint64(1)) * salt))])
                    marks.append(mix(total[w.first[1:]] - total[w.first[:-1]] + n.astype(np.uint64)).view(np.int64))
                sig = sketches(*shingles(w), w.n_rows)
                use = pa.array(n > 0)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(sig.view(np.int64).ravel()), SKETCHES).cast(pa.list_(pa.int64()))
                cols = [b.column("id"), b.column("rid"), pa.array(marks[0]), pa.array(marks[1]), pa.array(n), flat]
                yield pa.RecordBatch.from_arrays([c.filter(use) for c in cols], ["id", "rid", "fa", "fb", "n", "sig"])

    rows = base.where(ident.isNotNull()).select(ident.alias("id"), rid.alias("rid"), text.alias("text"))
    marked = saved(rows.mapInArrow(sketch, f"id {id_type}, rid long, fa long, fb long, n long, sig array<long>"))
    reps = saved(marked.groupBy("fa", "fb", "n").agg(F.min("id").alias("rep"), F.first("sig").alias("sig")))
    entries = lambda mask: reps.select("rep", "n", F.posexplode(F.slice("sig", 1, BUCKETS)).alias("k", "key"), "sig").withColumn("sig", F.transform("sig", lambda x: x.bitwiseAND(F.lit(mask)).cast("int")))

    by_key = lambda d: d.repartition("key").sortWithinPartitions("key", "rep")
    blocks = in_blocks(entries(0xFFFF).select("key", "rep", "sig"), block_rows)
    wide = bool(blocks.where("wide").head(1))
    first = by_key(blocks.drop("wide")).mapInArrow(streamed(first_pairs, ["a", "b", "cut"]), f"a {id_type}, b {id_type}, cut boolean")
    pairs = saved(first.groupBy("a", "b").agg(F.max("cut").alias("cut")))
    state = pairs.where("a <> b").agg(F.count(F.lit(1)).alias("n"), F.max("cut").alias("cut")).first()
    comp = None
    if state["n"] or wide:
        texts = base.select(ident.alias("id"), text.alias("text"))
        links = saved(verified(texts, pairs.where("a <> b").select("a", "b"), threshold))
        comp = saved(connected_components(links))
        if state["cut"] or wide:
            placed = entries(0x7FFFFFFF).join(comp, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "rep")).select("key", "k", "rep", "n", "sig", "comp")
            rest = saved(in_tiles(placed, block_rows))
            ids = saved(rest.select(F.col("rep").alias("id")).distinct())
            whole = saved(texts.join(small_side(ids), "id", "left_semi").dropDuplicates(["id"]).mapInArrow(shingle_rows, f"rep {id_type}, h array<long>"))
            parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            tiles = rest.join(whole, "rep").repartition(parts, "key").sortWithinPartitions("key", "rep")
            more = tiles.mapInArrow(streamed(lambda *x: links_between(*x, threshold), ["a", "b"]), f"a {id_type}, b {id_type}")
            comp = saved(connected_components(links.union(more)))
    own = marked.join(reps.select("fa", "fb", F.col("n").alias("_n"), "rep"), ["fa", "fb"]).where(F.col("n") == F.col("_n")).select("rid", "rep")
    if comp is not None:
        own = own.join(comp, F.col("rep") == F.col("node"), "left").select("rid", F.coalesce("component", "rep").alias("class_id"))
    else:
        own = own.select("rid", F.col("rep").alias("class_id"))
    own = saved(own.dropDuplicates(["rid"]))
    out = base.withColumn("_q_rid", rid).join(own, F.col("_q_rid") == F.col("rid"), "left")
    cls = F.coalesce("class_id", ident)
    return out.select(*[F.col(f"`{c}`") for c in base.columns], cls.alias("class_id"), F.coalesce(cls == ident, F.lit(True)).alias("class_kept"))


def verified(texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of ids whose texts are similar enough."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    used = saved(texts.join(small_side(saved(ids)), "id", "left_semi").dropDuplicates(["id"]))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "ta", 1 << 19):
                ok = similarities(b.column("ta"), b.column("tb"), threshold) >= threshold
                yield b.select(["a", "b"]).filter(pa.array(ok))

    both = (
        pairs.join(used.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        .join(used.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    )
    return both.mapInArrow(check, pairs.schema)


def op5_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_dedup(docs).select("doc_id", *RESULT)


QUERIES = {"op5_minhash_near_dedup": op5_minhash_near_dedup}
SQL: dict[str, str] = {}
