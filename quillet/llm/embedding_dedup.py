"""Embedding near-duplicates (operator 6) by a subspace pigeonhole join.

Unit vectors are turned by one fixed random rotation and split into ``BLOCKS`` blocks. Two vectors with cosine >= t
have squared distance <= 2 (1 - t), so in at least one block their squared distance is at most 2 (1 - t) / BLOCKS.
In every block a range join finds the pairs within that budget; the union of candidates is verified by cosine in double
precision. A pair counts in the first block whose budget it meets, so it is counted once and no distinct over pairs is
needed.

Scale: identical vectors are one vector with a count. A task emits link counts and a spanning forest of the links, never
the pairs themselves. A label of up to ``grid_from`` * ``cell_rows`` vectors is dealt into chunks of ``cell_rows``; each pair
of chunks is a group that joins all blocks in turn, so that a vector is shipped once for each chunk and not once for each
block. In a group, a block's vectors are sorted by their first coordinate and compared only inside the band of the radius.
Larger labels are cut by a grid in each block (cells as wide as the radius) on two to four coordinates, more where the label
has more vectors; cells with over ``cell_rows`` vectors are dealt into chunks too, and wherever one of two cells that meet
is, each pair of their chunks is a group. No group holds more than two chunks, or a cell and the next cells where none is
dealt. In 64 dimensions a cell's radius is about the spread of a coordinate, so a grid keeps about 0.7 of a label's pairs for
each coordinate: work on one label still grows with the square of its different vectors.

Defined cases: vectors that are null, zero or hold null or non-finite components, and vectors without a label, link
with nothing; vectors of different lengths never link; rows equal in id, label and vector are one row; an empty table
gives an empty result; columns named as a result column are replaced.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches, small_side, without
from .components import connected_components

BLOCKS = 8
DEPTHS = (2, 3, 4)
RESULT = ["n_links", "component_id", "kept"]


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(17).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten(), np.float64).reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def unit_rotated(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and their rotated form."""
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    return unit, unit @ rotation(x.shape[1])


def block_edges(dim: int) -> np.ndarray:
    return np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)


def budget(dim: int, threshold: float) -> float:
    return 2 * (1 - threshold) / min(BLOCKS, dim) + 1e-9


def pairs_in(rot: np.ndarray, home: np.ndarray, other: np.ndarray, block: int, edges: np.ndarray, limit: float, own: bool):
    """(i, j) of rows of ``home`` and ``other`` within the budget of ``block`` and of no block before it; each pair once if own.

    Both sides are sorted by the block's first coordinate, and a run of home rows meets the rows in its band alone."""
    sub = rot[:, edges[block] : edges[block + 1]].astype(np.float32)
    sq = (sub * sub).sum(axis=1)
    first, radius = rot[:, edges[block]], np.sqrt(limit)
    home = home[np.argsort(first[home], kind="stable")]
    other = home if own else other[np.argsort(first[other], kind="stable")]
    line = first[other]
    for a in range(0, len(home), 1024):
        h = home[a : a + 1024]
        low = a if own else int(np.searchsorted(line, first[h[0]] - radius))
        for b in range(low, int(np.searchsorted(line, first[h[-1]] + radius, side="right")), 4096):
            o = other[b : b + 4096]
            near = sq[h][:, None] + sq[o][None, :] - 2 * (sub[h] @ sub[o].T) <= limit + 1e-5
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            if own:
                i, j = i[i < j], j[i < j]
            x, y = home[i], other[j]
            keep = np.ones(len(x), bool)
            for s in range(0, len(x), 1 << 16):
                p, q, ok = x[s : s + (1 << 16)], y[s : s + (1 << 16)], keep[s : s + (1 << 16)]
                for k in range(block + 1):  # the same arithmetic in each block, wherever the pair meets
                    d = rot[p, edges[k] : edges[k + 1]] - rot[q, edges[k] : edges[k + 1]]
                    inside = (d * d).sum(axis=1) <= limit
                    ok &= inside if k == block else ~inside
            yield x[keep], y[keep]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row that each of n rows is linked to, directly or not."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = np.minimum(new, new[new])
        if (new == low).all():
            return low
        low = new


def half_offsets(depth: int) -> list[tuple[int, ...]]:
    """The cell itself and one of each pair of opposite next cells."""
    return [o for o in itertools.product((0, 1, -1), repeat=depth) if next((x for x in o if x), 1) > 0]


def in_tiles(cells: DataFrame, dense: DataFrame, where: list[str]) -> DataFrame:
    """``cells`` once for each group (``where``, chunk, off, source) that a vector is in, and whether it is at ``home`` there.

    A group holds a chunk of a cell and one chunk (``source``) of the cell at -``off`` from it, so that each pair of cells
    meets once; if ``off`` is zero and source = chunk, the vectors at home also meet each other. Vectors of cells that are not
    split visit the latter group of a next cell that is not split either. ``dense``: (``where``, chunks) of split cells.
    """
    ints = lambda o: F.array(*[F.lit(x) for x in o]).cast("array<int>")
    offsets = F.array(ints(()))
    for depth in DEPTHS:
        offsets = F.when(F.size("cell") == depth, F.array(*[ints(o) for o in half_offsets(depth)])).otherwise(offsets)
    offsets = F.when(F.size("cell") == 1, F.array(ints((0,)), ints((1,)))).otherwise(offsets)
    role = lambda home: F.transform(offsets, lambda o: F.struct(o.alias("off"), F.lit(home).alias("home")))
    roles = F.concat(role(True), role(False))
    fixed = where[:-1]
    d = cells.withColumn("s", F.explode(roles)).select(*cells.columns, "s.*")
    # the cell at home in the group, and the one that its visitors come from
    d = d.withColumn("hc", F.when(F.col("home"), F.col("cell")).otherwise(F.zip_with("cell", "off", lambda x, y: x + y))).withColumn("vc", F.zip_with("hc", "off", lambda x, y: x - y))
    side = small_side(dense.select(F.xxhash64(*where).alias("cid"), "chunks"))  # two cells of one hash are dealt alike, which is right too
    for c, n in (("hc", "hn"), ("vc", "vn")):
        d = d.withColumn("_c", F.xxhash64(*fixed, c)).join(side.select(F.col("cid").alias("_c"), F.col("chunks").alias(n)), "_c", "left").drop("_c")
    split = F.col("hn").isNotNull() | F.col("vn").isNotNull()
    same_cell = F.forall("off", lambda x: x == 0)
    hn, vn = F.coalesce("hn", F.lit(1)), F.coalesce("vn", F.lit(1))
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("home"), hn).otherwise(vn)).cast("int")
    group = lambda chunk, source: F.struct(chunk.cast("int").alias("chunk"), source.cast("int").alias("source"))
    upto = lambda first, last: F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    zero = F.lit(0)
    groups = (
        F.when(same_cell & F.col("home"), F.transform(upto(zero, F.col("own")), lambda i: group(F.col("own"), i)))
        .when(same_cell, F.transform(upto(F.col("own") + 1, hn - 1), lambda j: group(j, F.col("own"))))
        .when(F.col("home"), F.transform(F.when(split, upto(zero, vn - 1)).otherwise(F.array().cast("array<int>")), lambda i: group(F.col("own"), i)))
        .otherwise(F.transform(upto(zero, hn - 1), lambda j: group(j, F.col("own"))))
    )
    d = d.withColumn("own", own).withColumn("g", F.explode(groups))
    # without a split cell, visitors join the group of the cell itself
    off = F.when(split, F.col("off")).otherwise(F.transform("off", lambda x: zero)).alias("off")
    values = [c for c in cells.columns if c not in where]
    return d.select(*values, *fixed, F.col("hc").alias("cell"), F.col("g.chunk").alias("chunk"), off, F.col("g.source").alias("source"), "home")


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, cell_rows: int = 8192, grid_from: int = 8) -> DataFrame:
    """Vectors with ``n_links``, ``component_id`` and ``kept``."""
    small_batches(vectors.sparkSession)
    base = without(vectors, RESULT).distinct()
    vec, ident, label = F.col(f"`{vec_col}`"), F.col(f"`{id_col}`"), F.col(f"`{label_col}`")
    wide = F.transform(vec, lambda x: x.cast("double"))
    fine = F.coalesce(F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(wide, lambda x: x != 0), F.lit(False))
    key = F.when(fine & label.isNotNull() & ident.isNotNull(), F.xxhash64(label, vec))
    keyed = saved(base.withColumn("_q_key", key))
    good = keyed.where("_q_key is not null").select(F.col("_q_key").alias("key"), ident.alias("id"), label.alias("label"), vec.alias("e"))
    # one row for each different vector of a label: the smallest id stands for its copies
    reps = saved(good.groupBy("key", "label", "e").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies")))
    e_type = reps.schema["e"].dataType.simpleString()
    l_type, i_type = reps.schema["label"].dataType.simpleString(), reps.schema["rep"].dataType.simpleString()

    # a grid in each block for large labels: one more coordinate for eight times the vectors
    sizes = reps.groupBy("label", F.size("e").alias("dim")).agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.col("n") / cell_rows)
    depth = F.when(F.col("k") <= grid_from, 0).when(F.col("k") <= 8 * grid_from, DEPTHS[0]).when(F.col("k") <= 64 * grid_from, DEPTHS[1]).otherwise(DEPTHS[2])
    width = F.floor(F.col("dim") / F.least(F.lit(BLOCKS), F.col("dim"))).cast("int")
    depths = small_side(saved(sizes.select("label", "dim", F.least(depth, width).alias("depth"))))
    sized = reps.withColumn("dim", F.size("e")).join(depths, ["label", "dim"]).select("label", "rep", "copies", "e", "dim", "depth")

    def to_cells(batches):
        for b in batches:
            kind = np.asarray(b.column("dim"), np.int64) * 16 + np.asarray(b.column("depth"), np.int64)
            for one in np.unique(kind):
                part = b.filter(pa.array(kind == one))
                dim, depth, n = int(one) // 16, int(one) % 16, part.num_rows
                fixed = [*(part.column(c) for c in ("label", "rep", "copies", "e", "dim"))]
                names = ["label", "rep", "copies", "e", "dim", "block", "cell"]
                row = lambda block, cell, fixed=fixed, n=n, depth=depth: pa.RecordBatch.from_arrays([*fixed, pa.array(np.full(n, block, np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * depth), pa.array(cell.ravel().astype(np.int32)))], names)
                if not depth:
                    yield row(-1, np.zeros(0))
                    continue
                _, rot = unit_rotated(matrix(part.column("e")))
                edges, size = block_edges(dim), np.sqrt(budget(dim, threshold))
                for k in range(len(edges) - 1):
                    yield row(k, np.floor(rot[:, edges[k] : edges[k] + depth] / size))

    cells = sized.mapInArrow(to_cells, f"label {l_type}, rep {i_type}, copies long, e {e_type}, dim int, block int, cell array<int>")
    where = ["label", "dim", "block", "cell"]
    dense = saved(cells.groupBy(*where).count().where(F.col("count") > cell_rows).withColumn("chunks", F.ceil(F.col("count") / cell_rows).cast("int")).drop("count"))
    tiles = in_tiles(cells, dense, where)

    def link(table: pa.Table) -> pa.Table:
        x = matrix(table.column("e"))
        unit, rot = unit_rotated(x)
        home = np.asarray(table.column("home").combine_chunks())
        ids, copies = table.column("rep"), np.asarray(table.column("copies").combine_chunks(), np.int64)
        dim, block = int(table.column("dim")[0].as_py()), int(table.column("block")[0].as_py())
        h, o = np.flatnonzero(home), np.flatnonzero(~home)
        chunk, off, source = (table.column(c)[0].as_py() for c in ("chunk", "off", "source"))
        own = not any(off) and source == chunk
        blocks = [block] if block >= 0 else list(range(len(block_edges(dim)) - 1))
        n_links, left, right = np.zeros(len(x), np.int64), [], []
        for block, (other, same) in itertools.product(blocks, ((h, True), (o, False)) if own else ((o, False),)):
            for i, j in pairs_in(rot, h, other, block, block_edges(dim), budget(dim, threshold), same):
                ok = np.zeros(len(i), bool)
                for s in range(0, len(i), 1 << 16):
                    ok[s : s + (1 << 16)] = (unit[i[s : s + (1 << 16)]] * unit[j[s : s + (1 << 16)]]).sum(axis=1) >= threshold
                i, j = i[ok], j[ok]
                n_links += np.bincount(i, weights=copies[j], minlength=len(x)).astype(np.int64) + np.bincount(j, weights=copies[i], minlength=len(x)).astype(np.int64)
                left.append(i)
                right.append(j)
        low = forest(len(x), np.concatenate(left), np.concatenate(right)) if left else np.arange(len(x))
        some = np.flatnonzero(n_links)
        return pa.table({"a": ids.take(pa.array(some)), "b": ids.take(pa.array(low[some])), "n": pa.array(n_links[some])})

    found = saved(tiles.groupBy(*where, "chunk", "off", "source").applyInArrow(link, f"a {i_type}, b {i_type}, n long"))
    comp = connected_components(found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    facts = saved(reps.join(counts, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left").select("key", F.col("label").alias("_q_l"), F.col("e").alias("_q_e"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    joined = keyed.join(facts, (F.col("_q_key") == F.col("key")) & label.eqNullSafe(F.col("_q_l")) & vec.eqNullSafe(F.col("_q_e")), "left")
    comp_id = F.coalesce("component_id", ident)
    return joined.select(*[F.col(f"`{c}`") for c in base.columns], F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(ident == comp_id, F.lit(True)).alias("kept"))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", *RESULT)


QUERIES = {"op6_embedding_dedup": op6_embedding_dedup}
SQL: dict[str, str] = {}
