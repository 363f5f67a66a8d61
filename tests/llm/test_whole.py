"""Work that is split is still whole: bounded groups, and the results of the unsplit job."""

import itertools
import random

from pyspark.sql import functions as F

from quillet.llm import embedding_dedup
from quillet.llm.near_dedup import BUCKETS, SKETCHES, in_blocks, in_tiles, near_dedup


def test_near_dedup_split_buckets(spark):
    """Chains of near copies, where only neighbours are similar, in buckets far larger than a block."""
    rng = random.Random(3)
    docs, want = [], {}
    for chain in range(3):
        words = [f"w{chain}x{i}" for i in range(200)]
        first = len(docs)
        for _ in range(60):
            words = list(words)
            words[rng.randrange(200)] = f"n{rng.random()}"
            want[len(docs)] = first
            docs.append((len(docs), " ".join(words)))
    rng.shuffle(docs)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup(d, block_rows=6).collect()} == want


def test_near_dedup_blocks_and_tiles_are_bounded(spark):
    """A bucket of 4,000 rows: every pair that is not inside its largest class meets in a tile, and no group is large."""
    sig = F.array(*[F.col("id").cast("int")] * SKETCHES)
    rows = spark.range(4000).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("rep"), sig.alias("sig"))
    assert in_blocks(rows, 200).groupBy("key").count().agg(F.max("count")).first()[0] < 400
    comp = F.when(F.col("rep") % 10 == 0, F.col("rep")).otherwise(F.lit(1))
    placed = rows.select("key", F.lit(BUCKETS - 1).alias("k"), "rep", F.lit(100).alias("n"), "sig", comp.alias("comp"))
    tiles = in_tiles(placed, 200).cache()
    assert tiles.groupBy("key").count().agg(F.max("count")).first()[0] < 700
    met = tiles.where("seeker").select("key", F.col("rep").alias("a")).join(tiles.where("not seeker").select("key", F.col("rep").alias("b")), "key")
    assert met.select("a", "b").distinct().count() == met.count() == 400 * 4000


def test_embedding_groups_are_bounded(spark):
    """A split cell between cells that are not: no group holds over two chunks, and each pair of vectors meets once."""
    places = [(0, 0)] * 900 + [(1, 1)] * 20 + [(-1, 0)] * 20 + [(1, 0)] * 300 + [(5, 5)] * 30 + [(5, 6)] * 30
    where = ["label", "dim", "block", "cell"]
    rows = spark.createDataFrame([("x", i, 8, 0, list(c)) for i, c in enumerate(places)], "label string, rep long, dim int, block int, cell array<int>")
    counts = rows.groupBy(*where).count()
    dense = counts.where("count > 100").withColumn("chunks", F.ceil(F.col("count") / 100).cast("int")).drop("count")
    tiles = embedding_dedup.in_tiles(rows, dense, where).cache()
    group = [*where, "chunk", "off", "source"]
    assert tiles.groupBy(*group).count().agg(F.max("count")).first()[0] < 300
    own = F.forall("off", lambda x: x == 0) & (F.col("source") == F.col("chunk"))
    met = tiles.alias("a").join(tiles.alias("b"), group).where(F.col("a.home") & (~F.col("b.home") | (own & (F.col("a.rep") < F.col("b.rep")))))
    met = met.select(F.least("a.rep", "b.rep").alias("i"), F.greatest("a.rep", "b.rep").alias("j")).cache()
    near = set(itertools.product((-1, 0, 1), repeat=2))
    want = sum(1 for i in range(len(places)) for j in range(i) if (places[i][0] - places[j][0], places[i][1] - places[j][1]) in near)
    assert met.distinct().count() == met.count() == want
