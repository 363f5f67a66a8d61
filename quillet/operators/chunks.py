"""Chunks of documents and the query-aware choice among them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import HashingTF, Normalizer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillet.functions.ranks import exact_percentile, global_rank
from quillet.functions.shared import saved

#: Numbers in a block of queries (32 MB), pairs that a task compares at once (32 MB), and pairs that it gives out at once.
QUERY_VALUES = 4_000_000
PAIRS = 4_000_000
ROWS = 100_000


def chunk_array(text: Column, size: int = 500, overlap: int = 50) -> Column:
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the chunk size")
    last = F.greatest(F.ceil((F.length(text) - size) / F.lit(float(size - overlap))), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * (size - overlap) + 1, F.lit(size)))


def chunk_documents(docs: DataFrame, size: int = 500, overlap: int = 50, text_col: str = "doc_text") -> DataFrame:
    """(doc_id, chunk_index, chunk); a short or null text is one chunk."""
    return docs.select("doc_id", F.posexplode(chunk_array(F.coalesce(F.col(text_col), F.lit("")), size, overlap)).alias("chunk_index", "chunk"))


def augment_query(queries: DataFrame, terms: int = 10) -> DataFrame:
    """Vague queries (under 20 characters or five words) get their attributes as context."""
    words = F.size(F.filter(F.split("query", r"\s+"), lambda w: w != ""))
    context = F.concat("query", F.lit("\n\nContext: "), F.array_join(F.slice("attributes", 1, terms), ", "))
    return queries.withColumn("query", F.when(((F.length("query") < 20) | (words < 5)) & (F.size("attributes") > 0), context).otherwise(F.col("query")))


def embed(df: DataFrame, text_col: str, fn: Callable | None = None, schema: str | None = None, dim: int = 256) -> DataFrame:
    """Vectors of texts by a user's batch function, or hashed and normalised word counts."""
    if fn is not None:
        return df.mapInPandas(fn, schema)
    t = Tokenizer(inputCol=text_col, outputCol="_words").transform(df)
    v = Normalizer(inputCol="_tf", outputCol="_unit").transform(HashingTF(numFeatures=dim, inputCol="_words", outputCol="_tf").transform(t))
    return v.withColumn("embedding", vector_to_array("_unit")).drop("_words", "_tf", "_unit")


def feature_list(schema: DataFrame, *keys: str, order: str, name: str) -> DataFrame:
    """(keys.., features): names of a schema's entries in their order, the features that a query asks for."""
    entries = F.sort_array(F.collect_list(F.struct(order, name)))
    return schema.groupBy(*keys).agg(F.array_join(F.transform(entries, lambda x: x[name]), ",").alias("features"))


def _numbered(chunks: DataFrame) -> DataFrame:
    """Chunks with ``n_chunks``, the number of chunks of their document."""
    return chunks.withColumn("n_chunks", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))


def _query_blocks(queries: DataFrame, values: int) -> Iterator[pa.Table]:
    """Queries in blocks of at most ``values`` numbers, each small enough to hand to every task."""
    first = queries.where(F.col("query_vec").isNotNull()).select(F.size("query_vec")).first()
    if first is None:
        return
    rows = max(1, values // max(1, first[0]))
    q = queries.where(F.col("query_vec").isNotNull()).withColumn("query_vec", F.col("query_vec").cast("array<double>"))
    n = q.count()
    if n <= rows:
        yield q.toArrow()
        return
    placed = saved(global_rank(q, *[c for c in queries.columns if c != "query_vec"], name="_place"))
    for at in range(0, n, rows):
        yield placed.where((F.col("_place") >= at) & (F.col("_place") < at + rows)).drop("_place").toArrow()


def _similarities(vectors: pa.Array, q: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Cosines of a batch of vectors with a block of queries: one matrix product; NaN for rows without a vector."""
    some = np.flatnonzero(np.asarray(pc.is_valid(vectors)))
    out = np.full((len(vectors), len(q)), np.nan)
    if len(some):
        v = np.asarray(pc.list_flatten(vectors), np.float64).reshape(len(some), -1)
        both = np.sqrt((v * v).sum(axis=1))[:, None] * sizes[None, :]
        out[some] = np.divide(v @ q.T, both, out=np.zeros_like(both), where=both > 0)
    return out


def _against(chunks: DataFrame, columns: list[str], queries: DataFrame, values: int, schema: str, each: Callable) -> DataFrame:
    """``each`` (batch, query keys, similarities) of every batch of chunks and every block of queries, a pass for each block."""
    d = _numbered(chunks).select(*columns, "n_chunks", F.col("embedding").cast("array<double>").alias("embedding"))
    out = None
    for block in _query_blocks(queries, values):
        shared = chunks.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value.combine_chunks()
            vectors = block.column("query_vec").combine_chunks()
            q = np.asarray(pc.list_flatten(vectors), np.float64).reshape(block.num_rows, -1)
            keys, sizes = block.drop_columns(["query_vec"]), np.sqrt((q * q).sum(axis=1))
            step = max(1, PAIRS // len(q))
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    b = whole.slice(at, step)
                    yield from each(b, keys, _similarities(b.column(b.num_columns - 1), q, sizes))

        own = d.mapInArrow(run, schema)
        out = own if out is None else out.union(own)
    return chunks.sparkSession.createDataFrame([], schema) if out is None else out


def _types(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def _pairs(chunks: DataFrame, queries: DataFrame, threshold: float, query_values: int, whole: bool) -> DataFrame:
    """(query keys.., chunk columns.., sim, kept) of every pair if ``whole``, else of the kept ones."""
    keys, own = [c for c in queries.columns if c != "query_vec"], [c for c in chunks.columns if c != "embedding"]

    def each(b: pa.RecordBatch, q: pa.Table, sim: np.ndarray) -> Iterator[pa.RecordBatch]:
        kept = (sim >= threshold) | ((np.asarray(b.column("n_chunks")) == 1) | np.isnan(sim).all(axis=1))[:, None]
        row, at = np.nonzero(np.ones_like(kept) if whole else kept)
        for i in range(0, max(1, len(row)), ROWS):
            r, k = row[i : i + ROWS], at[i : i + ROWS]
            found, rows = q.take(pa.array(k)).combine_chunks(), b.take(pa.array(r))
            yield pa.RecordBatch.from_arrays([*[found.column(c).combine_chunks() for c in keys], *[rows.column(c) for c in own], pa.array(sim[r, k], from_pandas=True), pa.array(kept[r, k])], [*keys, *own, "sim", "kept"])

    return _against(chunks, own, queries, query_values, ", ".join(x for x in (_types(queries, keys), _types(chunks, own), "sim double, kept boolean") if x), each)


def filter_chunks(chunks: DataFrame, queries: DataFrame, threshold: float, query_values: int = QUERY_VALUES) -> DataFrame:
    """(query keys.., chunk columns.., sim) of the chunks kept for each query, and of no others: those with a cosine of at
    least ``threshold``, a document's only chunk (untested) and chunks without a vector. ``queries``: ``query_vec`` and any keys.

    Every batch of chunks meets every query in a matrix product; what is dropped leaves no row. Queries beyond ``query_values``
    numbers are taken block by block, each with a pass over the chunks."""
    return _pairs(chunks, queries, threshold, query_values, False).drop("kept")


def chunk_verdicts(chunks: DataFrame, queries: DataFrame, threshold: float, query_values: int = QUERY_VALUES) -> DataFrame:
    """As ``filter_chunks``, with ``kept`` and a row for every pair of a query and a chunk."""
    return _pairs(chunks, queries, threshold, query_values, True)


def filter_statistics(chunks: DataFrame, queries: DataFrame, threshold: float, query_values: int = QUERY_VALUES) -> DataFrame:
    """(query keys.., doc_id, num_chunks, num_kept, num_dropped, min_sim, max_sim, avg_sim). Batches are folded by document
    before the shuffle, a row for each query and document of a batch."""
    keys = [c for c in queries.columns if c != "query_vec"]

    def each(b: pa.RecordBatch, q: pa.Table, sim: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = b.column("doc_id").dictionary_encode()
        doc = np.asarray(ids.indices)
        by = np.argsort(doc, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], np.diff(doc[by]) != 0])) if len(doc) else np.zeros(0, np.int64)
        none = np.isnan(sim)
        kept = (sim >= threshold) | ((np.asarray(b.column("n_chunks")) == 1) | none.all(axis=1))[:, None]
        fold = lambda f, x: f.reduceat(x[by], start, axis=0).ravel() if len(start) else np.zeros(0)
        n_docs, n_queries = len(start), q.num_rows
        found = q.take(pa.array(np.tile(np.arange(n_queries), n_docs))).combine_chunks()
        seen = fold(np.add, (~none).astype(np.int64))
        low, high = fold(np.minimum, np.where(none, np.inf, sim)), fold(np.maximum, np.where(none, -np.inf, sim))
        columns = [fold(np.add, np.ones(sim.shape, np.int64)), fold(np.add, kept.astype(np.int64)), seen]
        columns += [pa.array(low, mask=seen == 0), pa.array(high, mask=seen == 0), fold(np.add, np.where(none, 0.0, sim))]
        doc_ids = ids.dictionary.take(pa.array(np.repeat(doc[by][start], n_queries)))
        yield pa.RecordBatch.from_arrays([*[found.column(c).combine_chunks() for c in keys], doc_ids, *[pa.array(c) if isinstance(c, np.ndarray) else c for c in columns]], [*keys, "doc_id", "n", "k", "seen", "low", "high", "total"])

    schema = f"{_types(queries, keys)}, {_types(chunks, ['doc_id'])}, n long, k long, seen long, low double, high double, total double"
    d = _against(chunks, ["doc_id"], queries, query_values, schema, each).groupBy(*keys, "doc_id")
    n, k = F.sum("n"), F.sum("k")
    return d.agg(n.alias("num_chunks"), k.alias("num_kept"), (n - k).alias("num_dropped"), F.min("low").alias("min_sim"), F.max("high").alias("max_sim"), (F.sum("total") / F.nullif(F.sum("seen"), F.lit(0))).alias("avg_sim"))


def reassemble(kept: DataFrame, documents: DataFrame, *keys: str) -> DataFrame:
    """(keys.., doc_id, doc_text): kept chunks in order, joined by an empty line. ``documents``: (keys.., doc_id) of all that
    were filtered, as the statistics have them; one without a kept chunk gets an empty text."""
    parts = kept.groupBy(*keys, "doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk"))).alias("_parts"))
    d = documents.select(*keys, "doc_id").join(parts, [*keys, "doc_id"], "left")
    return d.select(*keys, "doc_id", F.coalesce(F.array_join(F.transform("_parts", lambda x: x["chunk"]), "\n\n"), F.lit("")).alias("doc_text"))


def calibrate_threshold(pairs: DataFrame, recall: float = 0.95, default: float = 0.5) -> DataFrame:
    """One row ``threshold``: the exact (1 - recall) percentile of the similarities of relevant pairs (``default`` without any)."""
    found = exact_percentile(pairs.where("is_relevant"), "sim", 1 - recall)
    return pairs.sparkSession.createDataFrame([(default if found is None else found,)], "threshold double")
