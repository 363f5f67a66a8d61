"""Reading, normalising, comparing and writing document collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillet.functions.ranks import global_rank

DOCUMENT = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.StringType()), ("doc_text", T.StringType()), ("source_file", T.StringType()), ("parent_doc_id", T.StringType()), ("chunk_index", T.IntegerType()), ("ord", T.LongType()))])


def read_documents(spark: SparkSession, path: str | None = None, fmt: str = "parquet", **options: str) -> DataFrame:
    """Documents with the columns of ``DOCUMENT``, matched by name; those that the source lacks are null. The order is ``ord``,
    else the id. Csv has a header, and quoted texts may hold line ends and doubled quotes; json is a line a document;
    ``options`` go to the reader (jdbc: ``url`` and ``dbtable``, without a path)."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.options(header="true", multiLine="true", escape='"')
    elif fmt == "json":
        reader = reader.schema(DOCUMENT)
    raw = reader.options(**options).load(path) if path else reader.options(**options).load()
    cols = [F.col(f.name).cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType) for f in DOCUMENT]
    out = raw.select(*[c.alias(f.name) for c, f in zip(cols, DOCUMENT, strict=True)])
    return out.withColumn("ord", F.coalesce("ord", F.expr("try_cast(split_part(doc_id, '-', 1) AS bigint)")))


def in_order(docs: DataFrame) -> DataFrame:
    """Numbers before text: ids that are whole numbers sort by value."""
    return docs.orderBy(F.expr("try_cast(doc_id AS bigint)").asc_nulls_last(), "doc_id")


def numbered(docs: DataFrame) -> DataFrame:
    """Documents with ``place``, their 0-based place in the order of ``in_order``."""
    n = F.expr("try_cast(doc_id AS bigint)")
    return global_rank(docs.withColumn("_text", n.isNull()).withColumn("_value", n), "_text", "_value", "doc_id", name="place").drop("_text", "_value")


def resolve_text(docs: DataFrame, files: DataFrame) -> DataFrame:
    """Documents whose empty text comes from their file; ``files``: (path, text). Missing files give an empty text."""
    own = F.when(F.col("doc_text") != "", F.col("doc_text"))
    return docs.join(files.select(F.col("path").alias("source_file"), F.col("text").alias("_file_text")), "source_file", "left").withColumn("doc_text", F.coalesce(own, "_file_text", F.lit(""))).drop("_file_text")


def read_text_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of all files below a folder, one row a file; the path is relative to the folder. Spark names files by
    escaped addresses: a "+" is kept and the rest is decoded before the folder's own name is cut off."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    folder = F.lit(f"{root.rstrip('/')}/")
    return raw.select(F.substr(path, F.instr(path, folder) + F.length(folder)).alias("path"), F.col("value").alias("text"))


def normalize_documents(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """(n, doc_text, table_name, raw_id) from the three layouts of one JSON object of documents: an object with ``doc``
    or ``doc_text``, a list of text, table and id, or a bare text."""
    entry = raw.select(F.explode(F.from_json(json_col, "map<string,string>")).alias("n", "v"))
    obj, arr = F.from_json("v", "map<string,string>"), F.from_json("v", "array<string>")
    is_obj, is_arr = F.col("v").startswith("{"), F.col("v").startswith("[")
    text = F.when(is_obj, F.coalesce(F.element_at(obj, "doc"), F.element_at(obj, "doc_text"))).when(is_arr, F.get(arr, F.lit(0))).otherwise(F.col("v"))
    name = F.when(is_obj, F.coalesce(F.element_at(obj, "table_name"), F.element_at(obj, "fn"))).when(is_arr, F.get(arr, F.lit(1)))
    return entry.select("n", F.coalesce(text, F.lit("")).alias("doc_text"), F.coalesce(name, F.lit("")).alias("table_name"), F.when(is_arr, F.get(arr, F.lit(2))).alias("raw_id"))


def document_info(docs: DataFrame, mapping: DataFrame, truth: DataFrame) -> DataFrame:
    """Documents with their ordered ground-truth records; mapped rows that don't exist are left out. ``truth``: (table_name, row_id, data map)."""
    records = mapping.join(truth, ["table_name", "row_id"]).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("table_name", "row_id", F.map_entries("data").alias("data")))).alias("records"))
    return docs.join(records, "doc_id", "left").withColumn("n_records", F.coalesce(F.size("records"), F.lit(0)))


def read_queries(raw: DataFrame) -> DataFrame:
    """Queries with their attributes as an array; an unparsable list stays as one raw text. Both spellings of difficulty are read."""
    hard = [F.col(c) for c in ("difficulty", "diffculty") if c in raw.columns]
    parsed = F.from_json("attributes", "array<string>")
    return raw.select("query_id", "query", F.coalesce(parsed, F.array("attributes")).alias("attributes"), F.col("sql") if "sql" in raw.columns else F.lit(None).cast("string").alias("sql"), (F.coalesce(*hard) if hard else F.lit(None).cast("string")).alias("difficulty"))


def schema_catalog(schemas: DataFrame, attributes: DataFrame, query_id: str | None = None) -> DataFrame:
    """(schema_name, attributes) of the general schema (no query) or of one query, attributes in their order ``ord``."""
    mine = F.col("query_id").isNull() if query_id is None else F.col("query_id") == query_id
    a = attributes.where(mine).groupBy("schema_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "attribute_name", "description"))), lambda x: F.struct(x["attribute_name"].alias("name"), x["description"].alias("description"))).alias("attributes"))
    return schemas.where(mine).select("schema_name").join(a, "schema_name", "left")


def schema_attributes(catalog: DataFrame, name: str) -> DataFrame:
    """Attribute names of one schema, one a row."""
    return catalog.where(F.col("schema_name") == name).select(F.explode("attributes").alias("a")).select(F.col("a.name").alias("attribute_name"))


def lookup(df: DataFrame, key: str, value: str | int, *columns: str) -> DataFrame:
    """The rows of one key; the filter reaches the scan."""
    return df.where(F.col(key) == value).select(*columns)


def dataset_summary(docs: DataFrame, queries: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row: numbers of documents and queries, and whether there are schemas."""
    d, q, s = (x.agg(F.count(F.lit(1)).alias(n)) for x, n in ((docs, "n_documents"), (queries, "n_queries"), (schemas, "n_schemas")))
    return d.crossJoin(q).crossJoin(s).select("n_documents", "n_queries", (F.col("n_schemas") > 0).alias("has_schemas"))


def clean_name(c: Column) -> Column:
    return F.regexp_replace(c, "[- ]", "_")


def convert_dataset(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents ({n}-0) and their mapping to rows, numbered from 0 inside each table in document order.

    The number of a row is its rank in (table, document) order less that of its table's first row.
    """
    n = normalized.withColumn("ord", F.expr("try_cast(n AS bigint)"))
    docs = n.select(F.concat("n", F.lit("-0")).alias("doc_id"), "doc_text", "ord")
    ranked = global_rank(n.where("table_name <> ''").select("n", "ord", clean_name(F.col("table_name")).alias("table_name")), "table_name", "ord")
    start = ranked.groupBy("table_name").agg(F.min("rank").alias("start"))
    mapping = ranked.join(start, "table_name").select(F.concat("n", F.lit("-0")).alias("doc_id"), "table_name", (F.col("rank") - F.col("start")).cast("string").alias("row_id"), F.lit("full").alias("match_type"))
    return docs, mapping


def compare_datasets(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-5) -> DataFrame:
    """(keys, attr, left, right, kind) of what differs: keys of one side alone, and values that are neither equal nor close numbers."""
    values = [c for c in a.columns if c not in keys]
    long = lambda d: d.select(*keys, F.explode(F.create_map(*[x for c in values for x in (F.lit(c), F.col(c).cast("string"))])).alias("attr", "v"))
    x, y = long(a).withColumnRenamed("v", "left"), long(b).withColumnRenamed("v", "right")
    both = x.withColumn("in_a", F.lit(True)).join(y.withColumn("in_b", F.lit(True)), [*keys, "attr"], "full_outer")
    l, r = F.expr("try_cast(left AS double)"), F.expr("try_cast(right AS double)")
    close = F.abs(l - r) <= F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs(l), F.abs(r))
    kind = F.when(F.col("in_b").isNull(), "missing right").when(F.col("in_a").isNull(), "missing left").when(~(F.col("left").eqNullSafe(F.col("right")) | F.coalesce(close, F.lit(False))), "value")
    return both.withColumn("kind", kind).where("kind is not null").select(*keys, "attr", "left", "right", "kind")


def write_population(df: DataFrame, path: str, mode: str = "append") -> None:
    """Populated rows, one folder for each dataset, query and parameter setting."""
    df.write.mode(mode).partitionBy("dataset", "query_id", "param").parquet(path)


def pending(docs: DataFrame, done: DataFrame) -> DataFrame:
    """Documents without a stored result."""
    return docs.join(done.select("doc_id"), "doc_id", "left_anti")


def read_name_map(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """(gt_table, pred_attr, gt_attrs) from a name map whose targets are one name or a list of names."""
    tables = raw.select(F.explode(F.from_json(json_col, "struct<attribute:map<string,map<string,string>>>")["attribute"]).alias("gt_table", "m"))
    one = tables.select("gt_table", F.explode("m").alias("pred_attr", "target"))
    return one.select("gt_table", "pred_attr", F.coalesce(F.when(F.col("target").startswith("["), F.from_json("target", "array<string>")), F.array("target")).alias("gt_attrs"))
