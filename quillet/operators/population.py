"""From raw model responses to validated rows and typed relations."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillet.functions.literals import object_map
from quillet.functions.nulls import is_none_value
from quillet.functions.shared import small_side

TABLE_TARGET = "__table__"
MISSING = "None"
OVERLONG = 100
ATTEMPTS = 11
SCHEMA_ROWS = 100_000


def extract_json(raw: Column) -> Column:
    """First non-empty object of a raw response, as a map of texts: a fenced JSON block, a fenced object, any object in the
    text, the whole text; JSON or the literal of a Python dict (``quillet.functions.literals``)."""
    return object_map(raw)


def parsed_responses(responses: DataFrame) -> DataFrame:
    """Responses with ``obj``, their object, instead of the raw text. The generator keeps later filters from copying the
    extraction into themselves, so it runs once for each response."""
    return responses.select(*[c for c in responses.columns if c != "raw_text"], F.explode(F.array(extract_json(F.col("raw_text")))).alias("obj"))


def _value(obj: Column, key: Column | str) -> Column:
    """A value as it is stored: missing ones, of any spelling, are 'None'."""
    v = F.element_at(obj, key)
    return F.when(is_none_value(v), F.lit(MISSING)).otherwise(v)


def _names_table(tables: Iterable[str], key: str) -> Column:
    v = F.element_at("obj", key)
    return (F.col("target") == TABLE_TARGET) & F.map_contains_key("obj", key) & (v.isin(*tables) | is_none_value(v))


def resolve_tables(responses: DataFrame, tables: Iterable[str], key: str = "res", max_attempts: int = ATTEMPTS) -> DataFrame:
    """(doc_id, query_id, res): the first attempt that names a known table or none; documents without one are left out."""
    r = parsed_responses(responses.where((F.col("target") == TABLE_TARGET) & (F.col("attempt") < max_attempts))).where(_names_table(tables, key))
    picked = r.groupBy("doc_id", "query_id").agg(F.min_by(_value(F.col("obj"), key), "attempt").alias("value"))
    return picked.select("doc_id", "query_id", F.when(F.col("value") != MISSING, F.col("value")).alias("res"))


def resolve_attributes(responses: DataFrame, assigned: DataFrame, schema: DataFrame, max_attempts: int = ATTEMPTS) -> DataFrame:
    """(doc_id, query_id, res, attr, value) for the attributes of each document's table; ``schema``: (query_id, table_name, attr).

    The first attempt that has the attribute counts; where none of them has it, or its value is a missing one, it is 'None'.
    """
    wanted = assigned.join(schema, (assigned["query_id"] == schema["query_id"]) & (assigned["res"] == schema["table_name"])).select(assigned["doc_id"], assigned["query_id"], "res", "attr")
    r = parsed_responses(responses.where((F.col("target") != TABLE_TARGET) & (F.col("attempt") < max_attempts))).where(F.map_contains_key("obj", F.col("target")))
    found = r.groupBy("doc_id", "query_id", F.col("target").alias("attr")).agg(F.min_by(_value(F.col("obj"), F.col("target")), "attempt").alias("value"))
    return wanted.join(found, ["doc_id", "query_id", "attr"], "left").select("doc_id", "query_id", "res", "attr", F.coalesce("value", F.lit(MISSING)).alias("value"))


def assemble_rows(assigned: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, query_id, res, data, overlong): one row for each document; data maps attributes to values."""
    data = values.groupBy("doc_id", "query_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("attr", "value")))).alias("data"), F.max(F.length("value") > OVERLONG).alias("overlong"))
    return assigned.join(data, ["doc_id", "query_id"], "left").select("doc_id", "query_id", "res", F.coalesce("data", F.create_map().cast("map<string,string>")).alias("data"), F.coalesce("overlong", F.lit(False)).alias("overlong"))


def populate(responses: DataFrame, tables: Iterable[str], schema: DataFrame, key: str = "res", max_attempts: int = ATTEMPTS) -> DataFrame:
    """``assemble_rows`` over ``resolve_tables`` and ``resolve_attributes`` in one pass: each response is read and parsed
    once, and one shuffle brings a document's responses together. ``schema`` has a row for each attribute of a table of a query."""
    r = parsed_responses(responses.where(F.col("attempt") < max_attempts))
    is_table = F.col("target") == TABLE_TARGET
    valid, has = _names_table(tables, key), ~is_table & F.map_contains_key("obj", F.col("target"))
    r = r.where(valid | has).select("doc_id", "query_id", "attempt", "target", F.when(is_table, _value(F.col("obj"), key)).otherwise(_value(F.col("obj"), F.col("target"))).alias("value"))
    table = F.min_by(F.when(is_table, F.col("value")), F.when(is_table, F.col("attempt")))
    found = F.sort_array(F.collect_list(F.when(~is_table, F.struct("target", "attempt", "value"))))
    d = r.groupBy("doc_id", "query_id").agg(table.alias("value"), found.alias("found"), F.max(is_table).alias("assigned")).where("assigned")
    d = d.select("doc_id", "query_id", F.when(F.col("value") != MISSING, F.col("value")).alias("res"), "found")
    wanted = schema.groupBy(F.col("query_id").alias("_q"), F.col("table_name").alias("_t")).agg(F.sort_array(F.collect_set("attr")).alias("attrs"))
    d = d.join(small_side(wanted, SCHEMA_ROWS), (F.col("query_id") == F.col("_q")) & (F.col("res") == F.col("_t")), "left")
    first = lambda a: F.coalesce(F.get(F.filter("found", lambda x: x["target"] == a), F.lit(0))["value"], F.lit(MISSING))
    pairs = F.coalesce(F.transform("attrs", lambda a: F.struct(a.alias("attr"), first(a).alias("value"))), F.array().cast("array<struct<attr:string,value:string>>"))
    return d.select("doc_id", "query_id", "res", F.map_from_entries(pairs).alias("data"), F.exists(pairs, lambda p: F.length(p["value"]) > OVERLONG).alias("overlong"))


def to_table(population: DataFrame, name: str, types: dict[str, str]) -> DataFrame:
    """The typed relation of one table; missing and uncastable values are null."""
    rows = population.where(F.col("res") == name).select(*[F.col("data")[a].alias(a) for a in types])
    return rows.select(*[F.when(~is_none_value(F.col(a)), F.col(a)).try_cast(t).alias(a) for a, t in types.items()])


def extract_with(docs: DataFrame, fn: Callable, schema: str, partitions: int | None = None) -> DataFrame:
    """Run a user's batch function (iterator of pandas frames to iterator of pandas frames) over documents."""
    d = docs.repartition(partitions) if partitions else docs
    return d.mapInPandas(fn, schema)


def extract_by_patterns(docs: DataFrame, patterns: dict[str, str], text_col: str = "doc_text") -> DataFrame:
    """The native default extractor: one regular expression an attribute, its first group as value, 'None' without a match."""
    found = lambda p: F.regexp_extract(F.col(text_col), p, 1)
    return docs.select("doc_id", *[F.when(found(p) != "", found(p)).otherwise(F.lit("None")).alias(a) for a, p in patterns.items()])


def single_shot(responses: DataFrame) -> DataFrame:
    """(doc_id, data) from responses that hold table and values at once, as one object or a list of objects (later ones win)."""
    many = F.from_json(F.regexp_extract("raw_text", r"(?s)(\[.*\])", 1), T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    entries = F.flatten(F.transform(F.coalesce(many, F.array(extract_json(F.col("raw_text")))), lambda m: F.map_entries(m)))
    last = F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, v: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))
    return responses.select("doc_id", last.alias("data"))
