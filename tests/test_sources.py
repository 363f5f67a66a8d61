"""A small collection: three documents, many-to-many mapping, queries and schemas."""

import os

import pytest
from pyspark.sql import functions as F

from quillet.functions import shared
from quillet.sources import documents as D
from quillet.streaming.resume import populate_stream, stored


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("m7", "minutes of the board", "x/one.md"), ("m8", "", "x/two words +1.md"), ("m9", None, "x/none.md")], "doc_id string, doc_text string, source_file string")


def test_text_from_files(spark, docs, tmp_path):
    root = tmp_path / "a (b).c+d e"
    (root / "x").mkdir(parents=True)
    (root / "x" / "two words +1.md").write_text("from file\nsecond line")
    files = D.read_text_files(spark, str(root))
    got = {r.doc_id: r.doc_text for r in D.resolve_text(docs, files).collect()}
    assert got == {"m7": "minutes of the board", "m8": "from file\nsecond line", "m9": ""}


def test_document_info(spark, docs):
    mapping = spark.createDataFrame([("m7", "motions", "31"), ("m7", "motions", "32"), ("m8", "motions", "32"), ("m8", "motions", "99")], "doc_id string, table_name string, row_id string")
    truth = spark.createDataFrame([("motions", "31", {"title": "roof"}), ("motions", "32", {"title": "fence"})], "table_name string, row_id string, data map<string,string>")
    got = {r.doc_id: r for r in D.document_info(docs, mapping, truth).collect()}
    assert [x.row_id for x in got["m7"].records] == ["31", "32"]
    assert got["m8"].n_records == 1 and got["m9"].n_records == 0


def test_queries_and_schemas(spark):
    raw = spark.createDataFrame([("u1", "which motions passed", '["title","votes"]', "easy"), ("u2", "who spoke", "speaker", None)], "query_id string, query string, attributes string, diffculty string")
    q = {r.query_id: r for r in D.read_queries(raw).collect()}
    assert q["u1"].attributes == ["title", "votes"] and q["u1"].difficulty == "easy" and q["u2"].attributes == ["speaker"]
    schemas = spark.createDataFrame([("motions", None), ("motions", "u1")], "schema_name string, query_id string")
    attrs = spark.createDataFrame([("motions", "title", "t", None, 1), ("motions", "votes", "v", None, 2), ("motions", "votes", "v", "u1", 1)], "schema_name string, attribute_name string, description string, query_id string, ord int")
    assert [a.name for a in D.schema_catalog(schemas, attrs).first().attributes] == ["title", "votes"]
    assert [r.attribute_name for r in D.schema_attributes(D.schema_catalog(schemas, attrs, "u1"), "motions").collect()] == ["votes"]


def test_layouts_and_order(spark):
    raw = spark.createDataFrame([('{"0": {"doc_text": "a", "fn": "t-1"}, "1": ["b", "t 2", "r"], "2": "c", "10": {"doc": "d"}}',)], "json string")
    n = D.normalize_documents(raw)
    assert {(r.n, r.doc_text, r.table_name, r.raw_id) for r in n.collect()} == {("0", "a", "t-1", None), ("1", "b", "t 2", "r"), ("2", "c", "", None), ("10", "d", "", None)}
    docs, mapping = D.convert_dataset(n)
    assert {(r.doc_id, r.table_name, r.row_id) for r in mapping.collect()} == {("0-0", "t_1", "0"), ("1-0", "t_2", "0")}
    assert [r.n for r in D.in_order(n.withColumnRenamed("n", "doc_id")).withColumnRenamed("doc_id", "n").collect()] == ["0", "1", "2", "10"]


def test_sink_and_stream(spark, tmp_path):
    d = spark.createDataFrame([("d", "q", "p", "1")], "dataset string, query_id string, param string, doc_id string")
    D.write_population(d, str(tmp_path / "out"))
    assert (tmp_path / "out" / "dataset=d" / "query_id=q" / "param=p").is_dir()
    rows = spark.createDataFrame([("1", "x", None, None, 0, 1), ("1", "x", None, None, 0, 1), ("2", "y", None, None, 0, 2)], D.DOCUMENT)
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        populate_stream(spark, str(tmp_path / "in"), str(tmp_path / "res"), str(tmp_path / "ck"), lambda df: df.select("doc_id", F.upper("doc_text").alias("v"))).awaitTermination()
    assert sorted(tuple(r) for r in stored(spark, str(tmp_path / "res")).collect()) == [("1", "X"), ("2", "Y")]


def test_stopped_stream_goes_on(spark, tmp_path):
    """A batch that fails after it has written, or half way, runs again and replaces its rows; ids of earlier deliveries come from
    the state, also where what is stored is gone."""
    rows = lambda ids: spark.createDataFrame([(str(i), f"t{i}", None, None, 0, i) for i in ids], D.DOCUMENT)
    out, paths, fail = str(tmp_path / "res"), [str(tmp_path / p) for p in ("in", "res", "ck")], [True]

    def populate(df):
        if fail[0]:
            df.select("doc_id").write.mode("overwrite").parquet(f"{out}/_batch=0")
            raise RuntimeError("stopped")
        return df.select("doc_id", F.upper("doc_text").alias("v"))

    rows([1, 2, 2, 3]).write.parquet(paths[0])
    with pytest.raises(Exception, match="stopped"):
        populate_stream(spark, *paths, populate).awaitTermination()
    fail[0] = False
    populate_stream(spark, *paths, populate).awaitTermination()
    rows([3, 4, 1, 5]).write.mode("append").parquet(paths[0])
    populate_stream(spark, *paths, populate).awaitTermination()
    populate_stream(spark, *paths, populate).awaitTermination()
    assert sorted(tuple(r) for r in stored(spark, out).collect()) == [(str(i), f"T{i}") for i in range(1, 6)]


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text('doc_text,doc_id,other\n"two\nlines, ""quoted""",7,x\nplain,8-0,y\n')
    (tmp_path / "a.json").write_text('{"doc_id": "7", "doc_text": "two\\nlines", "ord": 3}\n{"doc_id": "x"}\n')
    assert sorted((r.doc_id, r.doc_text, r.ord, r.source_file) for r in D.read_documents(spark, str(tmp_path / "a.csv"), "csv").collect()) == [("7", 'two\nlines, "quoted"', 7, None), ("8-0", "plain", 8, None)]
    assert sorted((r.doc_id, r.doc_text, r.ord) for r in D.read_documents(spark, str(tmp_path / "a.json"), "json").collect()) == [("7", "two\nlines", 3), ("x", None, None)]


def test_saved_tables_are_dropped(spark):
    kept = shared.saved(spark.range(3))
    path = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert kept.count() == 3 and os.path.isdir(path) and shared.drop_saved(spark) > 0
    assert not os.path.exists(path) and shared.drop_saved(spark) == 0
