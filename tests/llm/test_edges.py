"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from quillet.llm.embedding_dedup import embedding_dedup
from quillet.llm.fuzzy_passages import fuzzy_passages
from quillet.llm.line_dedup import dedup_lines
from quillet.llm.lm_scoring import lm_score
from quillet.llm.mixing import mix_sources
from quillet.llm.near_dedup import near_dedup
from quillet.llm.quality_classifier import quality_classifier
from quillet.llm.quality_rules import quality_rules
from quillet.llm.sentencepiece_codec import encode_documents
from quillet.llm.toxicity import toxicity

LONG = "word " * 30_000 + "x" * 3000
ROWS = [
    (1, "the same line of words here and there\nsecond", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, "   \n\t ", "fr", "b"), (None, "no id at all", "en", "a"),
    (5, LONG, "en", "a"), (6, "the same line of words here and there\nsecond", "en", "a"), (6, "the same line of words here and there\nsecond", "en", "a"), (7, "THE same line of words here and there ", "en", "a"), (8, "é🦙 ▁ \x85 \x1c", "xx", "z"),
]
LABELS = [(1, 1, 0), (3, 1, 1), (6, 0, 1), (7, 1, 0), (None, 1, 1), (2, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    return docs, labels


OPERATORS = {
    "quality_classifier": lambda d, lab: quality_classifier(d, lab), "mixing": lambda d, lab: mix_sources(d), "sentencepiece": lambda d, lab: encode_documents(d), "fuzzy_passages": lambda d, lab: fuzzy_passages(d), "near_dedup": lambda d, lab: near_dedup(d),
    "lm_scoring": lambda d, lab: lm_score(d), "toxicity": lambda d, lab: toxicity(d, lab), "quality_rules": lambda d, lab: quality_rules(d, lab), "line_dedup": lambda d, lab: dedup_lines(d),
}
CLASH = ["kept", "score", "N_Tokens", "n_lines", "class_id", "ids", "passages", "topic", "weight", "predicted", "threshold", "_extra"]


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, tables, name):
    docs, labels = tables
    clashing = docs.select("*", *[F.lit("mine").alias(c) for c in CLASH])
    out = OPERATORS[name](clashing, labels)
    rows = out.collect()
    assert len(rows) == len(ROWS)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert all(r["_extra"] == "mine" for r in rows)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)
    by_id = {r.doc_id: r for r in rows}
    if name == "line_dedup":
        assert by_id[1].n_dropped == 1 and by_id[1].text == "second" and by_id[7].n_dropped == 0 and by_id[2].n_lines == 1
    if name == "near_dedup":
        assert by_id[6].class_id == 1 and not by_id[6].class_kept and by_id[1].class_kept and by_id[3].class_kept
    if name == "sentencepiece":
        assert by_id[2].ids is None and by_id[3].n_pieces == 0 and by_id[5].round_trip and not by_id[8].round_trip
    if name == "lm_scoring":
        assert by_id[2].n_tokens == 1 and by_id[5].n_tokens == 30_002 and by_id[3].score < 0
    if name == "quality_rules":
        assert by_id[4].n_words == 0 and by_id[4].base_failed and by_id[2].base_failed
    if name == "toxicity":
        assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, tables, name):
    docs, labels = tables
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0
    assert OPERATORS[name](docs, labels.limit(0)).count() == len(ROWS)


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], 1, "m"), (2, [2.0, 0.0], 1, "m"), (3, [1.0, 0.0], 1, "m"), (4, [1.0, 0.0], 2, "m"), (5, None, 1, "m"), (6, [0.0, 0.0], 1, "m"), (7, [float("nan"), 1.0], 1, "m"), (8, [1.0, None], 1, "m"), (9, [1.0, 0.0], None, "m"), (10, [1.0, 0.0, 0.0], 1, "m"), (11, [], 1, "m"), (3, [1.0, 0.0], 1, "m")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, kept string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup(d).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11))
    assert embedding_dedup(d.limit(0)).count() == 0
    more = embedding_dedup(d.withColumn("N_Links", F.lit("mine")).withColumn("Component_ID", F.lit("mine")).withColumn("_extra", F.lit("mine")))
    assert [c.lower() for c in more.columns].count("n_links") == 1 and {r.vec_id: (r.n_links, r.component_id, r.kept) for r in more.collect()} == got
