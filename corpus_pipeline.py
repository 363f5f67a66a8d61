"""The corpus pipeline: five stages over the documents table, each on all that the stage before it kept.

1. Quality classifier: documents above their language's perplexity limit go.
2. Line dedup: repeated lines go from the texts.
3. MinHash near-dedup: one document of each group stays.
4. Mixing: documents are drawn by the probabilities of their source, language and topic.
5. SentencePiece: the texts are encoded, and checked by decoding.

All stages but the last return the columns of documents. ``sf_dir`` gives the labels of the quality classifier.

Defined cases are those of the stages: a document without text is kept by the classifier if its perplexity is, loses no
line, is alone, is drawn with probability 1 and gets no pieces (null ids for a null text); a row without an id is alone;
of rows that repeat an id and a text, all or none stay; without trusted labels the classifier keeps all; an empty table
gives an empty result; further columns go through all stages, but for those named as a column of the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillet.llm.common import saved
from quillet.llm.line_dedup import dedup_lines
from quillet.llm.mixing import mix_sources
from quillet.llm.near_dedup import near_dedup
from quillet.llm.quality_classifier import quality_classifier
from quillet.llm.sentencepiece_codec import encode_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    out = quality_classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three documents or more share (the largest id keeps them)."""
    return dedup_lines(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return near_dedup(docs).where("class_kept").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn towards the target weights."""
    return mix_sources(docs).where("kept").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids and counts."""
    return encode_documents(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("minhash near-dedup", near_duplicates), ("mixing", mixing), ("sentencepiece", tokens)]

#: Training a model and Viterbi decoding have no SQL form; tests/llm/test_brute.py holds run() against plain versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
