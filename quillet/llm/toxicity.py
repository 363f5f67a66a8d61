"""Toxicity (operator 8): class-conditional modified Kneser-Ney models over the bytes of words.

A toxic and an ordinary interpolated modified Kneser-Ney 5-gram model have counts of their own at the highest order and
share the continuation counts of the lower ones, so a rare expression falls back on both classes and only evidence for one
class moves the score. A word is scored from its own bytes and its edges; insults are recognised by their stems as well as
by whole words. In a toxic text, a share of the words (``SHARE``) is taken to follow the toxic model and all others the
ordinary one, which keeps chance differences of common words out of the sum. The log-likelihoods of a document under both
are compared after normalising by its number of words and by the square root of it, and a logistic curve fitted on
labelled rows that the models have not seen turns this into a score from 0 to 1.

Scale: models are fitted on a bounded, hash-chosen sample (``sample_rows`` labelled rows of each class and
``sample_chars`` characters at most, whole rows) and all its n-grams, and are broadcast: at most 12 bytes * 2 for each
character. Scoring is one pass over the texts without a shuffle; every different word of a block of text is scored once.

Defined cases: a null, empty or blank text has ratio 0 and gets the curve's value there, at most just under the
cut; a document whose label is null or not 0/1 does not train, and of several labels of an id the largest counts; of rows
that repeat a text and a label, the smallest id trains; texts of any length are scored whole, those over a sixteenth of
``sample_chars`` do not train (an error if a class has no shorter one); equal scores are predicted alike; a sample without both classes
gives score 0 for all; repeated rows get repeated results; an empty table gives an empty result; columns named as a result
column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, saved, small_batches, within, without
from .kneser_ney import estimate, lookup
from .text import Words, mix, slices

ORDER, PAD, END = 5, 0, 1
CUT = 0.7
SHARE = 0.003
RESULT = ["held_out", "score", "predicted", "log_ratio"]


def word_grams(w: Words, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed 5-grams and their 4-byte histories for each byte and the end of the picked words; index of the word."""
    size = (w.end - w.start)[picked]
    width = size + ORDER  # ORDER - 1 of padding before, one end mark after
    first = np.concatenate([[0], np.cumsum(width)])
    buf = np.zeros(int(first[-1]), np.int64)
    word = np.repeat(np.arange(len(picked)), size)
    inner = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    buf[first[word] + ORDER - 1 + inner] = np.maximum(w.data[w.start[picked][word] + inner], 2)
    buf[first[1:] - 1] = END
    at = np.flatnonzero(np.arange(len(buf)) - np.repeat(first[:-1], width) >= ORDER - 1)
    hist = np.full(len(at), 1, np.int64)
    for i in range(ORDER - 1, 0, -1):
        hist = (hist << 8) | buf[at - i]
    gram = ((hist ^ (1 << 8 * (ORDER - 1))) | (1 << 8 * (ORDER - 1))) << 8 | buf[at]
    return gram, hist, np.repeat(np.arange(len(picked)), width - (ORDER - 1))


class Ratio:
    """log p_toxic - log p_ordinary of words, from 5-grams and their document counts in both classes.

    Each class is an interpolated modified Kneser-Ney model of its own 5-gram counts over lower orders that both share."""

    def __init__(self, rows: np.ndarray, counts: np.ndarray):
        model = estimate(rows, counts, 8, 256, PAD)
        diff = model.weight[:, 1] - model.weight[:, 0]
        use = np.abs(diff) > 1e-6
        self.keys, self.diff = model.keys[use], diff[use].astype(np.float32)

    def of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ratio, number of words) of each text."""
        w = Words(texts)
        _, first, inv = np.unique(w.hash, return_index=True, return_inverse=True)
        gram, hist, word = word_grams(w, first)
        both = lookup(self.keys, self.diff, gram) + lookup(self.keys, self.diff, hist)
        by_word = np.bincount(word, weights=both, minlength=len(first))
        # in a toxic text a word is an expression of that class with probability SHARE and ordinary otherwise
        by_word = np.logaddexp(np.log1p(-SHARE), np.log(SHARE) + by_word)
        return np.bincount(w.doc, weights=by_word[inv] if len(inv) else None, minlength=w.n_rows), w.counts()


def features(ratio: np.ndarray, n: np.ndarray) -> np.ndarray:
    n = np.maximum(n, 1)
    return np.stack([np.ones(len(n)), np.clip(100 * ratio / n, -3, 3), np.clip(20 * ratio / np.sqrt(n), -5, 8)], 1)


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps, both classes weighing the same."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 0.1 * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta))
        beta = beta + np.linalg.solve(hess, grad)
    return beta


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1, sample_rows: int = 4000, sample_chars: int = 1 << 24) -> DataFrame:
    """Documents with ``held_out``, ``score``, ``predicted`` and ``log_ratio``, the difference of the two log-likelihoods for
    each word that the score is made of. ``labels``: (doc_id, toxic)."""
    small_batches(docs.sparkSession)
    base = without(docs, RESULT)
    ident = F.col(f"`{id_col}`")
    order = F.xxhash64(F.lit(3), "id")
    lab = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y")).where("id is not null and y in (0, 1)").where(crc_mod(F.col("id"), folds) != held).groupBy("id").agg(F.max("y").alias("y"))
    chosen = None
    for k in (0, 1):
        part = lab.where(F.col("y") == k).orderBy(order, "id").limit(sample_rows)
        chosen = part if chosen is None else chosen.union(part)
    # at most 2 * sample_rows ids; the sample is stored, so that every pass sees the same rows in the same half
    texts = base.select(ident.alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    texts = texts.groupBy("text", "y").agg(F.min("id").alias("id"))
    sample = within(texts, sample_chars, order, F.col("id"), by=("y",))
    sample = saved(sample.select("text", "y", F.floor(F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(3)) / 2).cast("int").alias("half")))
    labelled, used = ({r["y"] for r in d.select("y").distinct().collect()} for d in (texts, sample))
    if labelled != used:
        raise ValueError("no labelled text of a class is short enough for the sample: raise sample_chars")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                w = Words(b.column("text"))
                once = np.unique(w.hash ^ mix(w.doc.astype(np.uint64)), return_index=True)[1]  # a word counts once a document
                y = np.asarray(b.column("y"), np.int64)[w.doc[once]]
                _, first, inv = np.unique(w.hash[once], return_index=True, return_inverse=True)
                first = once[first]
                per = np.stack([np.bincount(inv, weights=(y == k), minlength=len(first)) for k in (0, 1)], 1) if len(inv) else np.zeros((0, 2))
                gram, _, word = word_grams(w, first)
                u, at = np.unique(gram, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), *(pa.array(np.bincount(at, weights=per[word, k], minlength=len(u)).astype(np.int64)) for k in (0, 1))], ["g", "c0", "c1"])

    grams = (
        sample.where("half = 0").select("text", "y").mapInArrow(count, "g long, c0 long, c1 long")
        .groupBy("g").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).toPandas()  # at most 2 * sample_chars rows
    ).sort_values("g")
    counts = grams[["c0", "c1"]].to_numpy(np.int64)
    fits = bool(len(grams)) and bool((counts.sum(0) > 0).all())
    beta, ratio = np.zeros(3), None
    if fits:
        g = grams["g"].to_numpy(np.int64)
        rows = np.stack([(g >> 8 * (ORDER - 1 - i)) & 255 for i in range(ORDER)], 1)
        ratio = Ratio(rows, counts)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                r, n = shared.value.of_texts(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(r), pa.array(n.astype(np.int64))], ["y", "r", "n"])

    if fits:
        seen = sample.where("half = 1").select("text", "y").mapInArrow(measured, "y int, r double, n long").toPandas()
        if seen["y"].nunique() == 2:
            beta = fit_curve(features(seen["r"].to_numpy(), seen["n"].to_numpy()), seen["y"].to_numpy())
        else:
            fits = False
    names, at = base.columns, base.columns.index(text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, names[at], 1 << 20):
                if fits:
                    r, n = shared.value.of_texts(b.column(at))
                    s = 1 / (1 + np.exp(-np.clip(features(r, n) @ beta, -30, 30)))
                    s = np.where(n == 0, np.minimum(s, CUT - 0.01), s)
                    r = r / np.maximum(n, 1)
                else:
                    s = r = np.zeros(b.num_rows)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array(r)], [*names, "score", "log_ratio"])

    out = base.mapInArrow(scored, T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("log_ratio", T.DoubleType())]))
    return out.select(*[F.col(f"`{c}`") for c in names], (crc_mod(ident, folds) == held).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).cast("int").alias("predicted"), "log_ratio")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", *RESULT)


QUERIES = {"op8_toxicity": op8_toxicity}
SQL: dict[str, str] = {}
