"""Quality rules (operator 9), DataFrame functions only.

Base rules plus a hashed n-gram log-likelihood ratio. N-grams of a text are the last two characters of
each word and its pairs of neighbouring words; they fall into ``BUCKETS`` hash buckets. One smoothed multinomial over the buckets comes from trusted target texts, one from the whole corpus. A document's score is the mean over
its n-grams of log(p_target / p_corpus); documents below ``cutoff`` are rejected, every time alike.

Scale: one pass counts buckets (each task sends at most ``BUCKETS`` rows), the weights travel inside the plan as
``BUCKETS`` doubles, a second pass scores. No text is shuffled and everything stays in the JVM.

Defined cases: a null text has no words; a document with under 50 words fails the base rule; with no trusted text
at all every ratio is 0 and the method rejects nothing; a text of any length is counted whole; a score equal to the
cutoff is kept; repeated rows count as often as they occur and get repeated results; an empty table gives an empty
result; columns named as a result column are replaced.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import without

_WS = " \t\n\x0b\x0c\r"
_RE = "[\\x20\\x09-\\x0D]+"
BUCKETS = 1 << 14
CUTOFF = -0.2
RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]


def words_of(text: Column) -> Column:
    """Words of a text; empty array for a null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_WS))
    return F.when(trimmed != "", F.split(trimmed, _RE)).otherwise(F.array().cast("array<string>"))


def _tail(a: Column, skip: int) -> Column:
    return F.slice(a, F.lit(1 + skip), F.greatest(F.size(a) - skip, F.lit(0)))


def _head(a: Column, drop: int) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - drop, F.lit(0)))


def featured(d: DataFrame, text_col: str) -> DataFrame:
    """Adds the words, their hashes, and the hashes of their last two characters and of pairs of neighbouring words."""
    d = d.withColumn("_q_w", words_of(F.col(f"`{text_col}`"))).withColumn("_q_h", F.transform("_q_w", lambda w: F.xxhash64(w)))
    d = d.withColumn("_q_c", F.transform("_q_w", lambda w: F.xxhash64(F.substring(w, -2, 2))))
    return d.withColumn("_q_p", F.zip_with(_head(F.col("_q_h"), 1), _tail(F.col("_q_h"), 1), lambda a, b: F.xxhash64(a, b)))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")


def _weights(d: DataFrame, trusted: Column) -> list[float]:
    """log(p_target / p_corpus) of every bucket, from counts over all documents."""
    counted = (
        d.select(F.explode(F.concat("_q_c", "_q_p")).alias("h"), trusted.alias("t"))
        .groupBy(_bucket(F.col("h")).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.count_if("t").alias("m"))
    )
    n, m = [0] * BUCKETS, [0] * BUCKETS
    for r in counted.collect():  # at most BUCKETS rows
        n[r.b], m[r.b] = r.n, r.m
    if not sum(m):
        return [0.0] * BUCKETS
    a, b = sum(m) + BUCKETS, sum(n) + BUCKETS
    return [round(math.log((y + 1) / a) - math.log((x + 1) / b), 6) for x, y in zip(n, m, strict=True)]


def with_repeats(d: DataFrame, packed_windows: int = 1 << 24) -> DataFrame:
    """Adds ``_q_at``: sorted positions of the 3-word windows that occur twice or more in the text.

    Windows are first compared by 40 hash bits, packed with their 24-bit position into one sortable long; the few that
    meet there are compared again by all 64 bits. A text with more windows than that holds is sorted by whole hashes.
    """
    p = F.col("_q_p")
    d = d.withColumn("_q_win", F.zip_with(_head(p, 1), _tail(p, 1), lambda a, b: F.xxhash64(a, b)))
    low = F.lit((1 << 24) - 1)
    fits = F.size("_q_win") <= packed_windows
    packed = F.sort_array(F.transform("_q_win", lambda h, i: F.shiftleft(h, 24).bitwiseOR(i.cast("long"))))
    d = d.withColumn("_q_s", F.when(fits, packed).otherwise(F.array().cast("array<bigint>")))
    s = F.col("_q_s")
    met = F.zip_with(_head(s, 1), _tail(s, 1), lambda a, b: F.when(F.shiftright(a, 24) == F.shiftright(b, 24), F.array(a, b)))
    d = d.withColumn("_q_met", F.filter(met, lambda x: x.isNotNull()))
    where = F.transform(F.array_distinct(F.flatten("_q_met")), lambda x: x.bitwiseAND(low).cast("int"))
    by_hash = F.sort_array(F.transform(where, lambda i: F.struct(F.get(F.col("_q_win"), i).alias("h"), i.alias("i"))))
    whole = F.sort_array(F.transform("_q_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_q_e", F.when(F.size("_q_met") > 0, by_hash).when(~fits, whole))
    e = F.col("_q_e")
    same = F.zip_with(_head(e, 1), _tail(e, 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    at = F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
    return d.withColumn("_q_at", F.when(e.isNotNull(), at))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF, max_trusted: int = 20_000, packed_windows: int = 1 << 24) -> DataFrame:
    """Documents with the base counts, ``base_failed``, ``score`` (mean log ratio) and ``kept``.

    ``labels``: (doc_id, quality). The target is fitted on at most ``max_trusted`` documents with quality 1, chosen by
    the hash of their id; the raw counts cover every document.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    trusted_ids = labels.where("quality = 1").select(F.col("doc_id").alias("_q_tid")).where("_q_tid is not null").distinct().orderBy(F.xxhash64("_q_tid"), "_q_tid").limit(max_trusted)
    base = without(docs, RESULT)
    ids = base.select(F.col(f"`{id_col}`").alias("_q_id"), F.col(f"`{text_col}`"))
    marked = ids.join(F.broadcast(trusted_ids), F.col("_q_id") == F.col("_q_tid"), "left")
    found = _weights(featured(marked, text_col), F.col("_q_tid").isNotNull())
    weights = F.from_json(F.lit(json.dumps(found)), "array<double>")

    d = with_repeats(featured(base, text_col), packed_windows)
    at = F.col("_q_at")
    gaps = F.zip_with(_head(at, 1), _tail(at, 1), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.when(F.size(at) > 0, F.aggregate(gaps, F.lit(3).cast("long"), lambda acc, g: acc + g)).otherwise(F.lit(0).cast("long"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(_WS))) > 0)
    add = lambda acc, h: acc + F.get(weights, _bucket(h))
    d = d.withColumn("_q_lines", lines).withColumn("_q_total", F.aggregate("_q_p", F.aggregate("_q_c", F.lit(0.0), add), add))
    n = F.size("_q_w").cast("long")
    out = d.select(
        *[F.col(f"`{c}`") for c in base.columns],
        n.alias("n_words"),
        F.length(F.array_join("_q_w", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.when(n > 0, F.col("_q_total") / (n + F.size("_q_p"))).otherwise(F.lit(0.0)).alias("score"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= F.lit(cutoff)))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", *RESULT)


QUERIES = {"op9_quality_rules": op9_quality_rules}
SQL: dict[str, str] = {}
