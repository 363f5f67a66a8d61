"""Spans of any number of tokens are found, as by trying all starts and lengths, in linear time."""

import random
import time

from pyspark.sql import functions as F

from quillet.functions.spans import MISSING, clean, span
from quillet.operators.detection import align_span


def test_align_span_of_many_tokens(spark):
    t = [f"t{i}" for i in range(60)]
    rows = [(t, '"' + "".join(t[7:47]) + '"', (7, 40)), (t, "".join(t), (0, 60)), (["a", "ab", "a", "b"], "ab", (1, 1)), (t, "t1t3", None), ([], "a", None), (t, None, None)]
    d = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "i int, tokens array<string>, value string")
    got = {r.i: r.s and tuple(r.s) for r in d.select("i", align_span(F.col("tokens"), F.col("value")).alias("s")).collect()}
    assert got == {i: r[2] for i, r in enumerate(rows)}


def tried(tokens, value):
    want = clean(value)
    for i in range(len(tokens)):
        text = ""
        for j in range(i, len(tokens)):
            text += tokens[j]
            own = clean(text)
            if own == want or own in MISSING and want in MISSING and len(own) <= len(want):
                return i, j - i + 1
            if len(own) > len(want):
                break
    return None


def test_spans_equal_trying_all():
    rng, hits = random.Random(3), 0
    parts = ["a", "b", "ab", " ", "'", '"', "\n", " a", "b ", "", 'a"b', "None", "null", "'a", "aa"]
    for _ in range(6000):
        tokens = [rng.choice(parts) for _ in range(rng.randint(0, 12))]
        i = rng.randint(0, len(tokens))
        value = "".join(tokens[i : i + rng.randint(0, 5)]) if rng.random() < 0.7 else "".join(rng.choice(parts) for _ in range(3))
        got = span(tokens, value)
        assert got == tried(tokens, value), (tokens, value)
        hits += got is not None
    assert hits > 2000


def test_long_token_lists(spark):
    t = [f"t{i % 97} " for i in range(10_000)]
    began = time.time()
    assert span(t, "".join(t[9000:9990])) == (9000 % 97, 990) and span(t, "".join(t) + "x") is None and span(["a"] * 10_000, "a" * 9_999 + "b") is None
    assert time.time() - began < 2
    d = spark.createDataFrame([(t, "".join(t[5:9_000]))] * 8, "tokens array<string>, value string")
    assert {tuple(r.s) for r in d.select(align_span(F.col("tokens"), F.col("value")).alias("s")).collect()} == {(5, 8995)}
