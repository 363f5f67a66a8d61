"""Runs against a plain search of all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.llm.periodic_runs import WaveletTree, find_runs, looped, op12_periodic_runs, periodic_runs

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def plain_runs(w, min_len=6):
    """All (start, length, period): for every period the longest stretches of equal words that far apart."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_len, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_find_runs_on_random_texts():
    rng = random.Random(1)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 4)):
            w, n, letters = [], rng.randint(0, 90), rng.choice([1, 2, 2, 3, 10])
            while len(w) < n:
                unit = [rng.randrange(letters) for _ in range(rng.randint(1, 12))]
                if rng.random() < 0.3:
                    unit = [unit[0]] * rng.randint(1, 8) + unit
                w += (unit * rng.randint(2, 7))[: len(unit) * 6 + 2] if rng.random() < 0.4 else unit[:1]
            docs.append(w)
        first = np.concatenate([[0], np.cumsum([len(x) for x in docs])])
        start, length, period = find_runs(np.array([c for x in docs for c in x], np.int64), np.repeat(np.arange(len(docs)), np.diff(first)), first)
        want = sorted((int(f) + s, n, q) for f, x in zip(first, docs, strict=False) for s, n, q in plain_runs(x))
        assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == want


def test_successor():
    rng = np.random.default_rng(2)
    v = rng.permutation(300)
    lo = rng.integers(0, 300, 500)
    hi = np.minimum(lo + rng.integers(0, 60, 500), 300)
    least = rng.integers(0, 600, 500)
    want = [min((x for x in v[a:b].tolist() if x >= c), default=-1) for a, b, c in zip(lo, hi, least, strict=True)]
    assert WaveletTree(v).successor(lo, hi, least).tolist() == want


def digest(doc_id, text):
    w = WORD.findall((text or "").encode())
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *longest, sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in docs if len(r.text or "") < 8000}
    got = {r.doc_id: tuple(r) for r in op12_periodic_runs(spark, SF).collect()}
    assert len(got) == len(docs) and any(r[1] for r in got.values())
    assert {i: got[i] for i in short} == {i: digest(i, t) for i, t in short.items()}


LONG = "a b c " * 40_000
ROWS = [(1, "x " * 6), (2, None), (3, ""), (4, " \n\t "), (None, "no no no no no no"), (5, LONG), (1, "x " * 6), (6, "é y é y é y é y"), (7, "x x x x x")]


def test_edges(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("RUNS", F.lit("mine")).withColumn("_extra", F.lit("mine"))
    out = periodic_runs(d)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(ROWS) and [c.lower() for c in out.columns].count("runs") == 1 and got[1]["_extra"] == "mine"
    assert [tuple(x) for x in got[1].runs] == [(0, 6, 1)] and got[1].collapsed == "x" and got[None].collapsed == "no"
    assert [tuple(x) for x in got[5].runs] == [(0, 120_000, 3)] and got[5].collapsed == "a b c"
    assert got[6].runs == [] and got[7].runs == [] and got[7].collapsed == "x x x x x"
    assert all(got[i].n_words == 0 and got[i].runs == [] and got[i].collapsed == "" for i in (2, 3, 4))
    assert periodic_runs(d.limit(0)).count() == 0 and looped(d).count() == len(ROWS)
    with pytest.raises(ValueError):
        periodic_runs(d, min_exponent=3)
