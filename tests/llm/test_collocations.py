"""Phrases against a plain count; the trie against a dictionary; cases at the edges."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillet.llm.collocations import PieceWords, build_trie, collocations


def plain(rows, min_count, max_words, top, cover):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    out = []
    for (lang, p), a in cand.items():
        if any(g == lang and len(q) > len(p) and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in cand.items()):
            continue
        score, k = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    rank = Counter()
    ranked = []
    for r in sorted(out, key=lambda r: (r[0], -r[6], -r[2], r[1].encode())):
        rank[r[0]] += 1
        if top is None or rank[r[0]] <= top:
            ranked.append((r[0], rank[r[0]], *r[1:]))
    return ranked


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["the", "The", "of", "new", "york", "times", "é", "x.y", "a\x00b", "日本", "to", "be", "or", "not"]
    out = []
    for i in range(160):
        w = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            w.insert(rng.randint(0, len(w)), rng.choice(["New York Times", "to be or not to be", "of the\tof the", "one. two", "of\nthe"]))
        out.append((rng.choice([" ", "  ", "\t"]).join(w), rng.choice(["en", "en", "en", "fr", None])))
    return [*out, (None, "en"), ("", None), ("the the " * 50_000, "long"), ("the the the", "long"), ("the the the", "long")]


@pytest.mark.parametrize(("max_words", "top", "shard"), [(3, 2000, 1 << 20), (3, 7, 11), (4, None, 1000), (2, None, 1)])
def test_against_plain(spark, rows, max_words, top, shard):
    few = rows if shard > 1 else rows[:40]
    d = spark.createDataFrame([(*r, "mine", "mine") for r in few], "text string, lang string, phrase string, F string").repartition(4)
    got = [tuple(r) for r in collocations(d, max_words=max_words, top=top, shard=shard).collect()]
    assert sorted(got) == sorted(plain(few, 10, max_words, top, 50)) and got


def test_empty(spark, rows):
    d = spark.createDataFrame([("a b", "en")], "text string, lang string")
    assert collocations(d.limit(0)).count() == 0 and collocations(d).count() == 0
    assert collocations(d.select(F.lit(None).cast("string").alias("text"), "lang")).count() == 0


def test_trie_holds_its_phrases():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(700)]
    some = sorted({(rng.choice("ab"), " ".join(rng.choice(words[: rng.choice([5, 700])]) for _ in range(rng.randint(2, 4)))) for _ in range(6000)} | {("a", f"w0 {x}") for x in words})
    t = build_trie(pa.array([x[0] for x in some]), pa.array([x[1] for x in some]))
    assert sorted(t.value[t.value >= 0].tolist()) == list(range(len(some)))
    for i, (lang, phrase) in enumerate(some[::7]):
        code = np.searchsorted(t.codes, PieceWords(pa.array([phrase]), pa.array([lang])).key)
        state = int(code[0])
        for c in code[1:].tolist():
            for shift in (16, 8, 0):
                to = int(t.base[state]) + ((c >> shift) & 255)
                assert t.check[to] == state
                state = to
        assert t.value[state] == 7 * i
