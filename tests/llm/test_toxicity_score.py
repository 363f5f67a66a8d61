"""The score of every document from plain counts, plain Kneser-Ney models and a plain fit of the curve."""

import collections
import math
import random
import zlib

import brute
import numpy as np
import pytest

from quillet.llm import toxicity


def ratio_of(model, words):
    out = 0.0
    for w in words:
        s = [*[0] * 4, *w.encode(), 1]
        one = sum(math.log(model.p(tuple(s[i - 4 : i + 1]), 1)) - math.log(model.p(tuple(s[i - 4 : i + 1]), 0)) for i in range(4, len(s)))
        out += math.log(1 - toxicity.SHARE + toxicity.SHARE * math.exp(one))
    return out


def curve(x, y):
    """The least of the weighted logistic loss plus a ridge of 0.05 times the square, by Newton with halved steps."""
    weight = np.where(y == 1, len(y) / 2 / (y == 1).sum(), len(y) / 2 / (y == 0).sum())
    loss = lambda b: float((weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ b))).sum() + 0.05 * b @ b)
    b = np.zeros(3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (weight * (y - p)) - 0.1 * b)
        while np.abs(step).max() > 1e-12 and loss(b + step) > loss(b) + 1e-13:
            step = step / 2
        b = b + step
    return b


def test_scores(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice(["an", "th", "er", "on"]) for _ in range(rng.randint(1, 3)))
    docs = []
    for i in range(240):
        w = [word() for _ in range(rng.randint(3, 40))]
        if i % 3 == 0 and i % 11:
            w[rng.randrange(len(w))] = "Grmpf" + word()
        docs.append((i, " ".join(w)))
    docs += [(240, docs[3][1]), (241, ""), (242, None), (243, "  \n ")]
    labels = {i: int(i % 3 == 0) for i, _ in docs[:-2]}
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    kept = {}
    for i, t in docs:
        if i in labels and not held(i):
            kept[t or "", labels[i]] = min(i, kept.get((t or "", labels[i]), 10**9))
    grams, later = collections.defaultdict(lambda: [0, 0]), []
    for (text, y), i in kept.items():
        if brute.xx(brute.I32(4), i) % 3 == 2:
            later.append((text, y))
            continue
        for w in set(brute.words(text)):
            s = [*[0] * 4, *w.encode(), 1]
            for k in range(4, len(s)):
                grams[tuple(s[k - 4 : k + 1])][y] += 1
    model = brute.KneserNey(dict(grams), 256, 0)

    def facts(texts):
        out = []
        for t in texts:
            w = brute.words(t)
            r, n = ratio_of(model, w), max(1, len(w))
            out.append([1.0, min(3, max(-3, 100 * r / n)), min(8, max(-5, 20 * r / math.sqrt(n))), r / n, len(w)])
        return np.array(out)

    b = curve(facts([t for t, _ in later])[:, :3], np.array([y for _, y in later]))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, lab).collect()}
    f = facts([t for _, t in docs])
    want = 1 / (1 + np.exp(-np.clip(f[:, :3] @ b, -30, 30)))
    want = np.where(f[:, 4] == 0, np.minimum(want, toxicity.CUT - 0.01), want)
    for (i, _), s, r in zip(docs, want, f[:, 3], strict=True):
        assert got[i].held_out == held(i) and got[i].score == pytest.approx(s, abs=2e-3) and got[i].log_ratio == pytest.approx(r, abs=1e-5)
        assert got[i].predicted == int(got[i].score >= 0.7)
    assert max(want) > 0.7 > min(want)
