"""Runs of one word that many documents share grow with them, not with their pairs; couples of seeds against a loop."""

import math
import random

import numpy as np

from quillet.llm import fuzzy_passages as fp


def test_runs_of_a_word_are_not_stored_by_pairs(spark, monkeypatch):
    rng, rows, n = np.random.default_rng(8), [], 300
    word = lambda k: [f"w{rng.integers(10**9)}" for _ in range(k)]
    docs = {i: word(5) + ["spam"] * int(rng.integers(20, 34)) + word(20) for i in range(n)}
    docs[40], docs[150], docs[299] = (word(5) + ["spam"] * k + word(20) for k in (60, 90, 75))
    keep = fp.saved

    def counted(df):
        kept = keep(df)
        rows.append(kept.count())
        return kept

    monkeypatch.setattr(fp, "saved", counted)
    got = {r.doc_id: r for r in fp.fuzzy_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")).where("n_passages > 0").collect()}
    assert set(got) == {40, 150, 299}
    assert (got[40].n_copied_words, got[150].n_copied_words, got[299].n_copied_words) == (0, 60, 75)  # 75 words are in the longest run before
    assert (got[40].n_repeated_words, got[150].n_repeated_words, got[299].n_repeated_words) == (60, 75, 75)
    assert max(rows) < 80 * n  # 300 documents are 44,850 pairs


def test_portions_have_the_same_words(spark, monkeypatch):
    rng = np.random.default_rng(9)
    word = lambda k: [f"w{rng.integers(10**9)}" for _ in range(k)]
    line, passage = word(20), word(60)
    docs = spark.createDataFrame([(i, " ".join(word(9) + (passage if i % 5 == 0 else word(30)) + line + word(9))) for i in range(40)], "doc_id long, text string")
    want = sorted(tuple(r) for r in fp.fuzzy_passages(docs).select("doc_id", "n_repeated_words", "n_copied_words").collect())
    monkeypatch.setattr(fp, "PER_TASK", 60)
    assert sorted(tuple(r) for r in fp.fuzzy_passages(docs).select("doc_id", "n_repeated_words", "n_copied_words").collect()) == want
    assert [w[0] for w in want if w[1]] == list(range(0, 40, 5))


def test_couples():
    rng = random.Random(6)
    for _ in range(100):
        seeds = sorted({(rng.randint(0, 3), rng.randint(0, 400)): (rng.randint(0, 9), rng.choice([0, 0, 1, 2])) for _ in range(rng.randint(1, 60))}.items())
        doc, pos, h, state = (np.array(c, np.int64) for c in ([d for (d, _), _ in seeds], [p for (_, p), _ in seeds], [h for _, (h, _) in seeds], [s for _, (_, s) in seeds]))
        want = {}
        for i in range(len(seeds)):
            for j in range(len(seeds)):
                far = pos[j] - pos[i]
                if doc[i] == doc[j] and 13 <= far <= fp.REACH and max(state[i], state[j]):
                    at = (doc[i], h[i], h[j], math.floor(math.log(far) / math.log(1.25)))
                    want[at] = want.get(at, False) or max(state[i], state[j]) == 2
        mixed = rng.sample(range(len(seeds)), len(seeds))
        of, key, opened, step, run, _ = fp.seed_couples(doc[mixed], h[mixed], pos[mixed], state[mixed], 13, 1.25, 34)
        assert not run.any() and len(key) == len(want)
        u = np.array([[a, b] for _, a, b, _ in want], np.uint64).reshape(-1, 2)
        keys = fp.mix(fp.mix(u[:, 0]) * np.uint64(3) + u[:, 1]).view(np.int64)
        assert sorted(zip(of.tolist(), key.tolist(), step.tolist(), opened.tolist(), strict=True)) == sorted((int(a[0]), k, a[3], bool(o)) for (a, o), k in zip(want.items(), keys.tolist(), strict=True))
