"""What is kept for a line that many documents share grows with them, not with their pairs; common seeds against a loop."""

import random

import numpy as np

from quillet.llm import fuzzy_passages as fp


def test_a_line_of_many_documents_is_not_stored_by_pairs(spark, monkeypatch):
    rng, rows = np.random.default_rng(5), []
    word = lambda n: [f"w{rng.integers(10**9)}" for _ in range(n)]
    line, passage, n = word(14), word(70), 300
    docs = {i: word(30) + line + word(30) for i in range(n)}
    docs[150], docs[299] = word(9) + passage + line, passage + word(40) + line
    keep = fp.saved

    def counted(df):
        kept = keep(df)
        rows.append(kept.count())
        return kept

    monkeypatch.setattr(fp, "saved", counted)
    got = fp.fuzzy_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")).where("n_passages > 0").collect()
    assert {(r.doc_id, r.passages[0].partner) for r in got} == {(150, 299), (299, 150)}
    assert max(rows) < 80 * n  # 300 documents are 44,850 pairs


def test_common_matches():
    rng = random.Random(4)
    for _ in range(200):
        sides = [sorted({(rng.randint(0, 5), rng.randint(0, 40)) for _ in range(rng.randint(0, 25))}) for _ in range(2)]
        by = [{h: [p for g, p in side if g == h] for h, _ in side} for side in sides]
        want = sorted((x, by[1][h][min(k, len(by[1][h]) - 1)]) for h, ps in by[0].items() if h in by[1] for k, x in enumerate(ps))
        mixed = [rng.sample(side, len(side)) for side in sides]
        x, y = fp.common_matches(*(np.array([r[i] for r in side], np.int64) for side in mixed for i in range(2)))
        assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == want
