"""Seeds' partners against a loop over rows in any batches; rising chains against the tree."""

import random

import numpy as np
import pyarrow as pa

from quillet.llm.fuzzy_passages import GAP, RECENT, WIDTH, chains, matched_seeds, rising_chains


def looped(rows):
    """Each occurrence with the first document of its seed and the RECENT before it."""
    by_seed = {}
    for h, d, p in rows:
        by_seed.setdefault(h, {}).setdefault(d, []).append(p)
    out = []
    for docs in by_seed.values():
        order = list(docs)
        for i, d in enumerate(order):
            for o in {0, *range(max(0, i - RECENT), i)} - set(range(i, i + 1)):
                out += [(d, order[o], p, docs[order[o]][min(k, len(docs[order[o]]) - 1)]) for k, p in enumerate(docs[d])]
    return sorted(out)


def test_partners_in_any_batches():
    rng = random.Random(1)
    for n in range(600):
        rows = sorted({(rng.randint(0, 4), rng.randint(0, 9), rng.randint(0, 30)) for _ in range(rng.randint(1, 60))})
        cuts = [0, *sorted(rng.sample(range(len(rows) + 1), min(len(rows), rng.randint(0, 6)))), len(rows)]
        name, kind = ((lambda d: f"d{d}"), pa.string()) if n % 2 else ((lambda d: d), pa.int64())
        columns = lambda q: [pa.array([r[0] for r in q], pa.int64()), pa.array([name(r[1]) for r in q], kind), pa.array([r[2] for r in q], pa.int32())]
        batches = [pa.RecordBatch.from_arrays(columns(rows[a:b]), ["h", "id", "pos"]) for a, b in zip(cuts, cuts[1:], strict=False)]
        got = [(int(str(x["a"]).strip("d")), int(str(x["b"]).strip("d")), x["x"], x["y"]) for b in matched_seeds(iter(batches)) for x in b.to_pylist()]
        assert sorted(got) == looped(rows)


def test_rising_chains_score_as_with_the_tree():
    rng = random.Random(2)
    score = lambda x, y, c: WIDTH * len(c) - GAP * (x[c[-1]] - x[c[0]] + y[c[-1]] - y[c[0]])
    for _ in range(600):
        n = rng.randint(2, 40)
        x, y = (np.cumsum([rng.choice([1, 2, 3, 10, 40, 90]) for _ in range(n)]) for _ in range(2))
        tree, plain = chains(x, y), rising_chains(x.tolist(), y.tolist())
        assert bool(tree) <= bool(plain) and len({i for c in plain for i in c}) == sum(map(len, plain))
        if tree:
            assert abs(max(score(x, y, c) for c in tree) - max(score(x, y, c) for c in plain)) < 1e-6
        assert {i for c in tree for i in c if len(c) > 2} <= {i for c in plain for i in c} | {c[k] for c in tree for k in (0, -1)}
    assert rising_chains([1, 2], [2, 1]) is None
