"""Seeds of many documents: every two documents meet, in any batches and partitions; a partner in the middle is found."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillet.llm import fuzzy_passages as fp


def every_pair(rows):
    """All documents a > b of each seed; the k-th occurrence goes with the k-th or the last."""
    by_seed = {}
    for h, d, p in rows:
        by_seed.setdefault(h, {}).setdefault(d, []).append(p)
    return sorted((a, b, x, q[min(k, len(q) - 1)]) for docs in by_seed.values() for a, ps in docs.items() for b, q in docs.items() if a > b for k, x in enumerate(ps))


def test_every_two_documents_of_a_seed_meet(spark, monkeypatch):
    monkeypatch.setattr(fp, "TILE", 4)
    rng = random.Random(3)
    rows = sorted({(rng.randint(0, 12), rng.choice([rng.randint(0, 40), rng.randint(0, 3)]), rng.randint(0, 30)) for _ in range(500)} | {(20 + i, d, 1) for i in range(9) for d in range(i)})
    for cuts in ([0, len(rows)], [0, 3, 200, 201, 450, len(rows)]):  # each part a partition, which may cut a seed
        found = []
        for s, e in zip(cuts, cuts[1:], strict=False):
            part, batches = rows[s:e], []
            while part:
                n = rng.randint(1, 90)
                batches.append(pa.RecordBatch.from_arrays([pa.array([r[i] for r in part[:n]], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["h", "id", "pos"]))
                part = part[n:]
            monkeypatch.setattr(fp, "gathered", lambda b: (pa.Table.from_batches([x]) for x in b))
            found += [tuple(r.values()) for b in fp.split_seeds(iter(batches)) for r in b.to_pylist()]
        crowd = spark.createDataFrame([(r[4], r[0], r[2]) for r in found if r[1] is None], "h long, id long, pos int")
        few = [r[:4] for r in found if r[1] is not None]
        assert few and sorted(few + [tuple(r) for r in fp.matched_crowds(crowd).collect()]) == every_pair(rows)


def test_a_partner_between_others_is_found(spark):
    rng = np.random.default_rng(7)
    word = lambda: f"w{rng.integers(10**9)}"
    pieces = [[word() for _ in range(9)] for _ in range(8)]
    text = lambda own: " ".join(w for i, p in enumerate(pieces) for w in [*(p if i in own else [word() for _ in p]), word()])
    docs = {i: text({i % 8}) for i in range(40)}  # each has one piece, 20 and 39 all of them
    docs[20], docs[39] = text(set(range(8))), text(set(range(8)))
    got = {r.doc_id: r for r in fp.fuzzy_passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(1)).collect()}
    assert {i for i, r in got.items() if r.n_passages} == {20, 39}
    assert got[39].passages[0].partner == 20 and got[39].n_copied_words == got[39].n_repeated_words >= 70 and got[20].n_copied_words == 0
    assert spark.createDataFrame(list(docs.items()), "doc_id long, text string").where(F.col("doc_id") != 20).transform(fp.fuzzy_passages).where("n_passages > 0").count() == 0
