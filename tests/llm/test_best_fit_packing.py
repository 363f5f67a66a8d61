"""Packing: reduction against the optimum, best fit against a plain one, tokens against the library, places against the texts."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillet.llm.best_fit_packing import Encoder, best_fit, lower_bound, op11_best_fit_packing, pack_documents, packing_plan, reduce_by_dominance, sequences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def definition():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def optimum(items, capacity):
    """Fewest sequences, by trying all."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            go(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def plain_best_fit(items, capacity):
    rooms = []
    for x in sorted(items, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= x
        else:
            rooms.append(capacity - x)
    return sorted(rooms)


def test_reduction_keeps_the_optimum():
    rng, kinds = random.Random(3), Counter()
    for _ in range(1200):
        capacity = rng.choice([6, 8, 10, 13, 20, 31])
        low, high = rng.choice([1, 1, 2, capacity // 4, capacity // 3]), rng.choice([capacity, capacity, capacity * 2 // 3])
        items = [rng.randint(max(1, min(low, high)), high) for _ in range(rng.randint(1, 11))]
        counts = np.bincount(items, minlength=capacity + 1)
        fixed, left = reduce_by_dominance(counts, capacity)
        rest = np.repeat(np.arange(capacity + 1), left).tolist()
        n, best = sum(t for t, _ in fixed), optimum(items, capacity)
        kinds.update({len(s): t for t, s in fixed})
        assert all(sum(s) <= capacity for _, s in fixed) and n + optimum(rest, capacity) == best
        assert sorted([x for t, s in fixed for x in s * t] + rest) == sorted(items)
        assert sorted(capacity - sum(s) for t, s in best_fit(left, capacity) for _ in range(t)) == plain_best_fit(rest, capacity)
        assert lower_bound(counts, capacity) <= best <= packing_plan(counts, capacity)[1]
    assert min(kinds[1], kinds[2], kinds[3]) > 20


def test_many_equal_lengths_cost_nothing():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 10**9, 1025)
    counts[0] = 0
    rows, n = packing_plan(counts.tolist(), 1024)
    assert len(rows) < 20_000 and n <= lower_bound(counts.tolist(), 1024) * 1.005 + 5


ODD = ["a \t b", "x   b é  f é\n\n g", "café noir  \n", "<|endoftext|> a <|endoftext|>b,  <|endoftext|>", " ", "\n\n", "日本語 テキスト です", "a\x1c b\x85 c", " lead", "it's\tI'll  x.", "é  b", "À À×. \n x÷,", "it's.) \"No!\" (a)b", None, ""]


def test_encoder_equals_the_library(spark, definition):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ODD
    library, encoder = Tokenizer.from_str(definition), Encoder(definition)
    for part in (texts, ODD, texts[::-1]):
        ids, first = encoder.encode(pa.array(part, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == [library.encode(t or "", add_special_tokens=False).ids for t in part]


def check_packing(rows, ids_of, max_len):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, ids in ids_of.items():
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            own = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(own)) and (k == 0 or r.length == max_len)
            at += r.length
        assert at == len(ids) and (len(ids) > max_len) == (len(by_doc[i]) > 1)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= max_len
    return len(by_seq)


def test_query(spark, definition):
    library = Tokenizer.from_str(definition)
    ids_of = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op11_best_fit_packing(spark, SF).collect()
    n = check_packing(rows, ids_of, 1024)
    counts = np.bincount([r.length for r in rows], minlength=1025).tolist()
    assert n == packing_plan(counts, 1024)[1] <= lower_bound(counts, 1024) * 1.01 + 1


def test_edges_and_sequences(spark, definition):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", "x"), (None, "d " * 30_000, "x"), (4, "a b c", "x"), (1, "a b c", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, length string").withColumn("_id", F.lit("mine")).repartition(3)
    out = pack_documents(d, definition, max_len=16, keep_ids=True)
    got = out.collect()
    library = Tokenizer.from_str(definition)
    plain = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in rows}
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
    assert sum(r.length for r in got) == sum(len(plain[i]) for i, _, _ in rows)
    assert Counter(r.doc_id for r in got)[1] == 2 and [r.length for r in got if r.doc_id == 2] == [1]
    whole = {r.sequence_id: r.ids for r in sequences(out).collect()}
    assert all(len(x) <= 16 for x in whole.values()) and all(whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids for r in got)
    long = sorted((r for r in got if r.doc_id is None), key=lambda r: r.piece)
    assert [i for r in long for i in r.ids] == plain[None] and all(r.length == 16 for r in long[1:])
    assert pack_documents(d.limit(0), definition).count() == 0
