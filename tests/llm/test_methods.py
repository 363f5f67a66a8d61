"""Each operator against a brute-force version, an exact round trip, SQL, or planted cases."""

import collections
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quillet.llm import kneser_ney, line_dedup, lm_scoring, mixing
from quillet.llm import registry as llm
from quillet.llm.components import connected_components
from quillet.llm.fuzzy_passages import Fenwick, align, chains, fuzzy_passages, paired
from quillet.llm.lm_scoring import LogBilinear
from quillet.llm.mixing import mix_sources, rake_local
from quillet.llm.near_dedup import longest_rise, near_dedup
from quillet.llm.quality_rules import quality_rules
from quillet.llm.sentencepiece_codec import decode_documents, decode_texts, default_path, encode, encode_documents, load_vocabulary
from quillet.llm.text import Words
from quillet.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"
TINY = 200


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def test_words_match_bytes_split(texts):
    some = [*list(texts.values())[:50], None, "", " a\x0bB  c\x85d\n", "É é"]
    w = Words(pa.array(some))
    for i, t in enumerate(some):
        own = [bytes(w.data[s:e]) for s, e in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)]
        assert own == (t or "").encode().lower().split()
    by = collections.defaultdict(set)
    for h, s, e in zip(w.hash.tolist(), w.start, w.end, strict=True):
        by[h].add(bytes(w.data[s:e]))
    assert all(len(v) == 1 for v in by.values())


def test_line_dedup_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = {tuple(r) for r in c.execute(line_dedup.SQL["op10_line_dedup"]).fetchall()}
    assert {tuple(r) for r in llm.queries()["op10_line_dedup"](spark, SF).collect()} == want


def test_line_dedup_full_filter(spark):
    """A filter that is far too small only sends more lines to the exact step."""
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    a = {tuple(r) for r in line_dedup.dedup_lines(d).collect()}
    assert a == {tuple(r) for r in line_dedup.dedup_lines(d, filter_bytes=131072).collect()}


def test_quality_rules_counts(spark, texts):
    def base(x):
        w = re.findall(r"[^\x20\x09-\x0D]+", x or "")
        lines = [y for y in (x or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        at = collections.defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        cov = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
        return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in x or ""), len(lines) - len(set(lines)), len(cov), len(w) < 50 or 100 * len(cov) > 50 * len(w)

    extra = {TINY + 1: "a b c a b c", TINY + 2: "x x x x x", TINY + 3: "# one\n\n# one\n \n", TINY + 4: None}
    docs = spark.createDataFrame(list({**texts, **extra}.items()), "doc_id long, text string")
    rows = quality_rules(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base({**texts, **extra}[r.doc_id])
    assert all(not r.kept for r in rows if (texts.get(r.doc_id) or "").count("!!") > 40)


def test_lm_counts_and_base(spark, texts):
    words = {i: (t or "").encode().lower().split() + [b"<end>"] for i, t in texts.items()}
    c = collections.Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    rows = llm.queries()["op7_lm_scoring"](spark, SF).collect()
    for r in rows:
        ws = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_log_bilinear_is_normalised():
    rng = np.random.default_rng(0)
    u = rng.dirichlet(np.ones(20))
    one = rng.integers(0, 20, 4000)
    target = (one + 1) % 20  # the class before tells the next one
    n = lm_scoring.N_CLASSES + 1
    key, count = np.unique((target * n + one) * n + 20, return_counts=True)
    m = LogBilinear(u, dim=16)
    for epoch in range(600):  # an epoch has as many steps as there are different keys: 20
        m.fit(key, count, u, epoch)
    total = sum(np.exp(m.log_probs(np.full(20, w), np.arange(20), np.full(20, 20))) for w in range(20))
    assert np.allclose(total, 1, atol=1e-4)
    assert m.log_probs(target, one, np.full(4000, 20)).mean() > np.log(u[target]).mean() + 1


def test_kneser_ney_scores_whole_texts():
    """The sum of weights is the text's probability: over all texts of one symbol and an end, they sum to at most one."""
    grams = {(0, 0, 2): 5, (0, 2, 1): 4, (0, 2, 3): 1, (2, 3, 1): 1, (0, 0, 3): 2, (0, 3, 1): 2}
    m = kneser_ney.estimate(np.array(list(grams)), np.array(list(grams.values()))[:, None], 16, 3, 0)
    get = dict(zip(m.keys.tolist(), m.weight[:, 0].tolist(), strict=True))

    def prob(text):
        s = [0, 0, *text, 1]
        total = sum(get.get(int(kneser_ney.pack(np.array([[0] * n]), 16)[0]), 0.0) for n in (1, 2))
        for i in range(2, len(s)):
            for n in (1, 2, 3):
                total += get.get(int(kneser_ney.pack(np.array([s[i - n + 1 : i + 1]]), 16)[0]), m.unseen if n == 1 else 0.0)
        return math.exp(total)

    total = sum(prob(t) for n in range(0, 7) for t in itertools.product((2, 3), repeat=n))
    assert 0.97 < total <= 1.0 + 1e-9
    assert prob((2,)) > prob((3, 2))


def test_sentencepiece_against_library(texts):
    import sentencepiece as sp
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(default_path(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1  # the same pieces as a unigram model
    for p in proto.pieces:
        p.score = max(p.score, -40_000)  # the library adds up in single precision
    want = sp.SentencePieceProcessor(model_proto=proto.SerializeToString())
    v = load_vocabulary(default_path())
    v.scores, v.unknown = np.maximum(v.scores, -40_000), -40_010.0
    rng = random.Random(4)
    some = [*list(texts.values())[:80], "", " ", "a" * 300, "é🦙" * 60, " " * 20, *["".join(rng.choice("aäéb  \n\tz你🦙.,ñ01") for _ in range(rng.randint(0, 60))) for _ in range(200)]]
    ids, per = encode(v, pa.array(some))
    edge = np.concatenate([[0], np.cumsum(per)])
    for i, t in enumerate(some):
        own = ids[edge[i] : edge[i + 1]].tolist()
        assert own == want.encode(t)
        assert decode_texts(v, [own])[0] == t


def test_sentencepiece_shipped_scores(texts):
    """The file's own scores: the sum of the path's scores is the largest that any segmentation has."""
    v = load_vocabulary(default_path())
    number = {p: i for i, p in enumerate(v.pieces) if p and i not in set(v.byte_ids.tolist())}
    rng = random.Random(7)
    some = [t[:200] for t in list(texts.values())[:25] if t] + ["".join(rng.choice("abcdeéz 你🦙.,0") for _ in range(rng.randint(1, 50))) for _ in range(60)]
    ids, per = encode(v, pa.array(some))
    edge = np.concatenate([[0], np.cumsum(per)])
    for i, t in enumerate(some):
        chars = (" " + t).replace("▁", " ")
        best = [0.0] + [-math.inf] * len(chars)
        for e in range(1, len(chars) + 1):
            for b in range(max(0, e - 40), e):
                piece = number.get(chars[b:e].encode())
                score = v.scores[piece] if piece is not None else v.unknown if e == b + 1 else -math.inf
                best[e] = max(best[e], best[b] + score)
        own, total, at, raw = ids[edge[i] : edge[i + 1]].tolist(), 0.0, 0, set(v.byte_ids.tolist())
        while at < len(own):
            if own[at] in raw:  # the bytes of one character have its unknown score together
                total, at = total + v.unknown, at + 1
                while at < len(own) and own[at] in raw and 0x80 <= own[at] - int(v.byte_ids[0]) < 0xC0:
                    at += 1
            else:
                total, at = total + v.scores[own[at]], at + 1
        assert total == pytest.approx(best[-1], rel=1e-12)


def test_sentencepiece_round_trip(spark, texts):
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = decode_documents(encode_documents(d)).collect()
    assert all(r.round_trip and r.decoded == r.text for r in rows)


def test_mixing(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    a = {r.doc_id: r for r in mix_sources(d).collect()}
    total = sum(r.n_tokens for r in a.values())
    assert sum(r.n_tokens * r.probability for r in a.values()) == pytest.approx(0.6 * total, rel=1e-3)
    langs = collections.Counter()
    for r in a.values():
        langs[r.lang] += r.n_tokens
    share = {k: (v / total) ** 0.5 for k, v in langs.items()}
    fitted = collections.Counter()
    for r in a.values():
        fitted[r.lang] += r.n_tokens * r.weight
    for k in langs:
        assert fitted[k] / total == pytest.approx(share[k] / sum(share.values()), abs=0.02)
    b = {r.doc_id: r for r in mix_sources(d, local_cells=0).collect()}
    assert max(abs(b[i].probability - a[i].probability) for i in a) < 1e-6 and all(b[i].kept == a[i].kept and b[i].converged == a[i].converged for i in a)


def test_topics_are_fitted_on_all_documents(spark):
    """Topics are those of k-means over every document, however rows are dealt."""
    rng = random.Random(6)
    sets = [[f"{c}{i}wordy" for i in range(12)] for c in "abcdefgh"]
    texts = [" ".join(rng.choices(sets[i % 7], k=30)) for i in range(4000)] + [" ".join(rng.choices(sets[7], k=30))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' AS source", "'en' AS lang")
    runs = [{r.doc_id: r.topic for r in mix_sources(d.repartition(n)).select("doc_id", "topic").collect()} for n in (3, 11)]
    assert runs[0] == runs[1] and len(set(runs[0].values())) > 4
    x = mixing.vectors(Words(pa.array(texts)))
    assert runs[0] == dict(enumerate(mixing.topics(mixing.units(x), mixing.k_means(x, 8)).tolist()))


def test_raking():
    codes = np.array(list(itertools.product(range(3), range(2))))
    fit, converged = rake_local(codes, np.arange(1.0, 7.0), [np.array([0.5, 0.3, 0.2]), np.array([0.4, 0.6])])
    assert converged and np.allclose(np.bincount(codes[:, 0], weights=fit), [0.5, 0.3, 0.2]) and np.allclose(np.bincount(codes[:, 1], weights=fit), [0.4, 0.6])


def shingle_list(x):
    w = (x or "").encode().lower().split()
    k, out = collections.Counter(), []
    for t in [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []:
        out.append((t, k[t]))
        k[t] += 1
    return out


def groups(links, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_near_dedup_brute(spark, texts):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 400)}" for _ in range(200)]
    more = {1000 + i: " ".join(w if rng.random() > 0.01 else f"n{rng.randint(0, 99)}" for w in base) for i in range(90)}
    everything = {**texts, **more}
    s = {i: shingle_list(t) for i, t in everything.items()}
    links = []
    for i, j in itertools.combinations(sorted(s), 2):
        if s[i] and s[j]:
            at = {k: p for p, k in enumerate(s[j])}
            if min(len(s[i]), len(s[j])) < 0.8 * max(len(s[i]), len(s[j])):
                continue
            m = longest_rise([at[k] for k in s[i] if k in at])
            if m >= 0.8 * (len(s[i]) + len(s[j]) - m):
                links.append((i, j))
    want = groups(links, s)
    d = spark.createDataFrame(list(everything.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup(d).collect()} == want


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    want = groups(links, {x for p in links for x in p})
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == c for i, c in want.items() if i in got) and all(a == b for a, b in links if a not in got)


def test_embeddings_brute(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    x, lab, ids = np.array(t["embedding"].to_pylist(), float), t["label"].to_numpy(), t["vec_id"].to_numpy()
    rng = np.random.default_rng(0)
    near = x[:40] + rng.normal(0, 0.02, (40, x.shape[1]))
    x, lab, ids = np.concatenate([x, near, near[:5]]), np.concatenate([lab, lab[:40], lab[:5]]), np.concatenate([ids, np.arange(10_000, 10_045)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(link, False)
    want = groups([(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(link), strict=True)], [int(i) for i in ids])
    from quillet.llm.embedding_dedup import embedding_dedup

    d = spark.createDataFrame([(int(i), [float(v) for v in e], int(k)) for i, e, k in zip(ids, x, lab, strict=True)], "vec_id long, embedding array<double>, label int")
    for cell_rows, grid_from in ((8192, 8), (12, 100), (12, 1), (30, 0)):  # one group, chunks, grids of two and four coordinates
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(d, cell_rows=cell_rows, grid_from=grid_from).collect()}
        assert got == {int(i): (int(n), want[int(i)]) for i, n in zip(ids, link.sum(1), strict=True)}


def test_passages_planted(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    passage = [word() for _ in range(80)]
    fuzzy = [w if i % 13 else "zzz" for i, w in enumerate(passage)]
    docs, where = [], {}
    for i in range(30):
        a, b = [word() for _ in range(60)], [word() for _ in range(50)]
        mid = passage if i % 3 == 0 else fuzzy if i % 3 == 1 else [word() for _ in range(80)]
        docs.append((i, " ".join(a + mid + b)))
        where[i] = i % 3 != 2
    got = {r.doc_id: r for r in fuzzy_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, planted in where.items():
        assert (got[i].n_passages > 0) == planted
        if planted:
            assert min(p.start for p in got[i].passages) <= 62 and max(p.end for p in got[i].passages) >= 138 and got[i].n_repeated_words <= 90


def test_passages_brute(spark):
    """Every document that shares 50 words at 0.8 with another, and no other, by all pairs of windows."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    edited = lambda p, rate: [x for w in p for x in ([] if rng.random() < rate / 3 else [word(), w] if rng.random() < rate / 3 else [word() if rng.random() < rate / 3 else w])]
    passages = [[word() for _ in range(75)] for _ in range(3)]
    docs = {}
    for i in range(18):
        mid = edited(passages[i % 3], 0.05) if i < 9 else edited(passages[i % 3], 1.2) if i < 13 else passages[i % 3][:30]
        docs[i] = [word() for _ in range(rng.randint(0, 40))] + mid + [word() for _ in range(rng.randint(0, 40))]
    number = {w: k for k, w in enumerate({w for d in docs.values() for w in d})}
    codes = {i: np.array([number[w] for w in d]) for i, d in docs.items()}

    def share(a, b):
        for i in range(0, len(a) - 49, 3):
            x = a[i : i + 50]
            if len(np.intersect1d(x, b)) >= 40 and any(paired(x, b[j : j + 50]) >= 40 for j in range(0, len(b) - 49, 3)):
                return True
        return False

    want = set()
    for i, j in itertools.combinations(docs, 2):
        if share(codes[i], codes[j]):
            want |= {i, j}
    rows = fuzzy_passages(spark.createDataFrame([(i, " ".join(d)) for i, d in docs.items()], "doc_id long, text string")).collect()
    assert {r.doc_id for r in rows if r.n_passages} == want and want >= set(range(9)) and not want & set(range(13, 18))
    for r in rows:
        for p in r.passages or []:
            x, y = codes[r.doc_id][p.start : p.end], codes[p.partner]
            assert p.end - p.start >= 50 and paired(x, y) >= 0.8 * (p.end - p.start) * 0.99 and p.similarity >= 0.8


def test_paired_is_the_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        x, y = ([rng.randrange(5) for _ in range(rng.randint(0, 14))] for _ in range(2))
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, j in itertools.product(range(len(x)), range(len(y))):
            table[i + 1][j + 1] = table[i][j] + 1 if x[i] == y[j] else max(table[i][j + 1], table[i + 1][j])
        assert paired(np.array(x, int), np.array(y, int)) == table[-1][-1]


def test_chains_and_fenwick():
    rng = random.Random(3)
    f, plain = Fenwick(50), [(-1e18, -1)] * 50
    for i in range(200):
        k, v = rng.randrange(50), (rng.random(), i)
        f.add(k, v)
        plain[k] = max(plain[k], v)
        q = rng.randrange(51)
        assert f.best(q) == max([(-1e18, -1), *plain[:q]])
    x = np.array([0, 10, 20, 30, 5]), np.array([100, 110, 120, 130, 7])
    assert chains(*x)[0] == [0, 1, 2, 3]
    a = np.arange(100, dtype=np.uint32)
    b = np.concatenate([np.full(5, 777, np.uint32), a[:50], a[53:]])
    s, e, s2, e2, sim = align(a, b, 5)
    assert e - s >= 95 and sim >= 0.95 and (s2, e2) == (5, len(b))


def test_toxicity_held_out(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["an", "th", "er", "in", "on", "ed"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        w = [word() for _ in range(rng.randint(20, 120))]
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), "grmpf" + word())
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    out = toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in out if r.held_out]
    right = sum(r.predicted == int(r.doc_id % 3 == 0) for r in held)
    assert held and right >= 0.97 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)


def test_quality_classifier_rejects_junk(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = llm.queries()["op1_quality_classifier"](spark, sf).collect()
    junk = [r for r in rows if texts[r.doc_id].count("!!") > 0.3 * r.n_tokens or texts[r.doc_id].count(" | ") > 0.3 * r.n_tokens]
    assert junk and sum(not r.kept for r in junk) >= 0.95 * len(junk)
    assert sum(r.kept for r in rows) >= 0.8 * len(rows)
