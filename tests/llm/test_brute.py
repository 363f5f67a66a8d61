"""Operators and the pipeline against the plain versions of ``brute``."""

import collections
import itertools
import math
import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from quillet.llm import lm_scoring, mixing, sentencepiece_codec, toxicity
from quillet.llm.near_dedup import longest_rise
from quillet.llm.quality_classifier import quality_classifier
from quillet.llm.quality_rules import quality_rules
from quillet.llm.text import Words



SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def fixture():
    """Documents of two languages with junk, shared lines, exact and near copies, an empty one and one without words."""
    rng = random.Random(8)
    vocab = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(70)] for lang, letters in (("en", "abcdefg"), ("fr", "hijklmné"))}
    docs, trusted = [], set()
    for i in range(220):
        lang = "fr" if i % 4 == 0 else "en"
        lines = [" ".join(rng.choice(vocab[lang]) for _ in range(rng.randint(5, 14))) for _ in range(rng.randint(2, 7))]
        if i % 3 == 0:
            lines.insert(1, "This line is in Every third document " + lang)
        if i % 17 == 5:
            lines = ["".join(rng.choice("#$%&*!<>") for _ in range(rng.randint(2, 6))) + " BUY 99" for _ in range(20)]
        docs.append({"doc_id": i, "text": "\n".join(lines), "lang": lang, "source": "abc"[i % 3]})
        if i % 17 != 5:
            trusted.add(i)
    for i in range(220, 240):
        text = docs[i - 200]["text"].split(" ")
        if i % 2:
            text[len(text) // 2] = "changed"
        docs.append({"doc_id": i, "text": " ".join(text), "lang": docs[i - 200]["lang"], "source": "d"})
    docs += [{"doc_id": 240, "text": "", "lang": "en", "source": "a"}, {"doc_id": 241, "text": " \n\t", "lang": None, "source": None}, {"doc_id": 242, "text": None, "lang": "fr", "source": "a"}]
    return docs, trusted


@pytest.fixture(scope="module")
def tables(spark, fixture):
    docs, trusted = fixture
    d = spark.createDataFrame([tuple(x.values()) for x in docs], SCHEMA)
    labels = spark.createDataFrame([(x["doc_id"], int(x["doc_id"] in trusted), 0) for x in docs], "doc_id long, quality int, toxic int")
    return d, labels


def test_quality_classifier(fixture, tables):
    want = {r["doc_id"]: r for r in brute.quality(*fixture)}
    got = {r.doc_id: r for r in quality_classifier(*tables).collect()}
    for i, w in want.items():
        assert got[i].n_tokens == w["n_tokens"] and got[i].log_perplexity == pytest.approx(w["log_perplexity"], abs=1e-6)
        assert got[i].threshold == pytest.approx(w["threshold"], abs=1e-9) and got[i].kept == w["kept"]
    assert sum(not r.kept for r in got.values()) >= 13


def test_rows_of_one_id_in_two_languages(spark, tables):
    d, labels = tables
    both = d.union(spark.createDataFrame([(5, x.text, "fr", "a") for x in d.where("doc_id = 5").collect()], SCHEMA))
    limits = {(r.doc_id, r.lang): r.threshold for r in quality_classifier(both, labels).collect()}
    assert len({t for (_, lang), t in limits.items() if lang == "en"}) == len({t for (_, lang), t in limits.items() if lang == "fr"}) == 1


def test_mixing(tables):
    rows = [r.asDict() for r in mixing.mix_sources(tables[0]).collect()]
    want = brute.mix(rows)
    for r in rows:
        p, kept = want[r["doc_id"]]
        assert r["probability"] == pytest.approx(p, abs=1e-6) and r["kept"] == kept and r["n_tokens"] == len(brute.words(r["text"]))


def test_quality_rules(fixture, tables):
    docs, trusted = fixture
    want = brute.rule_scores(docs, trusted)
    for packed in (1 << 24, 3):  # as if texts were too long for packed positions
        for r in quality_rules(*tables, packed_windows=packed).collect():
            assert r.score == pytest.approx(want[r.doc_id], abs=1e-9)
            w = brute.words(r.text, False)
            at = collections.defaultdict(list)
            for i in range(len(w) - 2):
                at[tuple(w[i : i + 3])].append(i)
            repeated = {i + k for x in at.values() if len(x) > 1 for i in x for k in range(3)}
            assert r.n_repeat_words == len(repeated) and r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
            assert r.kept == (not r.base_failed and r.score >= -0.2)


def test_lm_score(spark, monkeypatch):
    """Class counts of all positions, and the score of each text token by token from the fitted parameters."""
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) + rng.choice(["", "", ".", ","]) for _ in range(900)]
    docs = [(i, " ".join(vocab[min(int(rng.expovariate(1 / 150)), 899)] for _ in range(rng.randint(0, 120)))) for i in range(150)]
    seen = {}
    fit = lm_scoring.trained

    def spy(counted, unigram):
        seen["counts"], seen["model"] = {r.k: r.c for r in counted.collect()}, fit(counted, unigram)
        return seen["model"]

    monkeypatch.setattr(lm_scoring, "trained", spy)
    rows = lm_scoring.lm_score(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    held = {r.doc_id for r in rows if r.held_out}
    tokens = {i: [*brute.words(t), None] for i, t in docs}
    count = collections.Counter(w for i, ws in tokens.items() if i not in held for w in ws)
    hashed = lambda w: int((Words(pa.array([w])).hash if w is not None else np.array([lm_scoring.END])).astype(np.uint64).view(np.int64)[0])
    frequent = sorted(count, key=lambda w: (-count[w], hashed(w)))[: lm_scoring.WORD_CLASSES]
    number = {w: k for k, w in enumerate(frequent)}

    def rare(w):
        b = (w or "").encode()
        return ((b[0] * 31 + b[min(1, len(b) - 1)] * 7) % (lm_scoring.RARE_CLASSES // 2) * 2 + (b[-1:] in (b".", b",", b"!", b"?", b";", b":"))) if b else 0

    cls = lambda w: number.get(w, lm_scoring.WORD_CLASSES + rare(w))
    size = collections.Counter({k: 1 for k in range(lm_scoring.RARE_CLASSES)})
    for w, c in count.items():
        if w not in number:
            size[rare(w)] += c + 1
    n, start = lm_scoring.N_CLASSES + 1, lm_scoring.START
    want = collections.Counter()
    for i, ws in tokens.items():
        c = [start, start, *map(cls, ws)]
        if i not in held:
            want.update((c[k] * n + c[k - 1]) * n + c[k - 2] for k in range(2, len(c)))
    assert seen["counts"] == dict(want)
    q, r, c, b = (x.astype(float) for x in seen["model"].parameters())
    for row in rows:
        ws, total = tokens[row.doc_id], 0.0
        ks = [start, start, *map(cls, ws)]
        for at, w in enumerate(ws, 2):
            s = q @ (c[0] * r[ks[at - 1]] + c[1] * r[ks[at - 2]]) + b
            total += (s[ks[at]] - s.max() - math.log(np.exp(s - s.max()).sum())) / math.log(10)
            if w not in number:
                total += math.log10((count[w] + 1) / size[rare(w)])
        assert row.score == pytest.approx(total, abs=1e-3)
    assert sum(r.score for r in rows if r.held_out) < 0


def test_toxic_ratio():
    """A word's ratio is the difference of two Kneser-Ney models, byte by byte."""
    rng = random.Random(6)
    docs = [(" ".join("".join(rng.choice("abcd" if k else "abce") for _ in range(rng.randint(1, 6))) for _ in range(8)), k) for k in (0, 1) for _ in range(40)]
    grams = collections.defaultdict(lambda: [0, 0])
    ends = lambda w: [*[0] * 4, *w.encode(), 1]
    for text, y in docs:
        for w in set(text.split()):
            s = ends(w)
            for i in range(4, len(s)):
                grams[tuple(s[i - 4 : i + 1])][y] += 1
    model = brute.KneserNey(dict(grams), 256, 0)
    ratio = toxicity.Ratio(np.array(list(grams)), np.array(list(grams.values())))
    share = toxicity.SHARE
    for text in [docs[0][0], docs[50][0], "zz abcd ", "", "dddd dddd eee"]:
        got, n = ratio.of_texts(pa.array([text]))
        want = 0.0
        for w in text.split():
            s = ends(w)
            one = sum(math.log(model.p(tuple(s[i - 4 : i + 1]), 1)) - math.log(model.p(tuple(s[i - 4 : i + 1]), 0)) for i in range(4, len(s)))
            want += math.log(1 - share + share * math.exp(one))
        assert n[0] == len(text.split()) and got[0] == pytest.approx(want, abs=1e-4)


def near_kept(docs):
    """Rows whose id is the smallest of their class: links are five-word shingles aligned in order, similarity 0.8."""
    shingles = {}
    for d in docs:
        w, seen, own = brute.words(d["text"]), collections.Counter(), []
        for t in [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []:
            own.append((t, seen[t]))
            seen[t] += 1
        shingles[d["doc_id"]] = own
    parent = {i: i for i in shingles}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(sorted(shingles), 2):
        a, b = shingles[i], shingles[j]
        if a and b:
            at = {k: p for p, k in enumerate(b)}
            m = longest_rise([at[k] for k in a if k in at])
            if m >= 0.8 * (len(a) + len(b) - m):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [d for d in docs if root(d["doc_id"]) == d["doc_id"]]


def test_pipeline(spark, fixture, tables, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, trusted = fixture
    tables[0].withColumnRenamed("source", "source").write.parquet(str(tmp_path / "documents.parquet"))
    tables[1].write.parquet(str(tmp_path / "labels.parquet"))
    kept = [{k: r[k] for k in ("doc_id", "text", "lang", "source")} for r in brute.quality(docs, trusted) if r["kept"]]
    kept = near_kept(brute.dedup_lines(kept))
    x = mixing.vectors(Words(pa.array([d["text"] for d in kept])))
    centres = mixing.k_means(np.stack(sorted(map(tuple, x[np.abs(x).sum(axis=1) > 0]))), 8)
    rows = [{**d, "topic": int((v @ centres.T).argmax()) if np.abs(v).sum() > 0 else -1, "n_tokens": len(brute.words(d["text"]))} for d, v in zip(kept, x, strict=True)]
    draw = brute.mix(rows)
    want = {d["doc_id"]: d["text"] for d in kept if draw[d["doc_id"]][1]}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: r.text for i, r in got.items()} == want and 0 < len(want) < len(docs)
    v = sentencepiece_codec.load_vocabulary(sentencepiece_codec.default_path())
    for i, r in got.items():
        own, per = sentencepiece_codec.encode(v, pa.array([want[i]], pa.string()))
        assert r.ids == (own.tolist() if want[i] is not None else None) and r.n_pieces == per[0]
        assert sentencepiece_codec.decode_texts(v, [r.ids])[0] == want[i]


def test_pipeline_edges(spark, tmp_path):
    """Nulls in any column, repeated rows, further columns, and empty tables."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, "one two three", "en", "a", "m"), (1, "one two three", "en", "a", "m"), (2, None, None, None, None), (None, "no id", "en", "a", "m"), (3, "", "fr", "b", "m"), (4, "w " * 5000, "en", "a", "m")]
    d = spark.createDataFrame(rows, SCHEMA + ", kept string")
    lab = spark.createDataFrame([(1, 1, 0), (None, 1, None), (4, None, 0)], "doc_id long, quality int, toxic int")
    for name, docs, labels in (("some", d, lab), ("unlabelled", d, lab.limit(0)), ("empty", d.limit(0), lab.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        got = out.collect()
        assert "kept" in out.columns and {r.doc_id for r in got} <= {1, 2, 3, 4, None}
        assert bool(got) == (name != "empty") and all(r.ids is None or r.n_pieces == len(r.ids) for r in got)
