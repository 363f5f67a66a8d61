"""Plain versions of the corpus operators for small fixtures: dictionaries and loops, no numpy and no Spark."""

import collections
import math
import re
import struct

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class I32(int):
    """A number that Spark hashes as an int."""


def xx(*values) -> int:
    """Spark's xxhash64: each value is hashed with the hash before as seed; nulls are passed over."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, I32) else "<q", v), h)
    return h - (1 << 64) if h >> 63 else h


def words(text, lower: bool = True) -> list[str]:
    t = text or ""
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t) if lower else t)


def discounts(counts: list[int]) -> list[float]:
    n = [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
    if 0 in n[:3]:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return [min(max(x, 0.05), top) for x, top in zip(d, (0.95, 1.9, 2.9), strict=True)]


class KneserNey:
    """Interpolated modified Kneser-Ney: own counts of each class at the highest order, shared continuation counts below."""

    def __init__(self, grams: dict[tuple, list[int]], n_symbols: int, pad):
        self.n_symbols, self.pad, self.order = n_symbols, pad, len(next(iter(grams)))
        self.levels = {self.order: grams}
        for n in range(self.order - 1, 0, -1):
            self.levels[n] = {g: [c] for g, c in collections.Counter(g[1:] for g in self.levels[n + 1]).items()}
        self.d = {n: discounts([sum(c) for g, c in level.items() if g[-1] != pad]) for n, level in self.levels.items()}
        self.total, self.free = collections.defaultdict(float), collections.defaultdict(float)
        for n, level in self.levels.items():
            for g, cs in level.items():
                for k, c in enumerate(cs):
                    if c and g[-1] != pad:
                        self.total[n, g[:-1], k] += c
                        self.free[n, g[:-1], k] += self.d[n][min(c, 3) - 1]

    def p(self, gram: tuple, k: int = 0) -> float:
        n = len(gram)
        if not n:
            return 1 / self.n_symbols
        own = k if n == self.order else 0
        total = self.total.get((n, gram[:-1], own), 0)
        low = self.p(gram[1:], k)
        if not total:
            return low
        c = self.levels[n].get(gram, [0] * (own + 1))[own]
        return (max(c - self.d[n][min(c, 3) - 1], 0) if c else 0) / total + self.free[n, gram[:-1], own] / total * low


def shape(word: str) -> str:
    kind = lambda b: "a" if chr(b).islower() and b < 128 or b >= 128 else "A" if 65 <= b <= 90 else "0" if 48 <= b <= 57 else chr(b)
    return re.sub(r"(.)\1+", r"\1", "".join(kind(b) for b in word.encode()), flags=re.S)


def quality(docs: list[dict], trusted: set[int], quantile: float = 0.995, min_trusted: int = 30) -> list[dict]:
    """(doc_id, n_tokens, log_perplexity, threshold, kept) for rows of a fixture whose frequent words and shapes are all known."""
    side = {i: xx(I32(11), i) % 2 for i in trusted}
    sample = [min(d["text"] or "" for d in docs if d["doc_id"] == i) for i in {d["doc_id"] for d in docs} if side.get(i) == 0]
    count = collections.Counter(w for t in sample for w in words(t, False))
    kinds = collections.Counter(shape(w) for t in sample for w in words(t, False))
    known, shapes = {w for w, c in count.items() if c >= 3}, {s for s, c in kinds.items() if c >= 3}
    assert len(known) <= 300 and len(shapes) <= 200

    def sequence(text):
        w = words(text, False)
        own = ["<again>" if i and w[i - 1] == x else ("w", x) if x in known else ("s", shape(x)) if shape(x) in shapes else "<unknown>" for i, x in enumerate(w)]
        return ["<pad>", "<pad>", *own, "<end>"]

    grams = collections.defaultdict(lambda: [0])
    for t in sample:
        s = sequence(t)
        for i in range(2, len(s)):
            grams[tuple(s[i - 2 : i + 1])][0] += 1
    model = KneserNey(dict(grams), 3 + len(known) + len(shapes), "<pad>")
    out = []
    for d in docs:
        s = sequence(d["text"])
        out.append({**d, "n_tokens": len(s) - 2, "log_perplexity": -sum(math.log(model.p(tuple(s[i - 2 : i + 1]))) for i in range(2, len(s))) / (len(s) - 2)})

    def limit(rows):
        bins = sorted(math.floor(round(r["log_perplexity"], 9) * 1000) for r in rows)
        return (next(b for i, b in enumerate(bins) if i + 1 >= quantile * len(bins) and (i + 1 == len(bins) or bins[i + 1] > b)) + 1) / 1000

    held = [r for r in out if side.get(r["doc_id"]) == 1]
    by_lang = collections.defaultdict(list)
    for r in held:
        by_lang[r["lang"]].append(r)
    for r in out:
        own = by_lang[r["lang"]]
        r["threshold"] = limit(own if len(own) >= min_trusted else held)
        r["kept"] = r["log_perplexity"] <= r["threshold"]
    return out


def dedup_lines(docs: list[dict]) -> list[dict]:
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for d in docs:
        for line in (d["text"] or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(d["doc_id"])
    gone = lambda line, i: len(holders.get(key(line), ())) >= 3 and max(holders[key(line)]) != i
    return [{**d, "text": "\n".join(x for x in (d["text"] or "").split("\n") if not gone(x, d["doc_id"])) if d["text"] else d["text"]} for d in docs]


def mix(rows: list[dict], keep: float = 0.6, temper: float = 0.5, seed: int = 1) -> dict[int, tuple[float, bool]]:
    """doc_id -> (probability, kept) from rows with source, lang, topic and n_tokens."""
    cell = lambda r: (r["source"], r["lang"], r["topic"])
    tokens = collections.Counter()
    for r in rows:
        tokens[cell(r)] += r["n_tokens"]
    total = sum(tokens.values())
    wants = []
    for d in range(3):
        have = collections.Counter()
        for c, t in tokens.items():
            have[c[d]] += t
        raw = {v: (t / total) ** temper if t else 0 for v, t in have.items()}
        wants.append({v: x / sum(raw.values()) for v, x in raw.items()})
    fit = {c: t / total for c, t in tokens.items()}
    for _ in range(200):
        worst = 0
        for d, want in enumerate(wants):
            have = collections.Counter()
            for c, x in fit.items():
                have[c[d]] += x
            worst = max([worst, *(abs(have[v] - want[v]) for v in want if have[v] > 0)])
            fit = {c: x * want[c[d]] / have[c[d]] if have[c[d]] else x for c, x in fit.items()}
        if worst < 1e-9:
            break
    weight = {c: fit[c] * total / t if t else 0 for c, t in tokens.items()}
    low, high = 0.0, 1e9
    for _ in range(200):
        s = (low + high) / 2
        low, high = (s, high) if sum(t * min(1, s * weight[c]) for c, t in tokens.items()) < keep * total else (low, s)
    draw = lambda i: (xx(I32(seed), i) & ((1 << 52) - 1)) / (1 << 52)
    p = lambda r: 1.0 if not tokens[cell(r)] else min(1.0, high * weight[cell(r)])
    return {r["doc_id"]: (p(r), draw(r["doc_id"]) < p(r)) for r in rows}


def rule_scores(docs: list[dict], trusted: set[int], buckets: int = 1 << 14) -> dict[int, float]:
    """doc_id -> mean log ratio of hashed word ends and word pairs."""

    def hashed(text):
        h = [xx(w) for w in words(text, False)]
        return [x & (buckets - 1) for x in [*(xx(w[-2:]) for w in words(text, False)), *(xx(a, b) for a, b in zip(h, h[1:], strict=False))]]

    n, m = collections.Counter(), collections.Counter()
    for d in docs:
        n.update(hashed(d["text"]))
        if d["doc_id"] in trusted:
            m.update(hashed(d["text"]))
    a, b = sum(m.values()) + buckets, sum(n.values()) + buckets
    w = [round(math.log((m[i] + 1) / a) - math.log((n[i] + 1) / b), 6) for i in range(buckets)]
    return {d["doc_id"]: sum(w[i] for i in hashed(d["text"])) / max(1, len(hashed(d["text"]))) for d in docs}
