"""Interpolated modified Kneser-Ney estimates over a bounded set of counted n-grams.

The n-grams come out of Spark as distinct rows of symbols with a count for each class; their number is bounded by
the training sample. Lower orders use continuation counts shared by all classes; only the highest order is counted
for each class. A class's log-probability of a text is a sum of weights of the text's own n-grams:

    log p(w | h) = log g(h) + log g(h') + ... + log p(w)   if nothing longer was seen, and each seen n-gram (h, w)
    corrects that sum by  d(h, w) = log p(w | h) - log g(h) - log p(w | h').

Here g(h) is the backoff mass of a seen history, 1 otherwise. An n-gram's weight is its correction plus, as it is the
history of the next symbol, log g of itself. Scoring is then a join of a text's n-grams with a table of weights, in
which an n-gram that is missing adds 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BITS = 16
"""Bits for each symbol in a packed n-gram key: symbols are 0 to 65535 and an order fits for up to 3 of them; byte models use 8."""


def discounts(counts: np.ndarray) -> np.ndarray:
    """D1, D2 and D3+ from the numbers of n-grams counted once to four times; usual values where these are too few."""
    return discounts_of(np.bincount(np.minimum(counts.astype(np.int64), 5), minlength=6)[1:5].astype(float))


def discounts_of(n: np.ndarray) -> np.ndarray:
    """The same from these four numbers."""
    if (n[:3] <= 0).any():
        return np.array([0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    d = np.array([1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]])
    return np.clip(d, 0.05, [0.95, 1.9, 2.9])


def pack(rows: np.ndarray, bits: int) -> np.ndarray:
    """One key for each row of symbols: the order, then the symbols."""
    key = np.full(len(rows), 1, np.int64)
    for i in range(rows.shape[1]):
        key = (key << bits) | rows[:, i]
    return key


@dataclass
class Weights:
    """Sorted keys (packed n-grams of all orders) and, for each, one weight a class; ``unseen`` is the weight of a symbol that was never counted."""

    keys: np.ndarray
    weight: np.ndarray
    count: np.ndarray
    unseen: float
    top_keys: np.ndarray
    top_p: np.ndarray
    """Sorted packed n-grams of the highest order and their probabilities, one column a class."""


def _level(hist: np.ndarray, counts: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(discounted share of each n-gram, backoff mass of its history) for histories numbered 0.. in ``hist``."""
    m = int(hist.max()) + 1 if len(hist) else 0
    total = np.bincount(hist, weights=counts, minlength=m)
    kind = np.minimum(counts, 3).astype(np.int64)
    cut = np.concatenate([[0.0], d])[kind]
    free = np.bincount(hist, weights=np.where(counts > 0, cut, 0), minlength=m)
    safe = np.where(total > 0, total, 1)
    return np.maximum(counts - cut, 0) / safe[hist], np.where(total > 0, free / safe, 1.0)


def estimate(grams: np.ndarray, counts: np.ndarray, bits: int, n_symbols: int, pad: int = 0) -> Weights:
    """Weights from distinct n-grams (m, order) and their counts (m, classes).

    ``pad`` fills the beginning of a text; it is a history but never predicted. ``n_symbols`` is the size of the
    closed alphabet that the lowest order spreads its backoff mass over.
    """
    order, classes = grams.shape[1], counts.shape[1]
    keys, weights, numbers = [], [], []
    # levels[n]: distinct n-grams and their counts; lower ones are continuation counts over all classes
    levels = {order: (grams, counts.astype(float))}
    for n in range(order - 1, 0, -1):
        up = levels[n + 1][0]
        rows, c = np.unique(up[:, 1:], axis=0, return_counts=True)
        levels[n] = (rows, c[:, None].astype(float))
    prev_keys = prev_p = None
    unseen = 0.0
    for n in range(1, order + 1):
        rows, c = levels[n]
        key = pack(rows, bits)
        by = np.argsort(key)
        rows, c, key = rows[by], c[by], key[by]
        if n == 1:
            real = rows[:, 0] != pad
            cc = np.where(real, c[:, 0], 0)
            d = discounts(cc[cc > 0])
            share, mass = _level(np.zeros(len(cc), np.int64), cc, d)
            free = mass[0] / n_symbols if len(mass) else 1 / n_symbols
            p = np.where(real, share + free, 1.0)
            unseen = float(np.log(free)) if free > 0 else -30.0
            w = np.where(real, np.log(p), 0.0)[:, None].repeat(classes, 1)
            keys.append(key), weights.append(w), numbers.append(c.sum(1))
            prev_keys, prev_p = key, p[:, None]
        else:
            hist_key = pack(rows[:, :-1], bits)
            hist_u, hist = np.unique(hist_key, return_inverse=True)
            low = prev_p[np.searchsorted(prev_keys, pack(rows[:, 1:], bits))]
            ends_pad = rows[:, -1] == pad
            ps, ws = [], []
            gs = []
            d = discounts(c.sum(1)[~ends_pad]) if (~ends_pad).any() else np.array([0.5, 0.75, 0.9])
            for k in range(c.shape[1]):
                ck = np.where(ends_pad, 0, c[:, k])
                share, mass = _level(hist, ck, d)
                lo = low[:, min(k, low.shape[1] - 1)]
                p = share + mass[hist] * lo
                with np.errstate(divide="ignore"):
                    w = np.where(ck > 0, np.log(np.maximum(p, 1e-300)) - np.log(np.maximum(mass[hist], 1e-300)) - np.log(np.maximum(lo, 1e-300)), 0.0)
                ps.append(np.where(ends_pad, 1.0, p))
                ws.append(w)
                gs.append(np.log(np.maximum(mass, 1e-300)))
            w, g = np.stack(ws, 1), np.stack(gs, 1)
            if w.shape[1] < classes:
                w, g = w.repeat(classes, 1), g.repeat(classes, 1)
            # log g of a history belongs to the history's own key, one order lower
            at = np.searchsorted(keys[-1], hist_u)
            hit = (at < len(keys[-1])) & (keys[-1][np.minimum(at, len(keys[-1]) - 1)] == hist_u)
            weights[-1][at[hit]] += g[hit]
            keys[-1] = np.concatenate([keys[-1], hist_u[~hit]])
            weights[-1] = np.concatenate([weights[-1], g[~hit]])
            numbers[-1] = np.concatenate([numbers[-1], np.zeros((~hit).sum())])
            by = np.argsort(keys[-1])
            keys[-1], weights[-1], numbers[-1] = keys[-1][by], weights[-1][by], numbers[-1][by]
            keys.append(key), weights.append(w), numbers.append(c.sum(1))
            prev_keys, prev_p = key, np.stack(ps, 1)
    k, w, m = np.concatenate(keys), np.concatenate(weights), np.concatenate(numbers)
    by = np.argsort(k)
    return Weights(k[by], w[by], m[by], unseen, prev_keys, prev_p)


@dataclass
class TopLevel:
    """What the highest order needs of the orders below, for n-grams too many for one machine: each n-gram's weight follows from
    its own count, by ``weigh``. ``hist``: sorted keys of histories; ``lower``: probabilities of one order less by sorted keys."""

    hist: np.ndarray
    total: np.ndarray
    mass: np.ndarray
    lower_keys: np.ndarray
    lower_p: np.ndarray
    d: np.ndarray

    def weigh(self, hist: np.ndarray, lower: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hist, hist)
        low = self.lower_p[np.searchsorted(self.lower_keys, lower)]
        cut = np.concatenate([[0.0], self.d])[np.minimum(counts, 3)]
        p = np.maximum(counts - cut, 0) / self.total[at] + self.mass[at] * low
        return np.log(np.maximum(p, 1e-300)) - np.log(np.maximum(self.mass[at], 1e-300)) - np.log(np.maximum(low, 1e-300))


def estimate_below(grams: np.ndarray, continuations: np.ndarray, hist: np.ndarray, total: np.ndarray, kinds: np.ndarray, numbers: np.ndarray, bits: int, n_symbols: int, pad: int = 0) -> tuple[Weights, TopLevel]:
    """``estimate`` of one class in two steps, from counts that are bounded by the alphabet: n-grams of one order less with their
    continuation counts; sorted keys of the histories with their total counts and numbers of n-grams counted once, twice and more
    often; ``numbers`` of n-grams counted once to four times. The weights of the lower orders, and the rest for the highest."""
    low = estimate(grams, continuations[:, None], bits, n_symbols, pad)
    d = discounts_of(numbers.astype(float))
    mass = (kinds * d).sum(axis=1) / total
    g = np.log(np.maximum(mass, 1e-300))[:, None]
    at = np.minimum(np.searchsorted(low.keys, hist), len(low.keys) - 1)
    hit = low.keys[at] == hist
    low.weight[at[hit]] += g[hit]
    keys, weight, count = (np.concatenate(x) for x in ((low.keys, hist[~hit]), (low.weight, g[~hit]), (low.count, np.zeros((~hit).sum()))))
    by = np.argsort(keys)
    return Weights(keys[by], weight[by], count[by], low.unseen, low.top_keys, low.top_p), TopLevel(hist, total, mass, low.top_keys, low.top_p[:, 0], d)


def lookup(keys: np.ndarray, weight: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Weight of each wanted key, 0 where it is missing."""
    if not len(keys):
        return np.zeros((len(want), *weight.shape[1:]))
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    hit = keys[at] == want
    return np.where(hit.reshape(-1, *[1] * (weight.ndim - 1)), weight[at], 0)
