"""Fuzzy substring dedup (operator 4): seeds, collinear chains, alignment.

Seeds are five-word shingles picked as minimisers of ``WINDOW`` shingles, so that every run of ``WINDOW`` + 4 words gives
one. Each occurrence of a seed is matched with that in every other document that has the seed if these are few, else with the
RECENT documents before it and the first; where no passage comes of that, the rest is searched (``left_over``). A word that is
settled by one partner is not compared with others: ``passages`` names one partner for each, not all pairs of copies.
Matches of two documents are chained: a chain is a rise in both positions with a
linear gap cost, and the best chain that a match can end is found through a Fenwick tree of prefix maxima
(where all matches of a pair rise already, no tree is needed). Chains are then aligned word by word: along the diagonal where that explains them, else between rising three-word anchors, and by banded
local alignment where there is no anchor. Similarity is the number of words that a gap-aware alignment (one rising match of
both texts) pairs, over the longer side; a passage is reported for both documents if it has at least ``min_words`` words
and a similarity of ``threshold``.

Scale: seeds are range-partitioned by (seed, document) and matched there, in one pass. Occurrences of crowded seeds that no passage
settles meet all documents that share two such seeds at a like distance, in tiles of some ``TILE`` documents by all; couples that
have the same documents (those of one line) count once, and runs of one word meet the longest one before and after them. Pairs of documents that
share two crowded seeds, but no passage, still grow with the square of their number. Windows that share too few words are not aligned.
Chains of a pair of documents are a small group. Windows of
words, not texts, are joined to the chains; those of a document with many partners are a hot key of that join, which is
left to adaptive execution.

Defined cases: texts of any length are read whole; an empty table gives an empty result; of equal chains the longest is
aligned, of equal partners the smallest id is named; null, empty and short texts, and rows without an id, have no passages; of rows
that repeat an id the smallest of the words at a place are compared; repeats inside one document are not passages of this operator; columns named as a result column are
replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import saved, small_batches, without
from .text import Words, mix, slices

WIDTH, WINDOW = 5, 3
GAP = 0.1
TIE = 1e-9
RECENT = 2
TILE = 256
HOT_BITS = 1 << 26
FEW = 1 << 19
PER_TASK = 1 << 13
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MIN_CHAIN_WORDS = 12
REACH = 128
PAD = 16
CHAIN = ["a", "b", "x0", "x1", "y0", "y1", "shift", "h", "x", "y"]
RESULT = ["n_passages", "n_repeated_words", "n_copied_words", "passages"]


def seeds(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, word position) of the minimisers of each text."""
    h, at = w.ngrams(WIDTH)
    if not len(h):
        return h, at, at
    row = w.doc[at]
    span = np.minimum(WINDOW, len(h))
    view = np.lib.stride_tricks.sliding_window_view(h, span)
    inside = row[: len(view)] == row[span - 1 :]
    picked = [np.flatnonzero(inside) + view[inside].argmin(axis=1)]
    # texts with fewer shingles than a window give their smallest one
    have, first, n = np.unique(row, return_index=True, return_counts=True)
    few = np.flatnonzero(n < WINDOW)
    if len(few):
        order = np.lexsort((h, row))
        picked.append(order[np.searchsorted(row[order], have[few])])
    i = np.unique(np.concatenate(picked))
    return h[i], row[i], at[i] - w.first[row[i]]


class Fenwick:
    """Prefix maxima of (score, match) over ranks."""

    def __init__(self, n: int):
        self.n, self.tree = n, [(-1e18, -1)] * (n + 1)

    def add(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i <= self.n:
            if value > self.tree[i]:
                self.tree[i] = value
            i += i & -i

    def best(self, i: int) -> tuple[float, int]:
        """Largest value of ranks below i."""
        out = (-1e18, -1)
        while i > 0:
            if self.tree[i] > out:
                out = self.tree[i]
            i -= i & -i
        return out


def chains(pa_: np.ndarray, pb: np.ndarray) -> list[list[int]]:
    """Disjoint collinear chains of matches, best first. A chain's score is WIDTH for each match less
    GAP * (distance in both texts) between neighbours; a match starts a chain where none before it helps."""
    order = np.lexsort((pb, pa_))
    ranks = np.unique(pb, return_inverse=True)[1]
    tree, score, back = Fenwick(int(ranks.max()) + 1), [0.0] * len(pa_), [-1] * len(pa_)
    a, b, r = pa_.tolist(), pb.tolist(), ranks.tolist()
    waiting: list[int] = []
    for i in order.tolist():
        if waiting and a[waiting[0]] < a[i]:  # matches at the same position of the first text don't chain
            for j in waiting:
                tree.add(r[j], (score[j] + GAP * (a[j] + b[j]), j))
            waiting = []
        s, j = tree.best(r[i])
        s -= GAP * (a[i] + b[i])
        score[i], back[i] = (WIDTH + s, j) if j >= 0 and s > 0 else (float(WIDTH), -1)
        waiting.append(i)
    used, out = [False] * len(a), []
    for i in sorted(range(len(a)), key=lambda x: -score[x]):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = back[i]
        if len(path) > 1:
            out.append(path[::-1])
    return out


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Narrow rows in tables of at least ``rows`` (the last may have fewer): the session's batches are small, for long texts."""
    parts, n = [], 0
    for b in batches:
        parts.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(parts)
            parts, n = [], 0
    if n:
        yield pa.Table.from_batches(parts)


def matched_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, x, y): each occurrence of a seed with those of the RECENT documents before it and of the first of its stretch;
    the k-th occurrence in one text goes with the k-th in the other, or its last. Rows are sorted by seed, id, position.

    A batch begins with what the next rows of its last seed may still need: the first document and the last RECENT + 1."""
    held = None
    for batch in gathered(batches):
        rows = batch if held is None else pa.concat_tables([held, batch])
        rows = rows.combine_chunks()
        fresh = 0 if held is None else held.num_rows
        h, ids = np.asarray(rows.column("h")), rows.column("id").combine_chunks()
        n = len(h)
        seed_edge = np.concatenate([[True], h[1:] != h[:-1]])
        doc_edge = seed_edge | np.concatenate([[True], np.asarray(pc.not_equal(ids[1:], ids[:-1]).cast(pa.uint8())).astype(bool)])
        start = np.flatnonzero(doc_edge)
        size = np.diff(np.append(start, n))
        run = np.cumsum(doc_edge) - 1
        first_run = np.maximum.accumulate(np.where(seed_edge[start], np.arange(len(start)), 0))
        at = np.arange(fresh, n)
        own, k = run[at], at - start[run[at]]
        first = first_run[own]
        parts = []
        for back in (*range(1, RECENT + 1), 0):
            partner = own - back if back else first
            ok = partner >= first if back else own - first > RECENT
            row, other = at[ok], partner[ok]
            parts.append((row, start[other] + np.minimum(k[ok], size[other] - 1)))
        row, other = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(row):
            pos = rows.column("pos").combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), ids.take(pa.array(other)), pos.take(pa.array(row)), pos.take(pa.array(other))], ["a", "b", "x", "y"])
        last = int(first_run[-1])
        kept = sorted({last, *range(max(last, len(start) - RECENT - 1), len(start))})
        held = rows.take(pa.array(np.concatenate([np.arange(start[r], start[r] + size[r]) for r in kept])))


def seed_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Table]]:
    """Rows sorted by seed, id, position: (those of seeds of at most RECENT + 2 documents, those of all others and of
    the first and last seed, which other partitions may have too). ``lead`` of the latter says that no smaller id has the seed;
    it is false where another partition may have one."""
    held, open_h, first_h = None, None, None

    def parted(rows: pa.Table, ended: bool) -> tuple[pa.Table, pa.Table, pa.Table]:
        """(rows of few documents, of many, of a last seed that may go on)."""
        nonlocal open_h, first_h
        h, ids = np.asarray(rows.column("h").combine_chunks()), rows.column("id").combine_chunks()
        seed_edge = np.concatenate([[True], h[1:] != h[:-1]])
        doc_edge = seed_edge | np.concatenate([[True], np.asarray(pc.not_equal(ids[1:], ids[:-1]).cast(pa.uint8())).astype(bool)])
        if first_h is None:
            first_h = h[0]
        run = np.cumsum(seed_edge) - 1
        cut = (h == first_h) | (False if open_h is None else h == open_h)
        many = (np.bincount(run, weights=doc_edge) > RECENT + 2)[run] | cut
        last = h == h[-1]
        if ended:
            many |= last
        wait = last & ~many
        open_h = h[-1] if many[-1] else None
        docs = np.cumsum(doc_edge)
        lead = (docs == docs[np.flatnonzero(seed_edge)][run]) & ~cut
        crowd = rows.append_column("lead", pa.array(lead.astype(np.int32))).filter(pa.array(many))
        return rows.filter(pa.array(~many & ~wait)), crowd, rows.filter(pa.array(wait))

    for batch in gathered(batches):
        few, many, held = parted(batch if held is None else pa.concat_tables([held, batch]), False)
        yield few, many
    if held is not None and held.num_rows:
        yield parted(held, True)[:2]


def occurrences(many: pa.Table, lead: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows of crowded seeds as (a, null, x, null or lead, h)."""
    for b in many.combine_chunks().to_batches() if many.num_rows else ():
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.nulls(n, b.schema.field("id").type), b.column("pos"), b.column("lead") if lead else pa.nulls(n, pa.int32()), b.column("h")], ["a", "b", "x", "y", "h"])


def split_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by seed, id, position: (a, b, x, y) of all matches of seeds of at most RECENT + 2 documents, where
    ``matched_seeds`` leaves none out; occurrences of all others as (a, null, x, null, h)."""
    for few, many in seed_parts(batches):
        for b in matched_seeds(iter(few.combine_chunks().to_batches())) if few.num_rows else ():
            yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.int64())], ["a", "b", "x", "y", "h"])
        yield from occurrences(many)


def linked_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matches of ``matched_seeds`` for all seeds (h is 0 for those of few documents, else null), and beside them the
    occurrences of crowded seeds as (a, null, x, lead, h)."""
    ready: list[pa.RecordBatch] = []

    def read() -> Iterator[pa.RecordBatch]:
        for few, many in seed_parts(batches):
            for b in matched_seeds(iter(few.combine_chunks().to_batches())) if few.num_rows else ():
                ready.append(pa.RecordBatch.from_arrays([*b.columns, pa.array(np.zeros(b.num_rows, np.int64))], ["a", "b", "x", "y", "h"]))
            ready.extend(occurrences(many, lead=True))
            yield from many.drop_columns("lead").combine_chunks().to_batches() if many.num_rows else ()

    for b in matched_seeds(read()):
        yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.int64())], ["a", "b", "x", "y", "h"])
        while ready:
            yield ready.pop()
    while ready:
        yield ready.pop()


def matched_crowds(rows: DataFrame) -> DataFrame:
    """(a, b, x, y) of all documents a > b of each seed of (h, id, pos): the k-th occurrence in one text goes with the k-th in the
    other, or its last. A seed's documents are dealt to tiles, each of which meets all of them."""
    docs = stored(rows.groupBy("h", "id").agg(F.sort_array(F.collect_list("pos")).alias("at")))
    tiles = docs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", F.ceil(F.col("n") / TILE).cast("int").alias("n"))
    docs = docs.join(tiles, "h")
    left = docs.select("h", F.col("id").alias("a"), F.col("at").alias("xs"), F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("tile"))
    right = docs.select("h", F.col("id").alias("b"), F.col("at").alias("ys"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("tile"))
    both = left.join(right, ["h", "tile"]).where("a > b")
    return both.select("a", "b", "ys", F.posexplode("xs").alias("k", "x")).select("a", "b", "x", F.expr("ys[least(k, size(ys) - 1)]").alias("y"))


def rising_chains(x: list[int], y: list[int]) -> list[list[int]] | None:
    """``chains`` where both positions rise from each match to the next, without a tree: None if they don't. The best match to
    come from is then the one before, as gap costs add up and each match on the way brings its words. Of equal ends the
    longest chain counts."""
    score, starts = [float(WIDTH)], [0]
    for i in range(1, len(x)):
        dx, dy = x[i] - x[i - 1], y[i] - y[i - 1]
        if dx <= 0 or dy <= 0:
            return None
        rest = score[-1] - GAP * (dx + dy)
        if rest <= -TIE:
            starts.append(i)
        score.append(WIDTH + max(0.0, rest))
    out, todo = [], list(zip(starts, [*starts[1:], len(x)], strict=True))
    while todo:
        s, e = todo.pop()
        if e - s < 2:
            continue
        best = max(score[s:e]) - TIE
        top = next(i for i in range(e - 1, s - 1, -1) if score[i] >= best)
        if top > s:
            out.append(list(range(s, top + 1)))
        todo.append((top + 1, e))
    return out


def windows_of(x: np.ndarray, y: np.ndarray, min_words: int) -> list[tuple[int, int, int, int, int]]:
    """(x0, x1, y0, y1, shift) of the chains of a pair's matches, sorted by (x, y): their words and PAD at both ends. Windows
    of under ``min_words`` words have no passage."""
    px, py, out = x.tolist(), y.tolist(), []
    rising = rising_chains(px, py)
    for c in chains(x.astype(np.int64), y.astype(np.int64)) if rising is None else rising:
        x0, x1, y0, y1 = px[c[0]], px[c[-1]] + WIDTH, py[c[0]], py[c[-1]] + WIDTH
        if min(x1 - x0, y1 - y0) >= MIN_CHAIN_WORDS and min(x1 - max(0, x0 - PAD), y1 - max(0, y0 - PAD)) + PAD >= min_words:
            out.append((max(0, x0 - PAD), x1 + PAD, max(0, y0 - PAD), y1 + PAD, y0 - max(0, y0 - PAD) - (x0 - max(0, x0 - PAD))))
    return out


def common_matches(ha: np.ndarray, xa: np.ndarray, hb: np.ndarray, yb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of all seeds that two documents share: the k-th occurrence in one goes with the k-th in the other, or its last."""
    i, j = np.lexsort((xa, ha)), np.lexsort((yb, hb))
    ha, xa, hb, yb = ha[i], xa[i], hb[j], yb[j]
    k = np.arange(len(ha)) - np.searchsorted(ha, ha)
    low, high = np.searchsorted(hb, ha), np.searchsorted(hb, ha, side="right")
    ok = high > low
    return xa[ok], yb[(low + np.minimum(k, high - low - 1))[ok]]


def word_runs(doc: np.ndarray, h: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Number of each seed's run of one word, where a seed follows itself at the next word. Rows are sorted by document, position."""
    return np.cumsum(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (np.diff(pos) != 1)])[: len(h)]) - 1


def seed_couples(doc: np.ndarray, h: np.ndarray, pos: np.ndarray, state: np.ndarray, least: int, ratio: float, short: int) -> tuple[np.ndarray, ...]:
    """(document, key, open, step, run, pos) of every two crowded seeds of a document, in their order, that begin ``least`` to REACH words
    apart, where one is open (2) or has open occurrences elsewhere (1). Couples whose distances are in a proportion of ``ratio`` at
    most have the same or neighbouring steps. Two of one run of a word are no couple: a run of ``short`` seeds and more is a row with
    their number (``run``, 0 in couples) and its position; the inner ones of its seeds stand for their neighbours."""
    order = np.lexsort((pos, doc))
    doc, h, pos, state = doc[order], h[order], pos[order], state[order]
    run = word_runs(doc, h, pos)
    begin = np.flatnonzero(np.diff(run, prepend=-1))
    size = np.bincount(run)
    top = np.maximum.reduceat(state, begin) if len(run) else state
    long = (size >= short) & (top > 0)
    rows = (doc[begin[long]], mix(h[begin[long]].view(np.uint64)), top[long] == 2, np.zeros(long.sum(), np.int64), size[long], pos[begin[long]])
    nth = np.arange(len(run)) - begin[run]
    kept = (np.minimum(nth, size[run] - 1 - nth) <= PAD) | (nth % WIDTH == 0)
    state = np.where(size[run] > 1, top[run], state)
    doc, h, pos, state, run = (z[kept] for z in (doc, h, pos, state, run))
    place = (doc << 32) + pos
    u = h.view(np.uint64)
    parts = []
    hot = np.flatnonzero(state > 0)
    for back in (True, False):
        at = place[hot]
        low, high = (np.searchsorted(place, at - REACH), np.searchsorted(place, at - least, side="right")) if back else (np.searchsorted(place, at + least), np.searchsorted(place, at + REACH, side="right"))
        n = np.maximum(high - low, 0)
        own = np.repeat(hot, n)
        other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        own, other = (z[run[own] != run[other]] for z in (own, other))
        first, second = (other, own) if back else (own, other)
        step = np.floor(np.log(pos[second] - pos[first]) / np.log(ratio)).astype(np.int64)
        parts.append((doc[own], mix(mix(u[first]) * np.uint64(3) + u[second]), np.maximum(state[own], state[other]) == 2, step))
    of, key, opened, step = (np.concatenate(c) for c in zip(*parts, strict=True))
    _, first, at = np.unique(key ^ mix(mix(of.view(np.uint64)) + step.view(np.uint64)), return_index=True, return_inverse=True)
    flag = np.bincount(at, weights=opened, minlength=len(first)) > 0
    none = np.zeros(len(first), np.int64)
    cols = zip((of[first], key[first], flag, step[first], none, none), rows, strict=True)
    of, key, flag, step, size, at = (np.concatenate(c) for c in cols)
    return of, key.view(np.int64), flag, step.astype(np.int32), size.astype(np.int32), at.astype(np.int32)


def best_run(same: np.ndarray) -> tuple[int, int, int]:
    """(start, end, equal words) of the stretch with the largest sum of +1 for equal and -2 for other words."""
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    low = np.minimum.accumulate(total)
    end = int((total - low).argmax())
    start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
    return start, end, int(same[start:end].sum())


def _local(x: np.ndarray, y: np.ndarray, band: int) -> tuple[int, int, int]:
    """Best local alignment (+1 equal, -1 other, -1 gap) inside a band: (score, end in x, end in y)."""
    w = 2 * band + 1
    j0 = np.arange(w) - band
    prev = np.zeros(w + 1, np.int64)  # prev[k]: column i - 1 + j0[k]; one more on the right
    steps = np.arange(w)
    best = (0, 0, 0)
    for i in range(len(x)):
        j = i + j0
        ok = (j >= 0) & (j < len(y))
        if not ok.any():
            if i - band > len(y):
                break
            prev[:] = 0
            continue
        hit = np.zeros(w, bool)
        hit[ok] = y[j[ok]] == x[i]
        t = np.maximum(np.maximum(prev[:w] + np.where(hit, 1, -1), prev[1:] - 1), 0)
        t[~ok] = 0
        t = np.maximum.accumulate(t + steps) - steps
        t[~ok] = 0
        k = int(t.argmax())
        if t[k] > best[0]:
            best = (int(t[k]), i + 1, int(j[k]) + 1)
        prev[:w] = t
        prev[w] = 0
    return best


def anchors(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Positions of three-word runs that occur once in each text, rising in both; None without any."""
    if min(len(x), len(y)) < 3:
        return None
    runs = []
    for z in (x.astype(np.uint64), y.astype(np.uint64)):
        h = mix(mix(mix(z[:-2]) + z[1:-1]) + z[2:])
        u, first, n = np.unique(h, return_index=True, return_counts=True)
        runs.append((u[n == 1], first[n == 1]))
    _, a, b = np.intersect1d(runs[0][0], runs[1][0], assume_unique=True, return_indices=True)
    if not len(a):
        return None
    i, j = runs[0][1][a], runs[1][1][b]
    order = np.argsort(i)
    i, j = i[order], j[order]
    if (np.diff(j) > 0).all():
        return i, j
    # longest rise in y, with its path
    tails, at, back = [], [], np.full(len(j), -1)
    for k, v in enumerate(j.tolist()):
        p = bisect_left(tails, v)
        back[k] = at[p - 1] if p else -1
        if p == len(tails):
            tails.append(v), at.append(k)
        else:
            tails[p], at[p] = v, k
    path, k = [], at[-1]
    while k >= 0:
        path.append(k)
        k = int(back[k])
    return i[path[::-1]], j[path[::-1]]


def paired(x: np.ndarray, y: np.ndarray) -> int:
    """Number of words that the best rising match of two texts pairs (their longest common subsequence), bit-parallel."""
    where: dict[int, int] = {}
    for i, v in enumerate(x.tolist()):
        where[v] = where.get(v, 0) | 1 << i
    full = (1 << len(x)) - 1
    state = full
    for v in y.tolist():
        hit = where.get(v)
        if hit:
            u = state & hit
            state = (state + u | state - u) & full
    return len(x) - state.bit_count()


def shared_words(x: np.ndarray, y: np.ndarray) -> int:
    """Number of words that two texts have in common, in any order: no match pairs more."""
    u, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    return int(np.minimum(np.bincount(at[: len(x)], minlength=len(u)), np.bincount(at[len(x) :], minlength=len(u))).sum())


def align(x: np.ndarray, y: np.ndarray, shift: int, least: float = 0) -> tuple[int, int, int, int, float]:
    """(start x, end x, start y, end y, similarity) of the best passage; y begins ``shift`` words after x's diagonal. Texts of
    which no match pairs ``least`` words have none."""
    lo, hi = max(0, -shift), min(len(x), len(y) - shift)
    s, e, n = best_run(x[lo:hi] == y[lo + shift : hi + shift]) if hi > lo else (0, 0, 0)
    if e - s >= max(least, 0.9 * min(len(x), len(y)) - 2 * PAD) and n >= 0.9 * max(e - s, 1):
        return lo + s, lo + e, lo + s + shift, lo + e + shift, n / max(e - s, 1)
    found = anchors(x, y)
    if found is not None:
        i, j = found
        # the passage's ends: each word is compared along the diagonal of the anchor before it and of the anchor after it
        k = np.arange(len(x))
        after = np.minimum(np.searchsorted(i, k), len(i) - 1)
        before = np.maximum(np.searchsorted(i, k, side="right") - 1, 0)
        same = np.zeros(len(x), bool)
        for d in ((j - i)[before], (j - i)[after]):
            at = k + d
            ok = (at >= 0) & (at < len(y))
            same |= ok & (y[np.clip(at, 0, len(y) - 1)] == x)
        s, e, n = best_run(same)
        if e > s:
            sy, ey = max(0, int(s + (j - i)[before][s])), min(len(y), int(e + (j - i)[after][e - 1]))
            return s, e, sy, ey, paired(x[s:e], y[sy:ey]) / max(e - s, ey - sy, 1)
    if least and paired(x, y) < least:
        return 0, 0, 0, 0, 0.0
    band = abs(len(x) - len(y)) + PAD + 8
    score, ex, ey = _local(x, y, band)
    back, bx, by = _local(x[:ex][::-1], y[:ey][::-1], band + abs(ex - ey))
    sx, sy = ex - bx, ey - by
    size = max(bx, by, 1)
    return sx, ex, sy, ey, 1 - (size - min(score, back)) / 2 / size


def stored(df: DataFrame) -> DataFrame:
    """``saved``, after which the shuffle files of the query that filled the table are removed, and not when the driver next collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return saved(df)
    finally:
        conf.set(CLEANUP, before)


def portions(pairs: DataFrame, tasks: int) -> list[DataFrame]:
    """Rows of a stored table of pairs in portions of about PER_TASK for each task: what a join adds to them is on disk for one at a time."""
    k = -(-pairs.count() // (PER_TASK * tasks))
    return [pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(k)) == i) for i in range(k)] if k > 1 else [pairs]


def flat(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a column of lists."""
    c = b.column(name)
    cut = np.asarray(c.offsets)
    values = np.asarray(c.values.slice(int(cut[0]), int(cut[-1] - cut[0])).cast(pa.int64()))
    return cut - cut[0], values


def hot_bits(seeds: DataFrame) -> Broadcast:
    """A bit for the lowest bits of each seed (h), 8 MB: others that share them are a few more couples, which are dropped later."""
    code = F.col("h").bitwiseAND(F.lit(HOT_BITS - 1)) + 1
    found = seeds.select(code.alias("c")).groupBy(F.bitmap_bucket_number("c").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("bits")).toArrow()
    out = np.zeros((HOT_BITS >> 15, 1 << 12), np.uint8)
    for b, bits in zip(found.column("b").to_pylist(), found.column("bits").to_pylist(), strict=True):
        out[b - 1] = np.frombuffer(bits, np.uint8)
    return seeds.sparkSession.sparkContext.broadcast(out.ravel())


def longest_runs(runs: DataFrame) -> DataFrame:
    """Windows of each open run (key, id, open, run, pos) with the longest run of the same word in any smaller id and in any greater one."""
    best = runs.groupBy("key", "id").agg(F.max(F.struct("run", -F.col("pos"))).alias("b")).select("key", "id", F.struct(F.col("b.run").alias("run"), (-F.col("b.col2")).alias("pos"), "id").alias("b"))
    by = W.partitionBy("key").orderBy("id")
    sides = [F.max("b").over(by.rowsBetween(*s)).alias(c) for c, s in (("low", (W.unboundedPreceding, -1)), ("high", (1, W.unboundedFollowing)))]
    open_ = runs.where("open").join(best.select("key", "id", *sides), ["key", "id"])
    both = [open_.select(F.struct("run", "pos", "id").alias("a"), F.col("low").alias("b")), open_.select(F.col("high").alias("a"), F.struct("run", "pos", "id").alias("b"))]
    at = lambda s: F.greatest(F.col(f"{s}.pos") - PAD, F.lit(0))
    end = lambda s: F.col(f"{s}.pos") + F.least("a.run", "b.run") + (WIDTH - 1 + PAD)
    pairs = both[0].union(both[1]).where("a IS NOT NULL AND b IS NOT NULL")
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), at("a").alias("x0"), end("a").alias("x1"), at("b").alias("y0"), end("b").alias("y1"), ((F.col("b.pos") - at("b")) - (F.col("a.pos") - at("a"))).cast("int").alias("shift"))


def left_over(crowd: DataFrame, near: DataFrame, joined: DataFrame, min_words: int, ratio: float, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(windows, pairs) of documents that the first partners of crowded seeds may have missed.

    An occurrence of a crowded seed (lists h, pos, lead of each id) is settled if a passage of ``near`` has it, or ends within PAD words of it: a
    copy, or for the smallest id of the seed any passage. An open one is searched with all documents: its partner shares a
    second seed, from which a chain goes on, and a window of ``min_words`` needs two that lie ``least`` words apart. So either
    both are crowded (pairs that share a couple of seeds, within REACH words) or the pair has been ``joined`` by another seed nearby.
    All crowded seeds of a pair are then matched. Without ``done`` (pairs of an earlier round, not repeated) an open document meets the
    smallest and the largest id that share a couple, which settles most copies; with it, every one that has the couple at a distance
    in a proportion of ``ratio`` at most (a stretch whose ends lie further apart on one side is less similar). A run of one word
    is a passage with every run of ``min_words``: of such runs the first round takes the longest of the smaller and of the greater ids,
    and the second only pairs where one is shorter."""
    least = max(1, min_words - 2 * PAD - WIDTH)
    # seeds of a run of one word: certainly min_words, and possibly the least that a passage pairs (its last two may not be picked)
    long, short = min_words - WIDTH + 1, max(1, int(min_words / ratio) - WIDTH - 1)
    it = crowd.schema["id"].dataType.simpleString()
    cuts = near.groupBy("id").agg(F.collect_set(F.struct("s", "e", "copy")).alias("cuts")).select("id", *[F.col(f"cuts.{c}").alias(c) for c in ("s", "e", "copy")])
    n = int(crowd.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, pos, lead, s, e, copy = (flat(b, c) for c in ("pos", "pos", "lead", "s", "e", "copy"))
            out = np.ones(len(pos[1]), np.int32)
            for i in np.flatnonzero(np.diff(s[0])).tolist():
                own, c = slice(at[0][i], at[0][i + 1]), slice(s[0][i], s[0][i + 1])
                x = pos[1][own, None]
                out[own] = ~((x >= s[1][c] - PAD) & (x + WIDTH <= e[1][c] + PAD) & ((copy[1][c] == 1) | (lead[1][own, None] == 1))).any(axis=1)
            cut = pa.array(at[0].astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("h"), b.column("pos"), pa.ListArray.from_arrays(cut, pa.array(out))], ["id", "h", "pos", "open"])

    docs = stored(crowd.join(cuts, "id", "left").mapInArrow(opened, f"id {it}, h array<long>, pos array<int>, open array<int>"))
    bits = hot_bits(docs.select(F.explode(F.expr("filter(h, (x, i) -> open[i] = 1)")).alias("h")))

    def coupled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (cut, h), (_, pos), (_, state) = (flat(b, c) for c in ("h", "pos", "open"))
            place = h & (HOT_BITS - 1)
            state = np.where(state == 1, 2, bits.value[place >> 3] >> (place & 7) & 1)
            start = 0
            while start < b.num_rows:  # some documents at a time: a seed has many couples
                end = max(start + 1, int(np.searchsorted(cut, cut[start] + (1 << 14), side="right")) - 1)
                s = slice(cut[start], cut[end])
                doc, *rest = seed_couples(np.repeat(np.arange(start, end), np.diff(cut[start : end + 1])), h[s], pos[s], state[s], least, ratio, short)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(doc)), *map(pa.array, rest)], ["id", "key", "open", "step", "run", "pos"])
                start = end

    keys = stored(docs.repartition(n, "id").mapInArrow(coupled, f"id {it}, key long, open boolean, step int, run int, pos int"))
    # couples of one line have the same documents: one of them is enough
    whole, part = F.xxhash64("id", "open", "run", "pos"), F.xxhash64("id", "open", "run", "pos", "step")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("any"), F.min("id").alias("low"), F.max("id").alias("high"), F.when(F.min("step") == F.max("step"), F.bit_xor(whole)).otherwise(F.bit_xor(part)).alias("same"))
    shared = shared.where("low <> high AND any").groupBy("n", "same").agg(F.min(F.struct("key", "low", "high")).alias("k")).select("n", "k.*")
    runs = keys.where(F.col("run") >= long)
    if done is None:
        met = keys.where("open AND run = 0").join(shared, "key").select(F.col("id").alias("one"), F.explode(F.array("low", "high")).alias("two"))
    else:
        keys = keys.join(shared.select("key", F.ceil(F.col("n") / TILE).cast("int").alias("n")), "key").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
        one = keys.where("open").select("key", F.col("id").alias("one"), F.col("run").alias("r1"), F.col("step").alias("s1"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("tile"))
        two = keys.select("key", F.col("id").alias("two"), F.col("run").alias("r2"), F.col("step").alias("s2"), "tile")
        met = one.join(two, ["key", "tile"]).where((F.abs(F.col("s1") - F.col("s2")) <= 1) & ((F.col("r1") == 0) | (F.least("r1", "r2") < long)))
    by_couple = met.where("one <> two").select(F.greatest("one", "two").alias("a"), F.least("one", "two").alias("b"))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of which one document has open occurrences near their matches, with these seeds."""
        for b in batches:
            (cut, h), (_, pos), (_, state) = (flat(b, c) for c in ("h", "pos", "open"))
            row = np.repeat(np.arange(b.num_rows), np.diff(cut))
            s, e = (np.asarray(b.column(c), np.int64)[row] for c in ("s", "e"))
            ok = (state == 1) & (pos >= s - REACH) & (pos <= e + REACH)
            some, first = np.unique(row[ok], return_index=True)
            hs = pa.ListArray.from_arrays(pa.array(np.append(first, ok.sum()).astype(np.int32)), pa.array(h[ok]))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(some)) for c in ("id", "two", "s2", "e2")), hs], ["one", "two", "s2", "e2", "hs"])

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Those of which the other document has one of these seeds near their matches."""
        for b in batches:
            (cut, h), (_, pos), (own, hs) = (flat(b, c) for c in ("h", "pos", "hs"))
            row, at = (np.repeat(np.arange(b.num_rows), np.diff(c)) for c in (cut, own))
            s, e = (np.asarray(b.column(c), np.int64)[row] for c in ("s2", "e2"))
            ok = (pos >= s - REACH) & (pos <= e + REACH)
            key = lambda r, z: mix(z.view(np.uint64)) + mix(r.astype(np.uint64))
            found = pa.array(np.unique(at[np.isin(key(at, hs), key(row[ok], h[ok]))]))
            yield pa.RecordBatch.from_arrays([b.column(c).take(found) for c in ("one", "id")], ["one", "two"])

    def by_other_seed(mine: str, theirs: str, x: str, y: str) -> DataFrame:
        """Pairs of which ``mine`` has an open occurrence near their matches, and ``theirs`` one of the same seed."""
        pairs = joined.select(F.col(mine).alias("id"), F.col(theirs).alias("two"), F.col(f"{x}0").alias("s"), F.col(f"{x}1").alias("e"), F.col(f"{y}0").alias("s2"), F.col(f"{y}1").alias("e2"))
        own = pairs.join(docs, "id").mapInArrow(around, f"one {it}, two {it}, s2 int, e2 int, hs array<long>")
        met = own.withColumnRenamed("two", "id").join(docs.select("id", "h", "pos"), "id").mapInArrow(meeting, f"one {it}, two {it}")
        return met.select(F.col("one").alias(mine), F.col("two").alias(theirs)).select("a", "b")

    todo = by_couple.union(by_other_seed("a", "b", "x", "y")).union(by_other_seed("b", "a", "y", "x")).distinct()
    todo = stored(todo if done is None else todo.join(done, ["a", "b"], "left_anti"))
    side = lambda z: docs.select(F.col("id").alias(z), F.col("h").alias(f"h{z}"), F.col("pos").alias(f"pos{z}"))
    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of each pair's chains over all crowded seeds that it shares, and those by other seeds."""
        for b in batches:
            row, out = [], []
            lists = {c: flat(b, c) for c in ("ha", "posa", "hb", "posb", "x", "y")}
            for i in range(b.num_rows):
                part = lambda c: lists[c][1][lists[c][0][i] : lists[c][0][i + 1]]  # noqa: B023, E731
                x, y = common_matches(*(part(c) for c in ("ha", "posa", "hb", "posb")))
                x, y = (np.concatenate([z, part(c)]) for z, c in ((x, "x"), (y, "y")))
                if len(x) > 1:
                    order = np.lexsort((y, x))
                    x, y = x[order], y[order]
                    new = np.concatenate([[True], (np.diff(x) != 0) | (np.diff(y) != 0)])
                    x, y = x[new], y[new]
                    found = windows_of(x, y, min_words)
                    row += [i] * len(found)
                    out += found
            if out:
                row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("a").take(row), b.column("b").take(row), *[pa.array(np.asarray(c, np.int32)) for c in zip(*out, strict=True)]], CHAIN[:7])

    found = [longest_runs(runs)] if done is None else []
    for pairs in portions(todo, n):
        both = pairs.join(side("a"), "a").join(side("b"), "b").join(joined, ["a", "b"], "left").select("a", "b", "ha", "posa", "hb", "posb", "x", "y")
        found.append(both.repartition(n, "a", "b").mapInArrow(chained, f"a {it}, b {it}, x0 int, x1 int, y0 int, y1 int, shift int"))
    return stored(reduce(DataFrame.union, [stored(f) for f in found])), todo


def fuzzy_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, threshold: float = 0.8) -> DataFrame:
    """Documents with ``n_passages``, ``n_repeated_words`` (in any passage), ``n_copied_words`` (in passages that an
    earlier id has) and ``passages`` (start and end word, one partner id, similarity)."""
    small_batches(docs.sparkSession)
    base = without(docs, RESULT)
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = base.where(ident.isNotNull()).select(ident.alias("id"), text.alias("text"))
    it = docs.schema[id_col].dataType.simpleString()

    def seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                h, row, pos = seeds(Words(b.column("text")))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column("id").take(pa.array(row)), pa.array(pos.astype(np.int32))], ["h", "id", "pos"])

    # seeds are not stored: the ranges are found by a first pass over the seeds, which costs less than writing and reading them
    found = rows.mapInArrow(seed_rows, f"h long, id {it}, pos int")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    pairs = found.repartitionByRange(n, "h", "id").sortWithinPartitions("h", "id", "pos").mapInArrow(linked_seeds, f"a {it}, b {it}, x int, y int, h long")

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chains of each pair of documents as windows of words; rows are sorted by pair. Pairs that share a seed of few documents
        have a row without shift, with these matches (x, y); occurrences pass as (a, null, position, lead, null, null, null, h, null, null)."""

        def work(t: pa.Table) -> pa.RecordBatch:
            a, b, x, y = (np.asarray(t.column(i).combine_chunks()) for i in range(4))
            edge = np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1, [len(a)]])
            pair = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
            order = np.lexsort((y, x, pair))
            x, y, few = x[order], y[order], np.asarray(t.column(4).is_valid())[order]
            wide = x[edge[1:] - 1] - x[edge[:-1]] + WIDTH >= MIN_CHAIN_WORDS
            of, out = [], []
            for i in np.flatnonzero((np.diff(edge) > 1) & wide).tolist():
                found = windows_of(x[edge[i] : edge[i + 1]], y[edge[i] : edge[i + 1]], min_words)
                of += [i] * len(found)
                out += found
            # all matches of a pair by seeds of few documents
            few = np.flatnonzero(few)
            some, s = np.unique(pair[few], return_index=True)
            px, py = x[few], y[few]
            ends = [f.reduceat(z, s) for z in (px, py) for f in (np.minimum, np.maximum)] if len(s) else [[]] * 4
            of = np.concatenate([np.asarray(of, np.int64), some])
            cols = [np.concatenate([np.asarray(c, np.int32), z]) for c, z in zip(zip(*(w[:4] for w in out), strict=True) if out else [[]] * 4, ends, strict=True)]
            shift = pa.concat_arrays([pa.array([w[4] for w in out], pa.int32()), pa.nulls(len(some), pa.int32())])
            ids = [t.column(i).combine_chunks().take(pa.array(edge[of])) for i in range(2)]
            cut = pa.array(np.concatenate([np.zeros(len(out), np.int32), s, [len(few)]]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(z.astype(np.int32))) for z in (px, py)]
            return pa.RecordBatch.from_arrays([*ids, *[pa.array(c.astype(np.int32)) for c in cols], shift, pa.nulls(len(of), pa.int64()), *lists], CHAIN)

        held: list[pa.Table] = []
        for batch in gathered(batches):
            alone = pc.is_null(batch.column("b"))
            for o in batch.filter(alone).combine_chunks().to_batches():
                none = pa.nulls(o.num_rows, pa.int32())
                yield pa.RecordBatch.from_arrays([o.column("a"), o.column("b"), o.column("x"), o.column("y"), none, none, none, o.column("h"), *[pa.nulls(o.num_rows, pa.list_(pa.int32()))] * 2], CHAIN)
            batch = batch.filter(pc.invert(alone))
            if not batch.num_rows:
                continue
            a, b = (np.asarray(batch.column(i).combine_chunks()) for i in range(2))
            last = int(np.flatnonzero((a == a[-1]) & (b == b[-1]))[0])
            if held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (a[0], b[0]):
                yield work(pa.concat_tables(held))
                held = []
            if last:
                yield work(pa.concat_tables([*held, batch.slice(0, last)]))
                held = [batch.slice(last)]
            else:
                held.append(batch)
        if held:
            yield work(pa.concat_tables(held))

    fields = f"a {it}, b {it}, x0 int, x1 int, y0 int, y1 int, shift int, h long, x array<int>, y array<int>"
    first = stored(pairs.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(chained, fields))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                w = Words(b.column("text"))
                ids, starts, ends, words, row = [], [], [], [], []
                for r, cuts in enumerate(b.column("cuts").to_pylist()):
                    own = w.hash[w.first[r] : w.first[r + 1]].astype(np.uint32)
                    for c in cuts:
                        row.append(r), starts.append(c["s"]), ends.append(c["e"]), words.append(own[c["s"] : c["e"]].tobytes())
                ids = b.column("id").take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(words, pa.binary())], ["id", "s", "e", "words"])

    # a passage pairs this many words at least (less a rounding)
    least = threshold * min_words - 1e-6

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, x0, y0, shift, wa, wb = (b.column(x).to_pylist() for x in ("a", "b", "x0", "y0", "shift", "wa", "wb"))
            out = []
            for i in range(b.num_rows):
                x, y = np.frombuffer(wa[i], np.uint32), np.frombuffer(wb[i], np.uint32)
                if min(len(x), len(y)) < min_words or shared_words(x, y) < least:
                    continue
                sx, ex, sy, ey, sim = align(x, y, shift[i], least)
                if min(ex - sx, ey - sy) >= min_words and sim >= threshold:
                    out.append((a[i], x0[i] + sx, x0[i] + ex, c[i], sim, True))
                    out.append((c[i], y0[i] + sy, y0[i] + ey, a[i], sim, False))
            if out:
                cols = list(zip(*out, strict=True))
                t = b.schema.field("a").type
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], t), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], t), pa.array(cols[4], pa.float64()), pa.array(cols[5])], ["id", "s", "e", "partner", "similarity", "copy"])

    def compared(spans: DataFrame, spread: bool = True) -> DataFrame:
        """Passages (id, s, e, partner, similarity, copy) of the windows of pairs; few but long ones are ``spread`` over all tasks."""
        sides = spans.select(F.col("a").alias("id"), F.col("x0").alias("s"), F.col("x1").alias("e")).union(spans.select("b", "y0", "y1")).distinct()
        wanted = sides.groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("cuts"))
        wanted = F.broadcast(wanted) if spans.count() <= FEW else wanted  # texts are not shuffled then
        cut = stored(rows.join(wanted, "id").select("id", "text", "cuts").mapInArrow(windows, f"id {it}, s int, e int, words binary").groupBy("id", "s", "e").agg(F.min("words").alias("words")))
        left = cut.select(F.col("id").alias("a"), F.col("s").alias("x0"), F.col("e").alias("x1"), F.col("words").alias("wa"))
        right = cut.select(F.col("id").alias("b"), F.col("s").alias("y0"), F.col("e").alias("y1"), F.col("words").alias("wb"))
        found = []
        for some in portions(spans, n):
            matched = some.join(left, ["a", "x0", "x1"]).join(right, ["b", "y0", "y1"]).select("a", "b", "x0", "y0", "shift", "wa", "wb")
            matched = matched.repartition(n, "a", "b", "x0", "y0") if spread else matched
            found.append(stored(matched.mapInArrow(aligned, f"id {it}, s int, e int, partner {it}, similarity double, copy boolean")))
        return reduce(DataFrame.union, found)

    spans = first.where("shift IS NOT NULL").select(*CHAIN[:7])
    near = compared(spans, spread=False)
    crowd = stored(first.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(*[F.collect_list(c).alias(name) for c, name in (("h", "h"), ("x0", "pos"), ("x1", "lead"))]))
    joined = first.where("b IS NOT NULL AND shift IS NULL").select("a", "b", "x0", "x1", "y0", "y1", "x", "y")
    ratio = 1 / min(max(threshold, 0.05), 0.95)
    more, done = left_over(crowd, near, joined, min_words, ratio)
    near = near.union(compared(more))
    far = compared(left_over(crowd, near, joined, min_words, ratio, done)[0])

    inside = lambda y, x: (y["s"] <= x["s"]) & (y["e"] >= x["e"]) & (y["e"] - y["s"] > x["e"] - x["s"])
    hits = near.union(far).groupBy("id", "partner").agg(F.collect_set(F.struct("s", "e", "similarity", "copy")).alias("p"))
    hits = hits.select("id", "partner", F.inline(F.filter("p", lambda x: ~F.exists("p", lambda y: inside(y, x)))))
    passages = hits.groupBy("id", "s", "e").agg(F.min("partner").alias("partner"), F.max("similarity").alias("similarity"), F.max("copy").alias("copy"))
    per_doc = passages.groupBy(F.col("id").alias("_q_id")).agg(F.sort_array(F.collect_list(F.struct("s", "e", "partner", "similarity", "copy"))).alias("_q_p"))

    def covered(p):
        """Words in the union of sorted intervals."""
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda acc, x: F.struct(F.greatest(acc["end"], x["e"]).alias("end"), (acc["n"] + F.greatest(x["e"] - F.greatest(acc["end"], x["s"]), F.lit(0))).alias("n"))
        return F.coalesce(F.aggregate(p, start, step, lambda acc: acc["n"]), F.lit(0)).cast("long")

    out = base.join(per_doc, ident == F.col("_q_id"), "left")
    p = F.col("_q_p")
    view = F.transform(p, lambda x: F.struct(x["s"].alias("start"), x["e"].alias("end"), x["partner"].alias("partner"), F.round(x["similarity"], 6).alias("similarity")))
    return out.select(*[F.col(f"`{c}`") for c in base.columns], F.coalesce(F.size(p), F.lit(0)).cast("long").alias("n_passages"), covered(p).alias("n_repeated_words"), covered(F.filter(p, lambda x: x["copy"])).alias("n_copied_words"), view.alias("passages"))


def op4_fuzzy_passages(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fuzzy_passages(docs).select("doc_id", *RESULT)


QUERIES = {"op4_fuzzy_passages": op4_fuzzy_passages}
SQL: dict[str, str] = {}
