"""Where a value stands in a list of tokens, in time linear in their text."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# What is stripped at the ends of a text, and texts that stand for a missing value.
STRIPPED = "\"'\n\t "
MISSING = ("", "null", "NULL", "None", "none")
_QUOTE = re.compile(r'\\?"')


def clean(text: str) -> str:
    return _QUOTE.sub("", text.strip(STRIPPED))


def _first(texts: list[str], want: str) -> tuple[int, int] | None:
    """(start, n) of the first span whose clean text is ``want``. The tokens' text without double quotes is searched once; a
    find counts if the rest of its first and last token is stripped anyway, and starts at the first of the tokens before it
    that are stripped whole."""
    if not want:
        return next(((i, 1) for i, t in enumerate(texts) if not clean(t)), None)
    whole = "".join(texts)
    ends = list(accumulate(map(len, texts)))
    gone = [(m.start(), m.end() - m.start()) for m in _QUOTE.finditer(whole)]
    if gone:
        places, before = [g[0] for g in gone], [0, *accumulate(g[1] for g in gone)]

        def moved(at: int) -> int:
            """Where a place in the text is once quotes are gone (a place inside a quote's escape counts as before it)."""
            k = bisect_right(places, at - 1)
            cut = before[k]
            return at - cut + (max(0, places[k - 1] + gone[k - 1][1] - at) if k else 0)

        ends = [moved(e) for e in ends]
        whole = _QUOTE.sub("", whole)
    starts = [0, *ends[:-1]]
    at = whole.find(want)
    while at >= 0:
        end = at + len(want)
        a, b = bisect_right(ends, at), bisect_right(ends, end - 1)
        if not whole[starts[a] : at].strip(STRIPPED) and not whole[end : ends[b]].strip(STRIPPED):
            while a and not whole[starts[a - 1] : ends[a - 1]].strip(STRIPPED):
                a -= 1
            if clean("".join(texts[a : b + 1])) == want:
                return a, b - a + 1
        at = whole.find(want, at + 1)
    return None


def span(tokens: list[str | None] | None, value: str | None) -> tuple[int, int] | None:
    if tokens is None or value is None:
        return None
    texts, want = [t or "" for t in tokens], clean(value)
    if want not in MISSING:
        return _first(texts, want)
    found = [s for w in MISSING if len(w) <= max(len(want), 0) and (s := _first(texts, w))]
    return min(found, default=None)


def aligned_span(tokens: Column, value: Column) -> Column:
    @F.arrow_udf("struct<start: int, n: int>")
    def found_span(tokens: pa.Array, values: pa.Array) -> pa.Array:
        spans = [span(t, v) for t, v in zip(tokens.to_pylist(), values.to_pylist(), strict=True)]
        return pa.array([None if s is None else {"start": s[0], "n": s[1]} for s in spans], pa.struct([("start", pa.int32()), ("n", pa.int32())]))

    return found_span(tokens, value)
