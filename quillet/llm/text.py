"""Vectorised word tools shared by the corpus operators (they run inside Spark tasks).

Words are runs of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text. A batch of texts becomes one
byte buffer; word boundaries, word hashes and n-gram hashes come from numpy over that buffer, so the
cost is a few nanoseconds a byte and no Python object is made per word.

Hashes are 64-bit polynomial sums with a strong finalizer: two different words of a corpus with a billion
distinct words share a hash with a chance of about 3 %, and then share one count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
BLOCK_BYTES = 1 << 18


def slices(table: pa.RecordBatch | pa.Table, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``block_bytes`` of text (a longer text is a run of its own)."""
    if table.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(table.column(text_col)), 0), dtype=np.int64)
    group = np.cumsum(sizes) // block_bytes
    edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)]])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield table.slice(int(a), int(b - a))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT^i and MULT^-i modulo 2^64 for i < n."""
    out = []
    for base in (_MULT, _INV):
        p = np.ones(1, np.uint64)
        step = base
        while len(p) < n:
            p = np.concatenate([p, p * np.uint64(step)])
            step = step * step % (1 << 64)
        out.append(p[:n])
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer with full avalanche over 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


class Words:
    """Words of several texts: ``hash`` (uint64), ``start``/``end`` (byte offsets in ``data``), ``doc`` (row of each word),
    ``first`` (index of each row's first word, with a closing entry)."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
        n = len(texts)
        ends = offsets - offsets[0]
        # one space after each text keeps the last word of a text apart from the next text
        data = np.full(len(raw) + n, 0x20, np.uint8)
        keep = np.ones(len(data), bool)
        keep[ends[1:] + np.arange(n)] = False
        data[keep] = raw
        self.data = _LOWER[data] if lower else data
        self.row_end = ends[1:] + np.arange(1, n + 1)
        space = _SPACE[self.data]
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.doc = np.searchsorted(self.row_end, self.start, side="right")
        self.first = np.searchsorted(self.doc, np.arange(n + 1))
        self.n_rows = n

    @property
    def hash(self) -> np.ndarray:
        if not hasattr(self, "_hash"):
            size = 1 << max(20, int(len(self.data)).bit_length())
            up, down = _powers(size)
            total = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=total[1:])
            self._hash = mix((total[self.end] - total[self.start]) * down[self.start])
        return self._hash

    def ngrams(self, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of the first word) of every n words in a row inside one text."""
        h = self.hash if hashes is None else hashes
        if len(h) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[: len(h) - n + 1] == self.doc[n - 1 :])
        out = h[at]
        for i in range(1, n):
            out = mix(out * np.uint64(3) + h[at + i])
        return out, at

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def sum_by_row(values: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n_rows)
