"""Vectorised text helpers: whole batches of documents as one byte array, with word slices and 64-bit hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LOW = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], U)
_A, _B, _C = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= _A
    x ^= x >> U(27)
    x *= _B
    x ^= x >> U(31)
    return x


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that Python holds few texts at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def row_chunks(texts: Sequence, limit: int = 1 << 22, measure: Callable = len) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes each; a longer text stands alone. `measure` gives a row's bytes."""
    a = size = 0
    for i, t in enumerate(texts):
        n = measure(t)
        if size and size + n > limit:
            yield a, i
            a, size = i, 0
        size += n + 1
    if a < len(texts):
        yield a, len(texts)


def hash_slices(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte slices. buf must go on for 8 bytes after the last slice."""
    lanes = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    h = mix((lanes[start] & _LOW[np.minimum(length, 8)]) + length.astype(U) * _C)
    live, at = np.flatnonzero(length > 8), 8
    while live.size:
        left = length[live] - at
        h[live] = mix(h[live] * _C + (lanes[start[live] + at] & _LOW[np.minimum(left, 8)]))
        live, at = live[left > 8], at + 8
    return h


class Words:
    """The words of some texts: lower-cased bytes `buf`, `start`, `end`, `doc` (row) and `hash` of each word, `counts` by row."""

    def __init__(self, texts: list[bytes]):
        raw = b"\n".join(texts).translate(LOWER) + b"\n" + bytes(8)
        self.buf = np.frombuffer(raw, np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.doc_end = np.cumsum(size)
        self.doc_start = self.doc_end - size
        gap = SPACE[self.buf[: len(raw) - 8]]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(gap) and not gap[0]:
            edge = np.r_[0, edge]
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.doc_end, self.start, "right")
        self.counts = np.bincount(self.doc, minlength=len(texts))
        self.first = np.cumsum(self.counts) - self.counts
        self.hash = hash_slices(self.buf, self.start, self.end - self.start)

    def shingles(self, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of each run of `width` words, in order. A text with fewer words (but some) counts as one shingle."""
        h, n = self.hash, max(0, len(self.hash) - width + 1)
        s = np.zeros(n, U)
        for j in range(width):
            s = s * _C + h[j : n + j]
        ok = self.doc[:n] == self.doc[width - 1 : n + width - 1]
        s, row = mix(s[ok]), self.doc[:n][ok]
        if short and len(few := np.flatnonzero((self.counts > 0) & (self.counts < width))):
            f = np.zeros(len(few), U)
            for j in range(width - 1):
                has = self.counts[few] > j
                f[has] = f[has] * _C + h[self.first[few[has]] + j]
            s, row = np.r_[s, mix(f + self.counts[few].astype(U))], np.r_[row, few]
            order = np.argsort(row, kind="stable")
            s, row = s[order], row[order]
        return s, row


def bounds(row: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows begins in a sorted array of row numbers; one more at the end."""
    return np.searchsorted(row, np.arange(n + 1))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[0], start[0]+1, ... of slices laid end to end."""
    total = int(length.sum())
    at = np.cumsum(length) - length
    return np.repeat(start - at, length) + np.arange(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
