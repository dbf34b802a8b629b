"""Words and word hashes of whole Arrow text columns, in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D. UTF-8 keeps those bytes for ASCII alone, so
working on bytes gives the same words as working on code points. Nulls count as empty texts.

Hashes have 64 bits. They are polynomials over the bytes (taken from prefix sums, so a whole column
costs a few passes) followed by a finalizer; two different words share one with a chance of about 2^-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATORS = " \t\n\x0b\x0c\r"
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; returns a new array."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


_BYTE = mix((np.arange(256, dtype=U) + U(1)) * U(_BASE))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the base ("up") or of its inverse modulo 2^64 ("down"), kept per process up to 8 M."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), U(_BASE if name == "up" else pow(_BASE, -1, 1 << 64)), U)
        step[0] = 1
        have = np.cumprod(step)
        if n <= 8 << 20:
            _powers[name] = have
    return have[:n]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each span, whatever its place."""
    prefix = np.zeros(len(values) + 1, U)
    np.cumsum(values * _power("up", len(values)), out=prefix[1:])
    h = (prefix[end] - prefix[start]) * _power("down", len(values) + 1)[start]
    return mix(h + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and where each row starts (one more entry than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


class Words:
    """start and end of each word in data; words first[i]:first[i + 1] are those of row i."""

    def __init__(self, column, lower: bool = False):
        self.data, self.rows = text_bytes(column)
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        word = ~_SEP[self.data]
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        before[self.rows[:-1][self.rows[:-1] < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        after[self.rows[1:][self.rows[1:] > 0] - 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, self.rows)
        self.count = np.diff(self.first)

    def hashes(self, limit: int = 1 << 20) -> np.ndarray:
        """A hash of each word, made for runs of words over about `limit` bytes: span_hashes needs 24 bytes for each byte of its values."""
        out, at = np.empty(len(self.start), U), 0
        while at < len(out):
            base = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, base + limit, side="right")))
            out[at:to] = span_hashes(_BYTE[self.data[base : self.end[to - 1]]], self.start[at:to] - base, self.end[at:to] - base)
            at = to
        return out

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def join(self, keep: np.ndarray) -> list[str]:
        """Per row, the words marked in keep, joined by one space."""
        out = []
        raw = self.data.tobytes()
        start, end = self.start.tolist(), self.end.tolist()
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            at = np.flatnonzero(keep[a:b]) + a
            out.append(b" ".join([raw[start[i] : end[i]] for i in at.tolist()]).decode())
        return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive entries of h, across rows too."""
    if len(h) < k:
        return np.zeros(0, U)
    g = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        g *= U(_BASE)
        g += h[j : len(h) - k + 1 + j]
    return mix(g + U(k))


def slices(batches, column: str, limit: int = 4 << 20):
    """Record batches cut to about `limit` bytes of text (a longer row stays whole)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        total = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
