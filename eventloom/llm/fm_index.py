"""An FM-index over integer words: a wavelet matrix of packed bits over the BWT, backward search for many patterns at once."""

from __future__ import annotations

import numpy as np

from eventloom.llm.words import U


class WaveletMatrix:
    """Rank of any symbol in a prefix, from one packed bit vector with word counts per level."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        n = len(values)
        for level in range(self.levels - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            raw = np.packbits(bit, bitorder="little")
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            packed[: len(raw)] = raw
            words = packed.view(U)
            count = np.zeros(len(words) + 1, np.int32)
            np.cumsum(np.bitwise_count(words), out=count[1:])
            self.words.append(words), self.before.append(count), self.zeros.append(n - int(count[-1]))
            values = np.concatenate([values[~bit], values[bit]])
        self.start = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (words, before, zeros) in enumerate(zip(self.words, self.before, self.zeros, strict=True)):
            block = at >> 6
            mask = (U(1) << (at & 63).astype(U)) - U(1)
            ones = before[block] + np.bitwise_count(words[block] & mask)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol occurs before place at."""
        return self._walk(symbol, at) - self.start[symbol]


class FmIndex:
    """text: symbols 1.. with a 0 after each sequence; owner: a number for each symbol of text.

    Suffixes are sorted by their first `depth` symbols, which is enough for patterns of up to that length (ranges, not
    single suffixes, are counted). The suffix order is not kept: of each range of two or more suffixes with
    equal first `depth` symbols, the index keeps where it begins and the smallest owner of its suffixes.
    """

    def __init__(self, text: np.ndarray, depth: int, owner: np.ndarray):
        n = len(text)
        self.text = text.astype(np.uint32)
        sigma = int(text.max()) + 1 if n else 1
        rank, span = self.text.astype(U), 1
        order = np.argsort(rank)
        new = np.ones(n, bool)
        new[1:] = np.diff(rank[order]) != 0
        while span < depth:
            # the first `span` symbols here and those `step` further on are the first span + step
            step = min(span, depth - span)
            key = rank << U(32)
            key[: n - step] |= rank[step:] + U(1)
            order = np.argsort(key)
            s = key[order]
            new[1:] = s[1:] != s[:-1]
            rank[order] = np.cumsum(new).astype(U)
            span += step
        first = np.flatnonzero(new)
        repeated = np.diff(np.append(first, n)) > 1
        self.first = first[repeated].astype(np.uint32)
        self.least = np.minimum.reduceat(owner[order], first)[repeated] if n else owner
        self.wavelet = WaveletMatrix(self.text[order - 1], sigma)
        self.below = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.below[1:])

    def least_owner(self, low: np.ndarray) -> np.ndarray:
        """The smallest owner in ranges of patterns of `depth` symbols that occur twice or more, by where they begin."""
        return self.least[np.searchsorted(self.first, low.astype(np.uint32))]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of symbol + pattern, from those of the pattern."""
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.below[symbol]
        return base + both[: len(symbol)], base + both[len(symbol) :]


def shared_windows(index: FmIndex, start: np.ndarray, end: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Streams text[start:end] of the index's own text through backward search.

    From each end position the match is extended to the left while it occurs elsewhere too (a range of more
    than one suffix): the matching statistic, as far as k. A statistic under k rules out every window over the
    word it stopped at, so the next end lies behind it. Returns the windows of k words that occur twice or
    more: stream, end, and the suffix range.
    """
    found = []
    who = np.flatnonzero(end - start >= k)
    at = start[who] + k - 1
    depth = np.zeros(len(who), np.int64)
    low, high = np.zeros(len(who), np.int64), np.full(len(who), len(index.text), np.int64)
    while len(who):
        low, high = index.extend(index.text[at - depth].astype(np.int64), low, high)
        depth += 1
        stop = high - low <= 1
        full = ~stop & (depth == k)
        if full.any():
            found.append((who[full], at[full], low[full], high[full]))
        reset = stop | full
        at = np.where(stop, at - depth + 1 + k, at + full)
        depth[reset], low[reset], high[reset] = 0, 0, len(index.text)
        go = at < end[who]
        if not go.all():
            who, at, depth, low, high = (x[go] for x in (who, at, depth, low, high))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
