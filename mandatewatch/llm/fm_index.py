"""An FM-index over integer sequences: wavelet matrix of the BWT, backward search in numpy.

The index covers short texts laid end to end, each with a weight. Rows are
sorted by their first ``depth`` symbols, which is all that searches for patterns
up to that length need. All searches advance together, one symbol per step.
"""

from __future__ import annotations

import numpy as np


_BELOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class Bits:
    """A packed bit vector with the number of ones before every 64-bit word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        self.words = np.zeros(n // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.ones = int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word = at >> 6
        below = self.words.take(word) & _BELOW.take(at & 63)
        return self.before.take(word) + np.bitwise_count(below)


class FmIndex:
    def __init__(self, texts: list[np.ndarray], weights: np.ndarray, depth: int):
        lengths = np.array([len(t) for t in texts], np.int64)
        symbols, coded = np.unique(np.concatenate(texts), return_inverse=True)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        total = int(lengths.sum()) + len(texts)
        text = np.zeros(total, np.int64)  # 0 stands after each text
        inside = np.ones(total, bool)
        inside[self.starts + lengths] = False
        text[inside] = coded + 1
        self.text = text
        order = self._order(text, depth)
        bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(symbols) + 1))])
        owner = np.repeat(np.arange(len(texts)), lengths + 1)
        self.weight = np.concatenate([[0], np.cumsum(np.asarray(weights, np.int64)[owner[order]])])
        self.depth_bits = max(int(len(symbols)).bit_length(), 1)
        self.levels: list[tuple[int, Bits, int]] = []
        for level in range(self.depth_bits - 1, -1, -1):
            ones = (bwt >> level) & 1
            bits = Bits(ones)
            self.levels.append((level, bits, len(bwt) - bits.ones))
            bwt = np.concatenate([bwt[ones == 0], bwt[ones == 1]])
        # Where each symbol's run begins at the bottom of the wavelet matrix.
        self.bottom = self._down(np.arange(len(symbols) + 1), np.zeros(len(symbols) + 1, np.int64))

    @staticmethod
    def _order(text: np.ndarray, depth: int) -> np.ndarray:
        """Positions sorted by the ``depth`` or more symbols from there on, by tripling or doubling."""
        rank, step = text, 1
        while step < depth:
            # Three ranks in one number: sorted by three times as many symbols at once; two, where three do not fit.
            size = int(rank.max()) + 2
            both = rank * size
            both[:-step] += rank[step:] + 1
            three = size < 1 << 21
            if three:
                both *= size
                both[: -2 * step] += rank[2 * step :] + 1
            rank = np.unique(both, return_inverse=True)[1]
            step *= 3 if three else 2
        return np.argsort(rank, kind="stable")

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbol & (1 << level), ones + zeros, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that start with ``symbol`` and then what the rows low..high start with."""
        base = self.first[symbol] - self.bottom[symbol]
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return base + both[: len(low)], base + both[len(low) :]

    def reach(self, ends: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How far the text before each end goes back, up to ``most``, as something of weight 2 or more.

        These are matching statistics of the indexed texts themselves: the
        length of the longest sequence that ends there and stands elsewhere too.
        """
        found = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.text), np.int64)
        live = live[most > 0]
        low, high = low[live], high[live]
        while len(live):
            low, high = self.extend(self.text[ends[live] - 1 - found[live]], low, high)
            again = self.weight[high] - self.weight[low] >= 2
            live, low, high = live[again], low[again], high[again]
            found[live] += 1
            more = found[live] < most[live]
            live, low, high = live[more], low[more], high[more]
        return found


def repeated_windows(texts: list[np.ndarray], weights: np.ndarray, width: int) -> list[np.ndarray]:
    """Per text, which of its windows of ``width`` symbols have weight 2 or more over all texts.

    A text of weight 2 or more repeats as a whole. Each other text is read back
    from its end, as far as it repeats; windows beyond that are read one by one,
    each until it stops repeating.
    """
    index = FmIndex(texts, weights, width)
    lengths = np.array([len(t) for t in texts], np.int64)
    whole = lengths.copy()
    single = np.flatnonzero(np.asarray(weights) < 2)
    whole[single] = index.reach(index.starts[single] + lengths[single], lengths[single])
    out, owners, places = [], [], []
    for k, (n, back) in enumerate(zip(lengths.tolist(), whole.tolist(), strict=True)):
        flags = np.zeros(max(n - width + 1, 0), bool)
        settled = n - back  # windows from here on lie in what was read back
        flags[settled:] = True
        # The last window, if not settled, has just been read in vain.
        open_ones = min(settled, len(flags) - 1)
        if open_ones > 0:
            owners.append(np.full(open_ones, k))
            places.append(np.arange(open_ones))
        out.append(flags)
    if owners:
        owner, place = np.concatenate(owners), np.concatenate(places)
        ends = index.starts[owner] + place + width
        good = index.reach(ends, np.full(len(ends), width)) == width
        for k, s in zip(owner[good].tolist(), place[good].tolist(), strict=True):
            out[k][s] = True
    return out
