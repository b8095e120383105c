"""An FM-index over integer sequences: partial suffix sorting, Burrows-Wheeler transform, wavelet matrix.

The index answers, for many sequences at a time, which windows of a fixed number of symbols occur earlier. It
goes backward through each sequence with its matching statistic: the longest match at the current place, up to
the window length, and its interval of suffixes. An interval of one suffix cannot grow into a repeated window, so
the search goes on at the first window that leaves that place out, without looking at the symbols between.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit array with counts of ones before any place: 64 bits and one 32-bit count per word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded.reshape(-1, 8)[:, ::-1], axis=1).reshape(-1).view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.uint32)

    def ones(self, place: np.ndarray) -> np.ndarray:
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        part = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word].astype(np.int64) + np.bitwise_count(part)


class Wavelet:
    """Occurrences of a symbol before a place, for symbols below 2 ** levels."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.bits, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.bits.append(Bits(bit.astype(np.uint8)))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def follow(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The place in the last level's order; the difference to that of place 0 is the number of occurrences."""
        for k in range(self.levels):
            ones = self.bits[k].ones(place)
            bit = (symbol >> (self.levels - 1 - k)) & 1
            place = np.where(bit == 1, self.zeros[k] + ones, place - ones)
        return place


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, where its run begins and where it ends, from the marks of the places that begin one."""
    n = len(starts)
    first = np.flatnonzero(starts)
    number = np.cumsum(starts) - 1
    return first[number], np.append(first[1:], n)[number]


class Index:
    """``text``: symbols from 1, sequences closed by 0; ``order``: for each place, the rank of a window that begins there."""

    def __init__(self, text: np.ndarray, order: np.ndarray, window: int):
        n, self.window = len(text), window
        if window < 2 or n == 0:
            raise ValueError("an index needs a window of two symbols and a text")
        # Ranks of the first 1, 2, 4, ... symbols; sorting goes as far as the window, which is all the search sees.
        ranks = {1: text.astype(np.int64)}
        depth = 1
        while depth < window:
            now = ranks[depth]
            later = np.zeros(n, dtype=np.int64)
            later[: n - depth] = now[depth:] + 1
            key = now * (int(now.max()) + 2 + 1) + later
            sort = np.argsort(key, kind="stable")
            changed = np.append(True, np.diff(key[sort]) != 0)
            rank = np.empty(n, dtype=np.int64)
            rank[sort] = np.cumsum(changed) - 1
            depth *= 2
            ranks[depth] = rank
        suffixes = np.argsort(ranks[depth], kind="stable")
        self.window_starts, self.window_ends = _runs(self._marks(suffixes, ranks, window))
        self.short_starts, self.short_ends = _runs(self._marks(suffixes, ranks, window - 1))
        heads = np.unique(self.window_starts)
        self.earliest = np.minimum.reduceat(order[suffixes], heads)
        self.head_number = np.searchsorted(heads, np.arange(n), "right") - 1
        levels = max(1, int(text.max()).bit_length())
        self.wavelet = Wavelet(text[suffixes - 1].astype(np.int64), levels)
        symbols = np.arange(int(text.max()) + 2, dtype=np.int64)
        self.first = np.searchsorted(text[suffixes], symbols, "left").astype(np.int64)
        self.base = self.wavelet.follow(symbols[:-1], np.zeros(len(symbols) - 1, dtype=np.int64))
        self.size = n

    @staticmethod
    def _marks(suffixes: np.ndarray, ranks: dict[int, np.ndarray], length: int) -> np.ndarray:
        """Where the first ``length`` symbols differ from those of the suffix before, put together from the ranks."""
        n = len(suffixes)
        marks, at = np.zeros(n, dtype=bool), 0
        marks[0] = True
        for depth in sorted((d for d in ranks if d <= length), reverse=True):
            while at + depth <= length:
                place = suffixes + at
                here = np.where(place < n, ranks[depth][np.minimum(place, n - 1)], -1)
                marks[1:] |= here[1:] != here[:-1]
                at += depth
        return marks

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals after one more symbol to the left."""
        start = self.first[symbol] - self.base[symbol]
        both = self.wavelet.follow(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return start + both[: len(symbol)], start + both[len(symbol) :]

    def repeated(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``text`` where a window begins that occurs more than once in the index, and its earliest order.

        ``starts`` and ``ends`` bound the streamed sequences, whose symbols are those of the index.
        """
        begin, at, end = starts.copy(), ends.copy(), ends.copy()  # [at, end): the match so far
        low, high = np.zeros(len(starts), dtype=np.int64), np.full(len(starts), self.size, dtype=np.int64)
        found, earliest = [], []
        live = end - begin >= self.window
        while True:
            if not live.all():
                begin, at, end, low, high = (x[live] for x in (begin, at, end, low, high))
            if not len(at):
                break
            at -= 1
            low, high = self.extend(text[at], low, high)
            # Alone: every window with this match is unique; go on with those that end before its last symbol.
            alone = high - low <= 1
            whole = ~alone & (end - at == self.window)
            if whole.any():
                found.append(at[whole])
                earliest.append(self.earliest[self.head_number[low[whole]]])
                low[whole], high[whole] = self.short_starts[low[whole]], self.short_ends[low[whole]]
                end[whole] -= 1
            if alone.any():
                end[alone] -= 1
                at[alone] = end[alone]
                low[alone], high[alone] = 0, self.size
            live = end - begin >= self.window
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(found), np.concatenate(earliest)
