"""Word and shingle hashes of whole texts, computed over Arrow buffers with numpy.

Words are the runs between the bytes that part them (blank and \\x09 to \\x0D). A word's hash is the sum of
random values of its bytes times powers of an odd base, modulo 2**64, taken from running sums, then mixed with
its length. All work is over slices of about SLICE bytes, so memory does not follow the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time (a single longer word is one slice).
SLICE = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the output."""
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


_PARTS = np.zeros(256, dtype=bool)
_PARTS[[0x20, *range(0x09, 0x0E)]] = True
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * _U(pow(base, done, 1 << 64))
        done += more
    return out


_TABLES: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    kept = _TABLES.get(base)
    if kept is None or len(kept) < n:
        kept = _TABLES[base] = _powers(base, max(n, 2 * SLICE))
    return kept


def _hash_slice(data: np.ndarray, breaks: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in the bytes; a break is a position where a new text begins."""
    inside = ~_PARTS[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    cut = breaks[(breaks > 0) & (breaks < len(data))]
    begins[cut] |= inside[cut]
    stops[cut - 1] |= inside[cut - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(stops)
    if not len(first):
        return first, last, np.zeros(0, dtype=np.uint64)
    sums = np.cumsum((_FOLDED if fold else _VALUES)[data] * _table(_BASE, len(data))[: len(data)], dtype=np.uint64)
    total = sums[last] - np.where(first > 0, sums[first - 1], _U(0))
    total *= _table(pow(_BASE, -1, 1 << 64), len(data))[first]
    return first, last + 1, mix(total + (last + 1 - first).astype(np.uint64) * _U(_BASE))


def word_hashes(texts: pa.Array, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and for each text where its words begin (one more entry than texts)."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at, end = int(bounds[0]), int(bounds[-1])
    hashes, starts = [], []
    while at < end:
        stop = min(at + SLICE, end)
        if stop < end:  # go back to where a word or a text ends, or else on to there
            inner = np.flatnonzero(_PARTS[raw[at:stop]])
            text_end = bounds[np.searchsorted(bounds, stop, "right") - 1]
            if len(inner) or text_end > at:
                stop = max(at + int(inner[-1]) + 1 if len(inner) else 0, int(text_end))
            else:
                limit = int(bounds[np.searchsorted(bounds, stop, "left")])
                further = np.flatnonzero(_PARTS[raw[stop:limit]])
                stop = stop + int(further[0]) + 1 if len(further) else limit
        low, high = np.searchsorted(bounds, (at, stop))
        first, _, found = _hash_slice(raw[at:stop], bounds[low:high] - at, fold)
        hashes.append(found)
        starts.append(first + at)
        at = stop
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds).astype(np.int64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; also of runs across texts, which the caller leaves out."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = words[:n].copy()
    for k in range(1, size):
        total = total * _U(_BASE) + words[k : k + n]
    return mix(total)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; a shorter text is one shingle, none without words."""
    whole = shingle_hashes(words, size)
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if last - first >= size:
            yield np.unique(whole[first : last - size + 1])
        elif last > first:
            # A length-dependent start keeps short sequences apart from real shingles.
            yield mix(shingle_hashes(words[first:last], last - first) + _U(last - first))
        else:
            yield np.zeros(0, dtype=np.uint64)


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = 8 * SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most`` bytes of text."""
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
