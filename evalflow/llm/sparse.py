"""Sparse matrices in compressed rows, as plain numpy arrays, and their product row by row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Terms of a product that are held at a time.
TERMS = 4_000_000


@dataclass(frozen=True)
class Csr:
    """Row ``i`` has the columns ``indices[starts[i]:starts[i + 1]]`` with the values at the same places."""

    starts: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    columns: int

    @property
    def rows(self) -> int:
        return len(self.starts) - 1

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        owners = np.repeat(np.arange(self.rows), np.diff(self.starts))
        counts = np.bincount(self.indices, minlength=self.columns)
        return Csr(np.append(0, np.cumsum(counts)), owners[order], self.values[order], self.rows)

    def triples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.repeat(np.arange(self.rows), np.diff(self.starts)), self.indices, self.values


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the given runs, one run after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def _slice(a: Csr, b: Csr, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    entries = slice(int(a.starts[low]), int(a.starts[high]))
    inner = a.indices[entries]
    owners = np.repeat(np.arange(low, high), np.diff(a.starts[low : high + 1]))
    lengths = b.starts[inner + 1] - b.starts[inner]
    at = spans(b.starts[inner], lengths)
    rows, cols = np.repeat(owners, lengths), b.indices[at]
    terms = np.repeat(a.values[entries], lengths) * b.values[at]
    keys = rows * np.int64(b.columns) + cols
    if len(keys) and (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys, kind="stable")
        keys, rows, cols, terms = keys[order], rows[order], cols[order], terms[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    return rows[first], cols[first], np.add.reduceat(terms, first) if len(first) else terms


def product_rows(a: Csr, b: Csr, most: int = TERMS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The entries (row, column, value) of ``a @ b`` by Gustavson's method, in runs of rows.

    Row i is the sum of the rows of ``b`` that row i of ``a`` points to; a run has about ``most`` terms.
    """
    per_entry = b.starts[a.indices + 1] - b.starts[a.indices]
    before = np.append(0, np.cumsum(per_entry))[a.starts]
    low = 0
    while low < a.rows:
        high = max(low + 1, int(np.searchsorted(before, before[low] + most, "right")) - 1)
        yield _slice(a, b, low, high)
        low = high


def product(a: Csr, b: Csr) -> Csr:
    parts = list(product_rows(a, b))
    rows, cols, values = (np.concatenate(p) if parts else np.zeros(0, dtype=np.int64) for p in (zip(*parts) if parts else [[]] * 3))
    counts = np.bincount(rows, minlength=a.rows)
    return Csr(np.append(0, np.cumsum(counts)), cols, values, b.columns)
