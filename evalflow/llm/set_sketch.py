"""SetSketch registers of sets of 64-bit hashes, their merge, and the joint estimate of two sets by likelihood.

Every element sends points in time, by a random process of its own that depends on its hash only, to registers
drawn at random. A register keeps the earliest point of all elements, so that sketches of parts merge to the
sketch of the whole, and two sets agree in a register with about the probability of their Jaccard similarity. The minimum
is stored on an exponential scale: floor(1 - log_b x), truncated to 16 bits.

Points are made in rounds for all elements of many sets at once. A set of n elements needs only its points up
to about (ln m + 3) / n of the mean time of an element; a set in which a register is still empty then is done again with a
later end. So the work of a set is its size plus some m ln m points, not its size times m.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from evalflow.llm.words import mix

REGISTERS = 252
BASE = 1.001
RATE = 20.0
LARGEST = (1 << 16) - 1

_U = np.uint64
_STEP, _PLACE = 0x9E3779B97F4A7C15, _U(0xD1B54A32D192ED03)
_TINY = 1e-300


def _minima(elements: np.ndarray, owner: np.ndarray, ends: np.ndarray, registers: int) -> np.ndarray:
    """The earliest points up to each set's end, infinite where there is none."""
    found = np.full(len(ends) * registers, np.inf)
    times, step = np.zeros(len(elements)), 0
    while len(elements):
        step = (step + _STEP) % (1 << 64)
        drawn = mix(elements + _U(step))
        times = times - np.log(((drawn >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)) / (RATE * registers)
        early = times <= ends[owner]
        elements, owner, times, drawn = elements[early], owner[early], times[early], drawn[early]
        place = (mix(drawn ^ _PLACE) % _U(registers)).astype(np.int64)
        np.minimum.at(found, owner * registers + place, times)
    return found.reshape(-1, registers)


def sketches(sets: Sequence[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """One row of registers for each of the sets of distinct hashes; all 0 for an empty set."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.full((len(sets), registers), np.inf)
    todo, reach = np.flatnonzero(sizes), np.log(registers) + 3
    while len(todo):
        elements = np.concatenate([sets[k] for k in todo]).astype(np.uint64)
        owner = np.repeat(np.arange(len(todo)), sizes[todo])
        out[todo] = _minima(elements, owner, reach / (RATE * sizes[todo]), registers)
        todo, reach = todo[np.isinf(out[todo]).any(axis=1)], reach * 1.6
    with np.errstate(divide="ignore"):
        scaled = np.floor(1 - np.log(out) / np.log(BASE))
    return np.clip(scaled, 0, LARGEST).astype(np.uint16)


def merged(*parts: np.ndarray) -> np.ndarray:
    """The sketch of the union of the sets."""
    return np.maximum.reduce(parts)


def _later(x: np.ndarray) -> np.ndarray:
    """Probability that one register is larger than the other, x being the share that only the one set brings."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(j: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Of similarity j for sets of known sizes with so many registers larger, smaller and equal in a than in b."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p, q = _later(np.maximum(u - v * j, 0)), _later(np.maximum(v - u * j, 0))
    return larger * np.log(np.maximum(p, _TINY)) + smaller * np.log(np.maximum(q, _TINY)) + equal * np.log(np.maximum(1 - p - q, _TINY))


def estimate(n_a: np.ndarray, n_b: np.ndarray, larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, steps: int = 40) -> np.ndarray:
    """The most likely similarity, by golden sections of the concave likelihood."""
    low, high = np.zeros(len(n_a)), np.minimum(n_a / n_b, n_b / n_a)
    golden = (np.sqrt(5) - 1) / 2
    for _ in range(steps):
        x, y = high - golden * (high - low), low + golden * (high - low)
        left = log_likelihood(x, n_a, n_b, larger, smaller, equal) > log_likelihood(y, n_a, n_b, larger, smaller, equal)
        low, high = np.where(left, low, x), np.where(left, y, high)
    return (low + high) / 2


def may_reach(similarity: float, slack: float, n_a: np.ndarray, n_b: np.ndarray, larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Pairs whose sizes allow the similarity and whose registers are less likely under it than under their best
    estimate by ``slack`` in the logarithm at most (18: some six standard deviations)."""
    n_a, n_b = n_a.astype(np.float64), n_b.astype(np.float64)
    counts = (n_a, n_b, larger, smaller, equal)
    fits = np.minimum(n_a, n_b) >= similarity * np.maximum(n_a, n_b) * (1 - 1e-12)
    # The likelihood is concave: where it still rises at the similarity, the best estimate is not below.
    at = log_likelihood(np.full(len(n_a), similarity), *counts)
    further = similarity + np.maximum(np.minimum(n_a / n_b, n_b / n_a) - similarity, 0) / 1000
    reach = fits & (further > similarity) & (log_likelihood(further, *counts) >= at)
    open_ = np.flatnonzero(fits & ~reach)
    left = tuple(c[open_] for c in counts)
    best = estimate(*left)
    reach[open_] = (best >= similarity) | (log_likelihood(best, *left) - at[open_] <= slack)
    return reach
