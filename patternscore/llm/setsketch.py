"""SetSketch: registers of exponentially spaced truncated minima, their union, and what two of them say about two sets.

For each register every element has an exponential variate of rate RATE; the register holds floor(1 - log_BASE(least variate)), cut to
0 .. LIMIT + 1. The union of two sets has the larger of each two registers. Registers of sets of similarity J are equal with a
probability near J, so bands of registers find similar sets; how many are larger, smaller and equal gives J's likelihood, given both sizes.
"""

from __future__ import annotations

from math import log

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import mix

#: Bands and registers in each: sets at similarity 0.8 share a band with probability 0.99997.
BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
BASE, RATE, LIMIT = 1.001, 20.0, 65534
_RNG = np.random.default_rng(11)
_MULTIPLIERS = (_RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_SHIFTS = _RNG.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)[:, None]
_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
#: Elements whose variates are made at once.
_STEP = 2048


def least_words(h: np.ndarray) -> np.ndarray:
    """The least of the elements' 32-bit uniform numbers for each register; h: 64-bit hashes, one at least."""
    low, x = np.full(REGISTERS, 0xFFFFFFFF, np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), _STEP):
        np.minimum(low, (x[None, i : i + _STEP] * _MULTIPLIERS + _SHIFTS).min(axis=1), out=low)
    return low


def registers(low: np.ndarray) -> np.ndarray:
    """Registers from least_words(), of any shape. The least variate is the variate of the least uniform number."""
    variate = -np.log1p(-(low.astype(float) + 0.5) / (1 << 32)) / RATE
    return np.clip(np.floor(1 - np.log(variate) / log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def band_keys(k: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of registers (sets x REGISTERS)."""
    wide = k.astype(np.uint64).reshape(-1, BANDS, ROWS)
    out = np.repeat(_SALT[None], len(k), axis=0)
    for j in range(ROWS):
        out = mix(out + wide[:, :, j])
    return out.view(np.int64)


def size_of(k: np.ndarray) -> float:
    """Estimated number of elements; the relative deviation is about 0.11 with 80 registers."""
    return REGISTERS * (1 - 1 / BASE) / (RATE * log(BASE) * float((BASE ** -k.astype(float)).sum()))


def merged(k: Column) -> Column:
    """An aggregate: the registers (an array column) of the union of the sets of a group; partial results merge in tasks."""
    return F.array(*[F.max(F.get(k, F.lit(i))) for i in range(REGISTERS)])


def _share(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * ((BASE - 1) / BASE)) / log(BASE)


def log_likelihood(j, u, more, less, equal):
    """Of similarity j. u: size of the first set over the sum of both sizes; more, less, equal: registers by the first against the second."""
    tiny = 1e-12
    a, b = _share(np.maximum(u - (1 - u) * j, 0)), _share(np.maximum(1 - u - u * j, 0))
    return more * np.log(a + tiny) + less * np.log(b + tiny) + equal * np.log(np.maximum(1 - a - b, 0) + tiny)


def may_reach(k: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray, least: float, slack: float = 14.0) -> np.ndarray:
    """Which of other sets (registers, sizes) may have similarity ``least`` or more with a set.

    Sizes decide exactly; then the likelihood: a set is left out only if its best similarity is below ``least`` and more
    likely by a factor of exp(slack), which a similar set meets with probability below 1e-6.
    """
    out = np.minimum(sizes, n) >= least * np.maximum(sizes, n) - 1e-9
    some = np.flatnonzero(out)
    if not len(some):
        return out
    out[some] = _may(k, others[some], n, sizes[some], least, slack)
    return out


def pairs_may_reach(k: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, least: float, slack: float = 14.0) -> np.ndarray:
    """may_reach() of many pairs (a, b) of sets at once."""
    out = np.minimum(sizes[a], sizes[b]) >= least * np.maximum(sizes[a], sizes[b]) - 1e-9
    some = np.flatnonzero(out)
    if len(some):
        out[some] = _may(k[a[some]], k[b[some]], sizes[a[some]], sizes[b[some]], least, slack)
    return out


def _may(k: np.ndarray, x: np.ndarray, n, sizes: np.ndarray, least: float, slack: float) -> np.ndarray:
    equal, more = (x == k).sum(axis=1), (x < k).sum(axis=1)
    less, u = REGISTERS - equal - more, n / (n + sizes)
    top = np.minimum(u / (1 - u), (1 - u) / u)
    low, high = np.zeros(len(x)), top.copy()
    for _ in range(24):  # the likelihood has one maximum
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        rises = log_likelihood(a, u, more, less, equal) < log_likelihood(b, u, more, less, equal)
        low, high = np.where(rises, a, low), np.where(rises, high, b)
    best = (low + high) / 2
    gap = log_likelihood(best, u, more, less, equal) - log_likelihood(np.minimum(least, top), u, more, less, equal)
    return (best >= least) | (gap <= slack)


def likely_parts_of_many(k: np.ndarray, sizes: np.ndarray, groups: list[int], least: float) -> np.ndarray:
    """likely_parts() of small groups of the given lengths that follow each other, each pair of a group at once; a part is named by its first set."""
    at = np.cumsum([0, *groups])
    ends = [(i + np.stack(np.triu_indices(n, 1))) for i, n in zip(at.tolist(), groups, strict=False)]
    a, b = np.concatenate(ends, axis=1)
    near = pairs_may_reach(k, sizes, a, b, least)
    a, b, part = a[near], b[near], np.arange(len(k))
    while True:
        less = part.copy()
        np.minimum.at(less, a, part[b])
        np.minimum.at(less, b, part[a])
        if np.array_equal(less, part):
            return part
        part = less


def likely_parts(k: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """A number for each set of a group: sets linked by may_reach(), over any steps, share one."""
    part, waiting, queue, number = np.empty(len(k), np.int64), np.arange(len(k)), [], -1
    while len(waiting) or queue:
        if queue:
            x = queue.pop()
        else:
            x, waiting, number = int(waiting[0]), waiting[1:], number + 1
            part[x] = number
        if not len(waiting):
            break
        near = may_reach(k[x], int(sizes[x]), k[waiting], sizes[waiting], least)
        if near.any():
            found, waiting = waiting[near], waiting[~near]
            part[found] = number
            queue += found.tolist()
    return part
