"""Rank statistics of one series in n log n steps: inversions, Kendall's counts and p-value, the median of pairwise slopes.

A series is an array of finite values in order of time. These are the small helpers of the grouped operators in trends.py.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def inversions(values: np.ndarray) -> int:
    """Number of pairs in which the earlier value is greater; equal values make none.

    Dense ranks are compared bit by bit from the top: among values that agree in all higher bits, every one that has the bit
    counts the later ones that have it not. Each bit is one stable partition.
    """
    ranks = np.unique(values, return_inverse=True)[1].astype(np.int64).ravel()
    total = 0
    for bit in range(int(ranks.max(initial=0)).bit_length() - 1, -1, -1):
        ones = ranks >> bit & 1
        head = ranks >> (bit + 1)
        starts = np.flatnonzero(np.diff(head, prepend=-1))  # groups lie together and in order
        before = np.cumsum(ones) - ones
        total += int(((before - np.repeat(before[starts], np.diff(np.append(starts, len(ranks))))) * (1 - ones)).sum())
        ranks = ranks[np.argsort(ranks >> bit, kind="stable")]
    return total


@lru_cache(maxsize=256)
def _ways(n: int) -> list[int]:
    """Number of orders of n untied values by their inversions."""
    if n <= 1:
        return [1]
    smaller, out, window = _ways(n - 1), [], 0
    for d in range(n * (n - 1) // 2 + 1):
        window += smaller[d] if d < len(smaller) else 0
        window -= smaller[d - n] if 0 <= d - n < len(smaller) else 0
        out.append(window)
    return out


def exact_tail(n: int, discordant: int) -> float:
    """Two-sided p-value of Kendall's statistic for n untied values: the share of orders at least as far from the middle."""
    least = min(discordant, n * (n - 1) // 2 - discordant)
    if 4 * least == n * (n - 1):
        return 1.0
    if least <= 1:  # one order has no inversion, n - 1 have one
        return 0.0 if n > 170 else min(1.0, 2 * (1 if least == 0 else n) / math.factorial(n))
    return min(1.0, 2 * sum(_ways(n)[:least + 1]) / math.factorial(n))


def kendall_counts(values: np.ndarray) -> tuple[int, int, float]:
    """Discordant pairs with time, tied pairs and the variance correction for ties."""
    sizes = np.unique(values, return_counts=True)[1].astype(np.int64)
    return inversions(values), int((sizes * (sizes - 1) // 2).sum()), float((sizes * (sizes - 1) * (2 * sizes + 5)).sum())


def _inverted_pairs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of places (i, j), i < j, with values[i] > values[j], by merging halves: n log n steps and one for each pair."""
    found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))]

    def halves(a: int, b: int) -> None:
        if b - a <= 64:
            i, j = np.triu_indices(b - a, 1)
            hit = values[a + i] > values[a + j]
            found.append((a + i[hit], a + j[hit]))
            return
        middle = (a + b) // 2
        halves(a, middle)
        halves(middle, b)
        left = a + np.argsort(values[a:middle], kind="stable")
        start = np.searchsorted(values[left], values[middle:b], side="right")
        counts = len(left) - start
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(start, counts)
        found.append((left[at], np.repeat(np.arange(middle, b), counts)))

    halves(0, len(values))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def median_slope(values: np.ndarray) -> float | None:
    """Median of (v_j - v_i) / (j - i) over all pairs i < j, without making all pairs; None for fewer than two values.

    Slopes below m are the inversions of v - m x, so that the middle ranks are found by bisection of m. When few pairs are left
    between the bounds, these are listed and the middle ones chosen.
    """
    n = len(values)
    if n < 2:
        return None
    x, v = np.arange(n, dtype=np.float64), values.astype(np.float64)
    pairs = n * (n - 1) // 2
    ranks = ((pairs - 1) // 2, pairs // 2)  # from 0
    steps = np.diff(v)
    low, high = float(steps.min()), float(steps.max())
    if low == high:
        return low
    margin = 1e-9 * (1 + float(np.abs(v).max()) + high - low)  # keeps the rounding of v - m x away from the outermost slopes
    low, high = low - margin, high + margin
    below, under = 0, pairs  # slopes below low and below high
    while under - below > 8 * n:
        m = low + (high - low) / 2
        if not low < m < high:
            break
        c = inversions(v - m * x)
        if c <= ranks[0]:
            low, below = m, c
        elif c > ranks[1]:
            high, under = m, c
        else:  # the two middle ranks lie on both sides
            return (_extreme(v, x, m, False) + _extreme(v, x, m, True)) / 2
    if under - below > 8 * n:  # more equal slopes than can be told apart
        return low
    # in the order of v - low x, slopes from low to high are the inversions of v - high x
    order = np.argsort(v - low * x, kind="stable")
    i, j = (order[p] for p in _inverted_pairs((v - high * x)[order]))
    slopes = np.sort((v[j] - v[i]) / (x[j] - x[i]))
    place = [min(max(r - below, 0), len(slopes) - 1) for r in ranks]
    return float(slopes[place[0]] + slopes[place[1]]) / 2


def _extreme(v: np.ndarray, x: np.ndarray, m: float, above: bool) -> float:
    """Least slope of at least m, or greatest slope below it, by bisection to neighbouring numbers."""
    steps = np.diff(v)
    margin = 1e-9 * (1 + float(np.abs(v).max()) + float(steps.max() - steps.min()))
    low, high = (m, float(steps.max()) + margin) if above else (float(steps.min()) - margin, m)
    base = inversions(v - m * x)
    while low < (middle := low + (high - low) / 2) < high:
        reached = inversions(v - middle * x) > base if above else inversions(v - middle * x) < base
        low, high = (low, middle) if reached == above else (middle, high)
    return low
