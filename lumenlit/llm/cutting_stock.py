"""Cutting stock by column generation, on a histogram of bounded size.

The driver holds one number for each length class (``capacity`` at most), never a row
for a document. The linear program over patterns is solved by the revised simplex
method; a knapsack dynamic program over the dual prices gives the next column; Farley's
bound ends the search within ``gap`` of the optimum. Amounts are rounded down and what
is left is packed best-fit decreasing.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import numpy as np


def best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity; prices[i] belongs to size i."""
    value = np.where(prices > 0, prices, 0.0)
    mirrored = np.zeros(capacity + 1)  # best value of capacity c at capacity - c
    choice = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        worth = value[1 : c + 1] + mirrored[capacity - c + 1 :]
        i = int(worth.argmax())
        mirrored[capacity - c] = worth[i]
        choice[c] = i + 1
    pattern = np.zeros(capacity + 1, np.int64)
    c = capacity
    while c > 0:
        if value[choice[c]] > 0:
            pattern[choice[c]] += 1
        c -= choice[c]
    return float(mirrored[0]), pattern


def relaxed(demand: np.ndarray, capacity: int, gap: float, max_columns: int) -> list[tuple[np.ndarray, float]]:
    """Patterns and fractional amounts that meet the demand; demand[i] belongs to size i."""
    sizes = np.flatnonzero(demand)
    m = len(sizes)
    each = capacity // sizes
    inverse = np.diag(1.0 / each)
    amount = demand[sizes] / each
    basis = [np.where(np.arange(capacity + 1) == s, capacity // s, 0) for s in sizes]
    prices = np.zeros(capacity + 1)
    for _ in range(max_columns):
        prices[sizes] = inverse.sum(axis=0)
        value, pattern = best_pattern(prices, capacity)
        if value <= 1 + 1e-9 or amount.sum() * (1 - 1 / value) <= gap * amount.sum():
            break
        way = inverse @ pattern[sizes]
        up = np.flatnonzero(way > 1e-9)
        if not len(up):
            break
        out = up[np.argmin(amount[up] / way[up])]
        step = amount[out] / way[out]
        amount = np.maximum(amount - step * way, 0)
        amount[out] = step
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        basis[out] = pattern
    return [(basis[i], float(amount[i])) for i in range(m)]


def plan(demand: np.ndarray, capacity: int, gap: float = 0.002, max_columns: int = 4000) -> list[tuple[dict[int, int], int]]:
    """Patterns (pieces of each size) and how often each is cut, with exactly the demand's pieces."""
    demand = np.asarray(demand, np.int64)
    if not demand.any():
        return []
    left, counts = demand.copy(), Counter()
    for pattern, amount in relaxed(demand, capacity, gap, max_columns):
        used = pattern > 0
        times = min(int(amount + 1e-6), int((left[used] // pattern[used]).min()))
        if times > 0:
            left -= times * pattern
            counts[tuple((int(s), int(pattern[s])) for s in np.flatnonzero(used))] += times
    sizes = np.flatnonzero(left).tolist()
    while sizes:
        room, pattern = capacity, Counter()
        while room and (at := bisect_right(sizes, room)):
            s = sizes[at - 1]
            n = min(room // s, int(left[s]))
            pattern[s] += n
            left[s] -= n
            room -= n * s
            if not left[s]:
                sizes.pop(at - 1)
        fits = min([int(left[s]) // n for s, n in pattern.items()])
        for s, n in pattern.items():
            left[s] -= fits * n
        sizes = [s for s in sizes if left[s]]
        counts[tuple(sorted(pattern.items()))] += 1 + fits
    return [(dict(p), n) for p, n in sorted(counts.items(), reverse=True)]
