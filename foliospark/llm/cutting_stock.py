"""Cutting stock by column generation, on a histogram of lengths.

The linear program covers each length's demand with patterns (multisets of
lengths that fit into one sequence), minimising their number. It starts with
one pattern a length; a knapsack dynamic program over the duals prices new
columns; a revised simplex step brings them in. Its fractional counts are
rounded down, and what is left, which is bounded by the number of lengths and
not by the number of documents, is filled greedily.
"""

from __future__ import annotations

import numpy as np

Pattern = tuple[tuple[int, int], ...]  # (length in units, how many)


def _best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of sizes within the capacity (unbounded knapsack); sizes ascend."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(int(sizes[0]), capacity + 1):
        k = fits[c]
        worth = best[c - sizes[:k]] + values[:k]
        at = int(worth.argmax())
        if worth[at] > best[c - 1] + 1e-12:
            best[c], take[c] = worth[at], at
        else:
            best[c] = best[c - 1]
    column, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            column[take[c]] += 1
            c -= int(sizes[take[c]])
    return float(best[capacity]), column


def solve_relaxation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-4, max_steps: int = 20_000) -> tuple[list[np.ndarray], np.ndarray]:
    """Patterns and their fractional counts, within the relative gap of the optimum."""
    n = len(sizes)
    columns = [np.eye(n)[i] * (capacity // sizes[i]) for i in range(n)]
    costs = np.ones(n)
    inverse = np.diag(1.0 / (capacity // sizes))
    level = inverse @ demand
    for _ in range(max_steps):
        duals = costs @ inverse
        low = int(duals.argmin())
        if duals[low] < -1e-9:  # more of that length than asked for is allowed
            column, cost = -np.eye(n)[low], 0.0
        else:
            worth, column = _best_pattern(sizes, duals, capacity)
            if worth <= 1 + 1e-9 or 1 - 1 / worth < gap:
                break
            cost = 1.0
        step = inverse @ column
        up = step > 1e-10
        ratios = np.full(n, np.inf)
        ratios[up] = np.maximum(level[up], 0) / step[up]
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        level = np.maximum(level - ratios[out] * step, 0)
        level[out] = ratios[out]
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[out], costs[out] = column, cost
    keep = [i for i in range(n) if costs[i] > 0 and level[i] > 0]
    return [columns[i] for i in keep], level[keep]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns with whole counts whose slots are enough for the histogram {length in units: count}."""
    wanted = {s: c for s, c in sorted(histogram.items()) if c > 0}
    if not wanted:
        return []
    if min(wanted) < 1 or max(wanted) > capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    sizes, demand = np.array(list(wanted)), np.array(list(wanted.values()), dtype=float)
    counts: dict[Pattern, int] = {}
    left = demand.astype(np.int64)
    for column, level in sorted(zip(*solve_relaxation(sizes, demand, capacity)), key=lambda x: -x[1]):
        whole = column.astype(np.int64)
        used = whole > 0
        times = int(level + 1e-7)
        if times and used.any():
            key = tuple((int(s), int(k)) for s, k in zip(sizes[used], whole[used]))
            counts[key] = counts.get(key, 0) + times
            left -= whole * times
    left = np.maximum(left, 0)
    while left.any():  # the largest that still fits, over and over
        room, pick = capacity, np.zeros(len(sizes), dtype=np.int64)
        for i in range(len(sizes) - 1, -1, -1):
            pick[i] = min(left[i], room // sizes[i])
            room -= pick[i] * sizes[i]
        used = pick > 0
        times = int((left[used] // pick[used]).min())
        key = tuple((int(s), int(k)) for s, k in zip(sizes[used], pick[used]))
        counts[key] = counts.get(key, 0) + times
        left -= pick * times
    return list(counts.items())
