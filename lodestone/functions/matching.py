"""Pairing rows of numbers that agree within a tolerance, each with one other."""

from __future__ import annotations

from collections import deque

import numpy as np

#: What floating point may add to a difference.
ROUNDING = 1e-9


def candidates(x: np.ndarray, y: np.ndarray, tolerance: float) -> list[list[int]]:
    """For each row of x the rows of y that differ by tolerance or less in every column, nearest in the first column first."""
    order = np.argsort(y[:, 0], kind="stable")
    first = y[order, 0]
    reach = tolerance + ROUNDING
    low, high = np.searchsorted(first, x[:, 0] - reach, "left"), np.searchsorted(first, x[:, 0] + reach, "right")
    found = []
    for row, a, b in zip(x, low, high, strict=True):
        near = order[a:b]
        near = near[(np.abs(y[near] - row) <= reach).all(1)]
        found.append(near[np.argsort(np.abs(y[near, 0] - row[0]), kind="stable")].tolist())
    return found


def matchable(x: np.ndarray, y: np.ndarray, tolerance: float) -> bool:
    """Whether every row of x can be paired with a row of y of its own within tolerance in every column.

    One column is paired in sorted order, which succeeds if any pairing does. More columns are a maximum bipartite
    matching: pairs along shortest chains of exchanges, until no row is left or one has no chain.
    """
    if len(x) != len(y):
        return False
    if not len(x) or not x.shape[1]:
        return True
    if x.shape[1] == 1:
        return bool((np.abs(np.sort(x[:, 0]) - np.sort(y[:, 0])) <= tolerance + ROUNDING).all())
    near = candidates(x, y, tolerance)
    taken: dict[int, int] = {}  # row of y -> row of x
    for start in sorted(range(len(x)), key=lambda i: len(near[i])):
        came: dict[int, int] = {}  # row of y -> row of x that reached it
        queue, free = deque([start]), None
        while queue and free is None:
            i = queue.popleft()
            for j in near[i]:
                if j not in came:
                    came[j] = i
                    if j not in taken:
                        free = j
                        break
                    queue.append(taken[j])
        if free is None:
            return False
        partner = {i: j for j, i in taken.items() if i in set(came.values())}
        while free is not None:
            i = came[free]
            taken[free], free = i, partner.get(i)
    return True
