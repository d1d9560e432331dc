"""Suffix order by linear grouping.

Suffixes are kept in groups that share a prefix, ordered by that prefix, in one
array where a group is an interval. From the greatest group down, each member's
previous-smaller pointer (the nearest position to its left in a lower group) is
found by jumping over finished positions. The positions pointed at take the
members' prefix on: those hit most often move to the top of their own group
first and become the next higher group. When all groups are done, every group
holds the suffixes of one longest Lyndon prefix. A suffix's order within its
group is the order of what follows that prefix, which is smaller: walking the
order from the least suffix and following the previous-smaller pointers fills
each group from its front. Nothing is renamed and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``symbols`` (non-negative integers) in ascending order; a suffix that ends is the smaller."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    first = np.argsort(symbols, kind="stable")
    ordered = symbols[first]
    heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sizes = np.diff(np.r_[heads, n])
    order = first.tolist()  # members by interval
    where = np.empty(n, np.int64)
    where[first] = np.arange(n)
    where = where.tolist()  # a position's place in ``order``
    head = np.empty(n, np.int64)
    head[first] = np.repeat(heads, sizes)
    head = head.tolist()  # the interval's start names the group
    size = [0] * n
    for h, s in zip(heads.tolist(), sizes.tolist()):
        size[h] = s
    left = [-1] * n  # previous-smaller pointers

    top = n - 1
    while top >= 0:
        start = head[order[top]]
        hits: dict[int, int] = {}
        for i in sorted(order[start : top + 1]) if top > start else (order[top],):
            j = i - 1
            while j >= 0 and head[j] >= start:
                j = left[j]
            left[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        if hits:
            most = max(hits.values())
            if most == 1:
                levels = [list(hits)]
            else:
                levels = [[] for _ in range(most)]
                for j, k in hits.items():
                    levels[most - k].append(j)
            for level in levels:
                moved: dict[int, int] = {}
                for j in level:
                    h = head[j]
                    m = moved.get(h, 0) + 1
                    moved[h] = m
                    at, to = where[j], h + size[h] - m
                    other = order[to]
                    order[to], order[at] = j, other
                    where[j], where[other] = to, at
                for h, m in moved.items():
                    rest = size[h] - m
                    size[h] = rest
                    size[h + rest] = m
                    if rest:
                        for j in order[h + rest : h + rest + m]:
                            head[j] = h + rest
        top = start - 1

    # The empty suffix comes first; what it is followed by on the left starts the walk.
    filled = [0] * n
    placed = [False] * n
    result = [0] * n
    s = n - 1
    at = -1
    while True:
        while s >= 0 and not placed[s]:
            h = head[s]
            result[h + filled[h]] = s
            filled[h] += 1
            placed[s] = True
            s = left[s]
        at += 1
        if at == n:
            return np.array(result, np.int64)
        s = result[at] - 1
