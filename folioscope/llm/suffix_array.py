"""Suffix arrays by grouping, in linear time.

Phase 1 gathers suffixes that share their longest Lyndon prefix, in groups that are in order among themselves. It starts from
groups by first symbol and takes them from the highest down. Each member of the group points back to the nearest
suffix before it that is in a lower group; the suffixes pointed at have their prefix extended by the group's, once for each pointer, and so move up
out of their group: those hit most often go highest. Phase 2 walks the array it is writing from its lowest suffix up and follows
the same pointers; that meets the members of every group in their order. Nothing is renamed and nothing recurs.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The suffixes of a sequence of non-negative integers in order; a suffix precedes those it is a prefix of."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    symbols = np.asarray(symbols)
    first = np.argsort(symbols, kind="stable")
    opens = np.flatnonzero(np.diff(symbols[first], prepend=symbols[first[0]] - 1))
    sizes = np.diff(np.append(opens, n))
    starts = np.empty(n, np.int64)
    starts[first] = np.repeat(opens, sizes)
    place = np.empty(n, np.int64)
    place[first] = np.arange(n)

    order, place, group = first.tolist(), place.tolist(), starts.tolist()  # group: where the suffix's group begins
    size = [0] * n
    for at, k in zip(opens.tolist(), sizes.tolist(), strict=True):
        size[at] = k
    back = [-1] * n
    end = n
    while end:
        low = group[order[end - 1]]
        if end - low == 1:
            i = order[low]
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = back[p]
            back[i] = p
            levels = [[p]] if p >= 0 else []
        else:
            hits: dict[int, int] = {}
            for i in sorted(order[low:end]):
                p = i - 1
                while p >= 0 and group[p] >= low:
                    p = back[p]
                back[i] = p
                if p >= 0:
                    hits[p] = hits.get(p, 0) + 1
            most = max(hits.values(), default=0)
            if most == 1:
                levels = [list(hits)]
            else:
                by: dict[int, list[int]] = {}
                for p, k in hits.items():
                    by.setdefault(k, []).append(p)
                levels = [by[k] for k in sorted(by, reverse=True)]
        for moved in levels:
            for p in moved:  # to the end of its group
                g = group[p]
                size[g] = left = size[g] - 1
                to, at = g + left, place[p]
                if at != to:
                    q = order[to]
                    order[to], order[at] = p, q
                    place[p], place[q] = to, at
            for p in moved:
                g = group[p]
                group[p] = g + size[g]
            for p in moved:
                size[group[p]] += 1
        end = low

    out, filled, done = [0] * n, [0] * n, bytearray(n)

    def walk(s: int) -> None:
        while s >= 0 and not done[s]:
            g = group[s]
            out[g + filled[g]] = s
            filled[g] += 1
            done[s] = 1
            s = back[s]

    walk(n - 1)
    for i in range(n):
        walk(out[i] - 1)
    return np.array(out, np.int64)
