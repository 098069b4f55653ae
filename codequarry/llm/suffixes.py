"""Linear-time suffix sorting by grouping (Baier's construction), and longest common prefixes.

Suffixes are first put in groups by their first symbol. Groups are then taken in descending order; each
member points to its previous suffix in a smaller group, and suffixes that are pointed at are split off into new groups
right behind their old ones, those pointed at more often further up. In the end suffixes share a group if and only if
they begin with the same Lyndon word. A second pass reads the order off: the suffix before an ordered one, and then
those its pointers lead to, take the next free places of their groups. Nothing is renamed or sorted recursively.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(text: Sequence[int]) -> list[int]:
    """Order of the suffixes of text, whose last symbol must be smaller than all others.

    A group is an interval of places and is named by its first place, so that names compare as groups do."""
    n = len(text)
    symbols = np.asarray(text)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    bounds = [*first.tolist(), n]
    group_of = np.empty(n, dtype=np.int64)
    group_of[order] = np.repeat(first, np.diff(bounds))
    group, order = group_of.tolist(), order.tolist()
    members = {a: order[a:b] for a, b in zip(bounds[:-1], bounds[1:])}
    ends = dict(zip(bounds[:-1], bounds[1:]))
    before = {b: a for a, b in ends.items()}
    prev = [-1] * n
    end = n
    while end > 0:
        start = before[end]
        pointed: dict[int, int] = {}
        for i in members[start]:
            if group[i] != start:
                continue  # was split off
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        split: dict[tuple[int, int], list[int]] = {}
        for p in sorted(pointed):
            split.setdefault((-pointed[p], group[p]), []).append(p)
        for (_, old), moved in sorted(split.items()):
            tail = ends[old]
            new = tail - len(moved)
            if new == old:
                continue  # all that is left of the group: its place stays
            before[tail], before[new] = new, old
            ends[new], ends[old] = tail, new
            members[new] = moved
            for p in moved:
                group[p] = new
        end = start
    out = [-1] * n
    out[0] = n - 1
    free = {g: g for g in ends}
    placed = [False] * n
    placed[n - 1] = True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            placed[s] = True
            s = prev[s]
    return out


def common_prefixes(text: Sequence[int], order: list[int]) -> list[int]:
    """Length of the common prefix of each suffix in the order with the one before it; 0 for the first."""
    n = len(order)
    place = [0] * n
    for i, s in enumerate(order):
        place[s] = i
    out, h = [0] * n, 0
    for s in range(n):
        r = place[s]
        if r == 0:
            h = 0
            continue
        t = order[r - 1]
        while s + h < n and t + h < n and text[s + h] == text[t + h]:
            h += 1
        out[r] = h
        if h:
            h -= 1
    return out
