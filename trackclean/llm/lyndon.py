"""Suffix arrays by linear grouping, for many short strings at once.

Suffixes are grouped by their first symbol; groups are processed in descending order. Each member of the group in hand
points to the nearest suffix on its left that is in a lower group (its previous-smaller pointer). What is pointed to, by
how many, leaves its group for a new one just above: its known prefix has grown by that many copies of the group's. In
the end suffixes are grouped by their longest Lyndon prefixes, and one pass from the smallest suffix upwards emits each
group's order along the pointers. No ranks are renamed and nothing recurs.

The strings advance together, each with the group (then the suffix) that it is at, so that every step is an array
operation over all of them.
"""

from __future__ import annotations

import numpy as np


def ragged(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All of first[0]..last[0]-1, first[1]..last[1]-1, ..."""
    n = last - first
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def lyndon_groups(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, pointer) of each suffix: its group's first place in the order of its string, and its pointer or -1."""
    n = len(text)
    string = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((text, string))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    head = np.ones(n, bool)
    head[1:] = (text[order[1:]] != text[order[:-1]]) | (string[order[1:]] != string[order[:-1]])
    starts = np.flatnonzero(head)
    group = np.empty(n, np.int64)
    group[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    end = np.zeros(n, np.int64)
    end[starts] = np.append(starts[1:], n)
    pointer = np.arange(-1, n - 1)
    pointer[bounds[:-1]] = -1
    done, marked = np.zeros(n + 1, bool), np.zeros(n, bool)  # done[-1] stays False: pointer -1 ends a walk
    first, at = bounds[:-1].copy(), bounds[1:].copy()
    while len(first):
        low = group[order[at - 1]]
        members = order[ragged(low, at)]
        done[members] = True
        p = pointer[members]
        walk = np.flatnonzero(done[p])
        while len(walk):
            p[walk] = pointer[p[walk]]
            walk = walk[done[p[walk]]]
        pointer[members] = p
        to, times = np.unique(p[p >= 0], return_counts=True)
        if len(to):
            by = np.lexsort((times, group[to]))
            to, times = to[by], times[by]
            old = group[to]
            new = np.ones(len(to), bool)
            new[1:] = old[1:] != old[:-1]
            many = np.diff(np.append(np.flatnonzero(new), len(to)))
            top = end[old[new]]
            slots = ragged(top - many, top)
            marked[to] = True
            moved = order[slots]
            moved = moved[~marked[moved]]
            freed = place[to]
            freed = freed[freed < np.repeat(top - many, many)]
            marked[to] = False
            order[freed], place[moved] = moved, freed
            order[slots], place[to] = to, slots
            end[old[new]] = top - many
            new[1:] |= times[1:] != times[:-1]
            heads = np.flatnonzero(new)
            size = np.diff(np.append(heads, len(to)))
            group[to] = np.repeat(slots[heads], size)
            end[slots[heads]] = slots[heads] + size
        live = low > first
        first, at = first[live], low[live]
    return group, pointer


def suffix_arrays(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffixes of each string in order, one string after another.

    text: non-negative symbols of all strings; bounds: each string's first place, then the end. The last symbol of a
    string must be smaller than all others of it.
    """
    group, pointer = lyndon_groups(text, bounds)
    n = len(text)
    free = np.arange(n)  # of each group, by its first place: the next place to fill
    placed = np.zeros(n + 1, bool)
    placed[-1] = True
    out = np.empty(n, np.int64)
    at, last = bounds[:-1].copy(), bounds[1:]
    out[at] = last - 1
    placed[last - 1] = True
    j = last - 2
    j[np.diff(bounds) < 2] = -1
    first = bounds[:-1]
    while len(at):
        put = ~placed[j]
        x = j[put]
        g = group[x]
        out[free[g]] = x
        free[g] += 1
        placed[x] = True
        j[put] = pointer[x]
        step = ~put
        at[step] += 1
        live = at < last
        if not live.all():
            at, last, first, j, step = at[live], last[live], first[live], j[live], step[live]
        s = out[at[step]]
        j[step] = np.where(s > first[step], s - 1, -1)
    return out
