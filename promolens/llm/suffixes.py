"""Suffix arrays of many short strings at once, by linear grouping.

Phase 1 groups the suffixes of each string by their first symbol and handles the
groups in descending order. A group's suffixes share a Lyndon prefix. For each of
them the previous suffix of a lower group is found by following pointers; those
previous suffixes leave their group for a new one right above it, the more
children in the current group the higher. Afterwards every group stands for one
Lyndon prefix. Phase 2 fills the array from the lowest suffix on: each entry
places its predecessor, and those linked to it by the pointers, at the front of
their groups. Nothing is renamed or solved recursively.

All strings of a call advance together, one group or one entry of each in every
step, so that a step is a few numpy operations over many strings.
"""

from __future__ import annotations

import numpy as np


def _grouped(symbol: np.ndarray, lane: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1: start of each suffix's group, and its previous smaller suffix."""
    n = len(symbol)
    order = np.lexsort((symbol, lane))
    cuts = np.flatnonzero(np.concatenate([[True], (symbol[order[1:]] != symbol[order[:-1]]) | (lane[order[1:]] != lane[order[:-1]])]))
    size = np.zeros(n + 1, np.int32)
    size[cuts] = np.diff(np.concatenate([cuts, [n]]))
    group = np.empty(n, np.int32)
    group[order] = np.repeat(cuts, size[cuts])
    start_of = np.zeros(n + 1, np.int32)  # by a group's last slot
    start_of[cuts + size[cuts] - 1] = cuts
    # a group's suffixes stand in its slots
    at_slot, slot_of = order.astype(np.int32), np.empty(n, np.int32)
    slot_of[order] = np.arange(n, dtype=np.int32)
    group[last] = -1  # a string's end is below everything
    group[0] = -1
    previous = np.arange(-1, n - 1, dtype=np.int32)
    current = start_of[last]
    mark = np.zeros(n, np.int8)
    going = np.flatnonzero(current > first)
    while len(going):
        many = size[current[going]]
        members = at_slot[np.repeat(current[going] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]
        at, own = previous[members], group[members]
        while True:
            on = group[at] >= own
            if not on.any():
                break
            at[on] = previous[at[on]]
            previous[members] = at
        parents, children = np.unique(at[group[at] >= 0], return_counts=True)
        if len(parents):
            above = group[parents]
            order = np.lexsort((children, above))
            parents, children, above = parents[order], children[order], above[order]
            k = len(parents)
            new_group = np.concatenate([[True], above[1:] != above[:-1]])
            new_part = new_group | np.concatenate([[True], children[1:] != children[:-1]])
            whole = np.flatnonzero(new_group)
            moved = np.diff(np.concatenate([whole, [k]]))
            ends = np.repeat(whole + moved, moved)  # end of the group's run, for each parent
            parts = np.flatnonzero(new_part)
            counts = np.diff(np.concatenate([parts, [k]]))
            starts = above[parts] + size[above[parts]] - (ends[parts] - parts)
            slots = np.repeat(above[whole] + size[above[whole]] - moved - whole, moved) + np.arange(k)
            size[above[whole]] -= moved  # what is left of each old group
            rest = above[whole][size[above[whole]] > 0]
            start_of[rest + size[rest] - 1] = rest
            size[starts] = counts
            start_of[starts + counts - 1] = starts
            group[parents] = np.repeat(starts, counts)
            # the parents take their groups' last slots, in order; whoever stood there takes theirs
            left = slot_of[parents]
            mark[slots] |= 1
            mark[left] |= 2
            free, others = left[mark[left] == 2], at_slot[slots[mark[slots] == 1]]
            mark[slots] = mark[left] = 0
            at_slot[free], slot_of[others] = others, free
            at_slot[slots], slot_of[parents] = parents, slots
        below = current[going] - 1
        going, below = going[below > first[going]], below[below > first[going]]
        current[going] = start_of[below]
    return group, previous


def suffix_arrays(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffix order of each string: positions in ``symbols``, string after string.

    ``symbols`` holds the strings one after the other, values from 0 on; string s
    has ``sizes[s]`` of them.
    """
    sizes = np.asarray(sizes, np.int64)
    k = len(sizes)
    # one slot in front, and one for the end of each string
    first = 1 + np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if k else np.zeros(0, np.int64)
    last = first + sizes
    n = int(last[-1]) + 1 if k else 1
    lane = np.concatenate([[0], np.repeat(np.arange(k), sizes + 1)]).astype(np.int32)
    symbol = np.zeros(n, np.int32)
    inside = np.ones(n, bool)
    inside[0] = False
    inside[last] = False
    symbol[inside] = np.asarray(symbols, np.int64) + 1
    symbol[0] = -1
    group, previous = _grouped(symbol, lane, first, last)
    out = np.zeros(n, np.int32)
    out[first] = last
    front = np.arange(n + 1, dtype=np.int32)  # by a group's first slot: its next free one
    placed = np.zeros(n, bool)
    going = np.arange(k)
    t = 0
    while len(going):
        at = out[first[going] + t] - 1
        while True:
            at = at[(group[at] >= 0) & ~placed[at]]
            if not len(at):
                break
            slot = group[at]
            out[front[slot]] = at
            front[slot] += 1
            placed[at] = True
            at = previous[at]
        t += 1
        if t % 8 == 0 or len(going) < 8:
            going = going[sizes[going] >= t]
        else:
            going = going[first[going] + t <= last[going]]
    body = np.ones(n, bool)
    body[0] = False
    body[first] = False  # the ends
    return out[body] - lane[out[body]] - 1
