"""Suffix arrays by linear grouping construction, for many short texts side by side.

Phase 1 groups suffixes by their Lyndon prefix: starting from groups by first symbol, groups are taken in descending
order; each member's previous-smaller pointer leads to the nearest suffix on its left that lies in a lower group, and the
suffixes pointed at move behind the rest of their group, together where as many pointers reach them. Phase 2 goes up the
order: the suffix before the one just placed, and then those along its pointers, each take the first free place of their
group. Nothing is renamed or solved recursively.

The texts are lanes of one flat array: step after step, each lane handles its own next group or place, so that a step is a
few array operations however many lanes there are. Symbols are positive, and every lane ends with a 0 of its own.
"""

from __future__ import annotations

import numpy as np

from panelspark.llm.common import ranges


def suffix_arrays(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The suffix array of each lane (positions in the flat array), lane after lane."""
    n, base, lengths = len(text), np.asarray(starts, np.int64), np.asarray(lengths, np.int64)
    lane = np.repeat(np.arange(len(base)), lengths)
    first = base[lane]
    sa = np.argsort(lane * (int(text.max()) + 1) + text, kind="stable")
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = (text[sa[1:]] != text[sa[:-1]]) | (lane[sa[1:]] != lane[sa[:-1]])
    heads = np.flatnonzero(new)
    size = np.zeros(n, np.int64)
    size[heads] = np.diff(np.append(heads, n))
    group = np.empty(n, np.int64)  # of each suffix: where its group begins in sa
    group[sa] = np.repeat(heads, size[heads])
    prev = np.full(n, -1, np.int64)
    marked = np.zeros(n, bool)
    at = base + lengths - 1
    while True:
        live = np.flatnonzero(at > base)
        if not len(live):
            break
        begin = group[sa[at[live]]]
        count = at[live] - begin + 1
        at[live] = begin - 1
        low = np.repeat(begin, count)
        members = sa[low + ranges(count)]
        p = members - 1
        p[p < first[members]] = -1
        prev[members] = p
        climb = np.flatnonzero(p >= 0)
        climb = climb[group[p[climb]] >= low[climb]]
        while len(climb):
            p[climb] = prev[p[climb]]
            prev[members[climb]] = p[climb]
            climb = climb[p[climb] >= 0]
            climb = climb[group[p[climb]] >= low[climb]]
        reached = np.sort(p[p >= 0])
        if not len(reached):
            continue
        lead = np.ones(len(reached), bool)
        lead[1:] = reached[1:] != reached[:-1]
        cut = np.flatnonzero(lead)
        pointers = np.diff(np.append(cut, len(reached)))
        reached = reached[cut]
        g = group[reached]
        order = np.lexsort((pointers, g))
        reached, pointers, g = reached[order], pointers[order], g[order]
        lead = np.ones(len(g), bool)
        lead[1:] = g[1:] != g[:-1]
        cut = np.flatnonzero(lead)
        many = np.diff(np.append(cut, len(g)))
        own = g[cut]
        tail = np.repeat(own + size[own] - many, many)
        target = tail + ranges(many)
        old = place[reached]
        marked[reached] = True
        there = sa[target]
        out = there[~marked[there]]
        marked[reached] = False
        free = old < tail
        if len(out):
            # Both lists are in the order of their groups, as many for each.
            gaps = old[free]
            sa[gaps], place[out] = out, gaps
        sa[target], place[reached] = reached, target
        lead[1:] |= pointers[1:] != pointers[:-1]
        cut = np.flatnonzero(lead)
        run = np.diff(np.append(cut, len(g)))
        size[own] -= many
        size[target[cut]] = run
        group[reached] = np.repeat(target[cut], run)
    free = np.arange(n, dtype=np.int64)  # of a group: its first free place, by where the group begins
    placed = np.zeros(n, bool)
    sa = np.empty(n, np.int64)
    sa[base] = base + lengths - 1
    placed[base + lengths - 1] = True
    order = np.argsort(-lengths, kind="stable")
    base, lengths = base[order], lengths[order]
    still = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), side="right")  # lanes longer than i, for each i
    for i in range(int(lengths[0])):
        s = sa[base[: still[i]] + i] - 1
        s = s[(s >= 0)]
        s = s[(text[s] > 0) & ~placed[s]]
        while len(s):
            placed[s] = True
            g = group[s]
            sa[free[g]] = s
            free[g] += 1
            s = prev[s]
            s = s[s >= 0]
            s = s[~placed[s]]
    return sa
