"""Suffix arrays by linear grouping."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """The starts of the suffixes of ``text`` in sorted order. ``text`` ends with a symbol that
    is smaller than all others and stands nowhere else.

    First part: suffixes are put in groups by their longest Lyndon prefix. Groups start as the
    suffixes of one first symbol and are visited from the highest down. A suffix of the
    visited group points to the nearest suffix before it in a lower group; the prefix
    of the one pointed to grows by the group's prefix, once for each pointer, so it moves to
    a new group right above its own (more pointers, higher group).

    Second part: from the lowest suffix on, the suffix before each one and those along its
    pointers are the ones that continue with it, so they take the next place of their
    groups. No symbol is renamed and no smaller problem solved.
    """
    n = len(text)
    starts: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        starts.setdefault(c, []).append(i)
    # Groups by number, linked to the next lower and higher one. A member that has moved on
    # stays listed in its old group and is passed over there.
    members = [starts[c] for c in sorted(starts)]
    lower = list(range(-1, len(members) - 1))
    higher = [*range(1, len(members)), -1]
    visited = [False] * len(members)
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    pointer = [-1] * n
    descending: list[tuple[int, int]] = []
    g = len(members) - 1
    while g >= 0:
        visited[g] = True
        times: dict[int, int] = {}
        size = 0
        for i in members[g]:
            if group[i] != g:
                continue
            size += 1
            p = i - 1
            while p >= 0 and visited[group[p]]:
                p = pointer[p]
            pointer[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        members[g] = []
        if size:
            descending.append((g, size))
        moved: dict[tuple[int, int], list[int]] = {}
        for p, k in times.items():
            moved.setdefault((group[p], k), []).append(p)
        # Of one group those with most pointers first: each lands right above the old group.
        for old, k in sorted(moved, reverse=True):
            new, top = len(members), higher[old]
            members.append(moved[old, k])
            visited.append(False)
            lower.append(old)
            higher.append(top)
            higher[old] = new
            if top >= 0:
                lower[top] = new
            for p in moved[old, k]:
                group[p] = new
        g = lower[g]
    place = [0] * len(members)
    at = 0
    for g, size in reversed(descending):
        place[g] = at
        at += size
    order = [-1] * n
    order[0] = n - 1
    taken = [False] * n
    taken[n - 1] = True
    for k in range(n):
        i = order[k] - 1
        while i >= 0 and not taken[i]:
            g = group[i]
            order[place[g]] = i
            place[g] += 1
            taken[i] = True
            i = pointer[i]
    return order
