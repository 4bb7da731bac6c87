"""Suffix sorting by linear grouping: Lyndon-prefix groups in descending order, then each group's order is emitted."""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of all suffixes of `text` (non-negative numbers) in lexicographic order.

    Suffixes start in groups by their first symbol. Groups are processed from the highest down. For every member the
    pointer `smaller` finds the nearest earlier suffix in a lower group; a suffix that k members point to is longer by k
    copies of this group's prefix, so it moves to a new group above the one it was in, the more copies the higher. In
    the end the members of a group share their longest Lyndon prefix. Then suffixes are emitted from the smallest on:
    the one emitted last tells, along the pointers, which suffixes come next within their groups. Nothing is renamed and
    nothing is sorted twice.
    """
    n = len(text)
    group = list(text)
    members: dict[int, list[int]] = {}
    for at, symbol in enumerate(text):
        members.setdefault(symbol, []).append(at)
    order = sorted(members)
    below = dict(zip(order, [-1, *order[:-1]]))
    above = dict(zip(order, [*order[1:], -1]))
    fresh = (order[-1] if order else 0) + 1
    smaller = [-1] * n
    done = bytearray(n)
    current = order[-1] if order else -1
    while current != -1:
        own = [at for at in members[current] if group[at] == current]
        members[current] = own
        if len(own) == 1:  # points to one suffix at most, which then is alone in its new group
            at = own[0]
            before = at - 1
            while before >= 0 and done[before]:
                before = smaller[before]
            smaller[at] = before
            done[at] = 1
            if before >= 0:
                left = group[before]
                group[before], members[fresh] = fresh, [before]
                over = above[left]
                above[left], below[fresh], above[fresh] = fresh, left, over
                if over != -1:
                    below[over] = fresh
                fresh += 1
            current = below[current]
            continue
        pointed: dict[int, int] = {}
        for at in own:  # earlier members first: their pointers are known when later ones jump over them
            before = at - 1
            while before >= 0 and (done[before] or group[before] == current):
                before = smaller[before]
            smaller[at] = before
            if before >= 0:
                pointed[before] = pointed.get(before, 0) + 1
        for at in own:
            done[at] = 1
        moved: dict[tuple[int, int], list[int]] = {}
        for at, copies in pointed.items():
            moved.setdefault((copies, group[at]), []).append(at)
        for copies, left in sorted(moved, reverse=True):
            found = moved[copies, left]
            found.sort()
            members[fresh] = found
            for at in found:
                group[at] = fresh
            over = above[left]
            above[left], below[fresh], above[fresh] = fresh, left, over
            if over != -1:
                below[over] = fresh
            fresh += 1
        current = below[current]

    start, at = {}, 0
    current = order[0] if order else -1
    while current != -1:
        start[current] = at
        at += len(members[current])
        current = above[current]
    out = [-1] * n
    placed = bytearray(n)
    for k in range(-1, n):
        at = (out[k] if k >= 0 else n) - 1  # before the first stands the empty suffix
        while at >= 0 and not placed[at]:
            own_group = group[at]
            out[start[own_group]] = at
            start[own_group] += 1
            placed[at] = 1
            at = smaller[at]
    return out
