"""Suffix arrays by linear grouping over an integer alphabet."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of `text` in lexicographic order; a shorter suffix comes first.

    First pass: suffixes start in groups by first symbol. Groups are taken in descending order. The
    members of one are final: they share their Lyndon prefix. Each member's previous-smaller pointer
    goes to the nearest earlier suffix of a lower group, and that suffix's own prefix grows by the
    member's: among its group it moves above those that grow less.

    Second pass: suffixes are emitted in ascending order. An emitted suffix ends the Lyndon prefix of
    the one before it and of those along the pointers that are not emitted yet; each takes the next
    place of its group. Nothing is renamed, and no reduced text is sorted.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    first = np.argsort(text, kind="stable")
    ranked = text[first]
    heads = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    starts = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    by_suffix = np.empty(n, np.int64)
    by_suffix[first] = starts
    place = np.empty(n, np.int64)
    place[first] = np.arange(n)
    bounds = np.flatnonzero(np.concatenate([heads, [True]]))
    ends = np.zeros(n, np.int64)
    ends[bounds[:-1]] = bounds[1:]

    order, group, at, end_of = first.tolist(), by_suffix.tolist(), place.tolist(), ends.tolist()
    previous = [-1] * n
    end = n
    while end:
        start = group[order[end - 1]]
        if end - start == 1:
            i = order[start]
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                own = group[p]
                last = end_of[own] - 1
                if last > own:
                    _move(order, group, at, end_of, p, own, last)
        else:
            members = order[start:end]
            members.sort()
            grown: dict[int, int] = {}
            for i in members:
                p = i - 1
                while p >= 0 and group[p] >= start:
                    p = previous[p]
                previous[i] = p
                if p >= 0:
                    grown[p] = grown.get(p, 0) + 1
            if len(grown) == 1:
                p = next(iter(grown))
                own = group[p]
                last = end_of[own] - 1
                if last > own:
                    _move(order, group, at, end_of, p, own, last)
            elif grown:
                _split(order, group, at, end_of, grown)
        end = start

    out = [0] * n
    free = list(range(n))
    done = bytearray(n)
    s = n - 1
    k = 0
    while True:
        while s >= 0 and not done[s]:
            done[s] = 1
            own = group[s]
            out[free[own]] = s
            free[own] += 1
            s = previous[s]
        if k == n:
            return np.array(out, np.int64)
        s = out[k] - 1
        k += 1


def _move(order: list, group: list, at: list, end_of: list, p: int, own: int, last: int) -> None:
    """Make suffix `p` a group of its own above the rest of its group."""
    here, other = at[p], order[last]
    order[here], at[other] = other, here
    order[last], at[p] = p, last
    group[p] = last
    end_of[own], end_of[last] = last, last + 1


def _split(order: list, group: list, at: list, end_of: list, grown: dict[int, int]) -> None:
    """Move suffixes above the rest of their groups, those that grew by more above the others."""
    touched: dict[int, dict[int, list[int]]] = {}
    for p, k in grown.items():
        touched.setdefault(group[p], {}).setdefault(k, []).append(p)
    for own, by_growth in touched.items():
        top = end_of[own]
        for k in sorted(by_growth, reverse=True):
            moved = by_growth[k]
            low = top - len(moved)
            if low == own:
                break  # all that is left of the group grew alike
            for p in moved:
                top -= 1
                here, other = at[p], order[top]
                order[here], at[other] = other, here
                order[top], at[p] = p, top
                group[p] = low
            end_of[low] = low + len(moved)
            end_of[own] = low


def common_prefixes(symbols: np.ndarray, order: np.ndarray, enough: int) -> np.ndarray:
    """Common leading bytes, up to `enough`, of each suffix and the one before it in `order`.

    Symbols hold 8 bytes each, the first one highest. The text ends with what equals nothing.
    """
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    n, step = len(symbols), 0
    while len(live) and step * 8 < enough:
        a, b = order[live] + step, order[live - 1] + step
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
        differ = symbols[a] ^ symbols[b]
        same = differ == 0
        out[live[same]] += 8
        part, rest = live[~same], differ[~same]
        lead = np.zeros(len(rest), np.int64)
        for k in range(1, 8):
            lead += (rest >> np.uint64(64 - 8 * k)) == 0
        out[part] += lead
        live = live[same]
        step += 1
    return np.minimum(out, enough)
