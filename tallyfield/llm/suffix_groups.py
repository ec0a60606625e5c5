"""Suffix arrays by linear grouping, for many short strings at once.

Phase one keeps the suffixes of a string in groups that share a Lyndon prefix, in order.
Groups are processed from the highest down. For each suffix of a group the previous smaller
one (the nearest to the left in a lower group) is found over the pointers that exist; a
suffix that is the previous smaller one of k members has its prefix prolonged by k copies of
the group's, and moves to a new group right above its old one, more copies higher. Phase two
goes up from the end marker: the suffix left of each one that has its place gets the next
place of its group, and so do those that its pointers lead to. Nothing is renamed and no
smaller string is sorted first.

All strings take each step together, as array operations; a string's steps number at most
its length.
"""

from __future__ import annotations

import numpy as np


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every span, in a row."""
    ends = np.cumsum(sizes)
    out = np.repeat((starts - (ends - sizes)).astype(np.int32), sizes)
    out += np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
    return out


def suffix_arrays(symbols: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Suffix arrays of strings that stand one behind the other in ``symbols``.

    Each string has its own suffixes, as positions in ``symbols``, in ascending order; ends
    of strings are lower than every symbol.
    """
    lens = np.asarray(lens, np.int64)
    n_strings = len(lens)
    if n_strings == 0 or not len(symbols):
        return np.zeros(0, np.int64)
    size = lens + 1
    base = np.cumsum(size) - size
    total = int(size.sum())
    text = np.zeros(total, np.int64)
    mark = base + lens  # places of the end markers
    body = np.ones(total, bool)
    body[mark] = False
    text[body] = np.asarray(symbols, np.int64) + 1
    sid = np.repeat(np.arange(n_strings), size)

    order = np.argsort(sid * (int(text.max()) + 1) + text)  # the order within a group is free
    order = order.astype(np.int32)
    place = np.empty(total, np.int32)
    place[order] = np.arange(total, dtype=np.int32)
    s, t = sid[order], text[order]
    new = np.concatenate(([True], (s[1:] != s[:-1]) | (t[1:] != t[:-1])))
    starts = np.flatnonzero(new).astype(np.int32)
    group = np.empty(total, np.int32)
    group[order] = starts[np.cumsum(new) - 1]
    count = np.zeros(total + 1, np.int32)
    count[starts] = np.diff(np.append(starts, total))
    depth = np.zeros(total, np.int32)
    depth[starts] = 1
    prev = np.arange(total, dtype=np.int32) - np.int32(1)
    prev[base] = -1
    moved = np.zeros(total, bool)

    # phase one
    end = (base + size).astype(np.int32)
    base = base.astype(np.int32)
    act = np.flatnonzero(lens > 0)
    while len(act):
        e = end[act]
        top = group[order[e - 1]]
        members = order[_spans(top, e - top)]
        own = np.repeat(top, e - top)
        p = prev[members]
        look = np.arange(len(p))
        while True:
            look = look[p[look] >= 0]
            look = look[group[p[look]] >= own[look]]
            if not len(look):
                break
            p[look] = prev[p[look]]
            prev[members] = p
        ok = p >= 0
        j, at, k = np.unique(p[ok], return_index=True, return_counts=True)
        if len(j):
            u = depth[own[ok][at]]
            h = group[j]
            o = np.lexsort((k, h))
            j, k, u, h = j[o], k[o], u[o], h[o]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            m = np.diff(np.append(first, len(j)))
            h_end = h[first] + count[h[first]]
            slot = _spans(h_end - m, m)
            # who stands in those slots and stays goes to the places that are left
            moved[j] = True
            there = order[slot]
            stay = there[~moved[there]]
            was = place[j]
            holes = was[was < np.repeat(h_end - m, m)]
            order[holes], place[stay] = stay, holes
            order[slot], place[j] = j, slot
            moved[j] = False
            run = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (k[1:] != k[:-1]))))
            longer = depth[h[run]] + k[run] * u[run]
            count[h[first]] -= m
            count[slot[run]] = np.diff(np.append(run, len(j)))
            depth[slot[run]] = longer
            group[j] = np.repeat(slot[run], np.diff(np.append(run, len(j))))
        end[act] = top
        act = act[top > base[act] + 1]

    # phase two
    out = np.full(total + 1, -1, np.int32)
    free = np.arange(total + 1, dtype=np.int32)
    placed = np.zeros(total + 1, bool)
    placed[-1] = True  # no suffix: prev and left neighbour of the first lead here
    out[base] = mark
    placed[mark] = True
    stop = (base + size).astype(np.int32)
    act = np.flatnonzero(lens > 0)
    r = base[act].copy()
    s = (mark[act] - 1).astype(np.int32)
    low, high = base[act], stop[act]
    while len(r):
        can = np.flatnonzero(~placed[s])
        if len(can):
            x = s[can]
            g = group[x]
            to = free[g]
            free[g] = to + 1
            out[to] = x
            placed[x] = True
            s[can] = prev[x]
        no = np.flatnonzero(placed[s])
        if len(no):
            r[no] += 1
            more = r < high
            if not more.all():
                r, s, low, high = r[more], s[more], low[more], high[more]
                no = np.flatnonzero(placed[s])
            x = out[r[no]]
            s[no] = np.where(x > low[no], x - 1, -1)
    result = out[:total]
    result = result[body[result]]
    return result - sid[result]
