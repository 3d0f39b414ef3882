"""Suffix arrays by induced sorting and permuted common prefixes, with numpy doing each bucket's wave at once."""

from __future__ import annotations

import numpy as np

#: Names up to which the reduced string is sorted by recursion.
WIDE = 512


def types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last symbol must be the unique smallest."""
    n = len(t)
    s = np.ones(n, bool)
    if n > 1:
        differs = np.flatnonzero(t[:-1] != t[1:])
        after = differs[np.searchsorted(differs, np.arange(n - 1))]
        s[:-1] = t[after] < t[after + 1]
    return s


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """Places all suffixes, given the leftmost-smaller ones in order (within a first symbol)."""
    n = len(t)
    total, small = np.bincount(t, minlength=size), np.bincount(t[s], minlength=size)
    start = np.concatenate(([0], np.cumsum(total)[:-1]))
    mid, end = start + total - small, start + total
    sa = np.full(n, -1, np.int32)
    first = t[lms]
    lms = lms.astype(np.int32)
    by_first = lms[np.argsort(first, kind="stable")]
    at = np.concatenate(([0], np.cumsum(np.bincount(first, minlength=size))))
    head = start.copy()

    def put(p: np.ndarray) -> None:
        c = t[p]
        o = np.argsort(c, kind="stable")
        c = c[o]
        k = np.bincount(c, minlength=size)
        sa[head[c] + np.arange(len(c)) - (np.cumsum(k) - k)[c]] = p[o]
        head[:] += k

    for c in range(size):
        if not total[c]:
            continue
        done = start[c]
        while done < head[c]:
            p, done = sa[done : head[c]] - 1, head[c]
            p = p[p >= 0]
            if len(p := p[~s[p]]):
                put(p)
        p = by_first[at[c] : at[c + 1]] - 1
        if len(p := p[p >= 0]):
            put(p)
    tail = end.copy()

    def put_back(p: np.ndarray) -> None:
        c = t[p]
        o = np.argsort(c, kind="stable")
        c = c[o]
        k = np.bincount(c, minlength=size)
        sa[tail[c] - 1 - (np.arange(len(c)) - (np.cumsum(k) - k)[c])] = p[o]
        tail[:] -= k

    for c in range(size - 1, -1, -1):
        if not total[c]:
            continue
        done = end[c]
        while done > tail[c]:
            p, done = sa[tail[c] : done][::-1] - 1, tail[c]
            p = p[p >= 0]
            if len(p := p[s[p]]):
                put_back(p)
        p = sa[start[c] : mid[c]][::-1] - 1
        p = p[p >= 0]
        if len(p := p[s[p]]):
            put_back(p)
        if c == t[-1] and sa[start[c]] < 0:
            sa[start[c]] = n - 1
            tail[c] -= 1
            if n > 1 and s[n - 2]:
                put_back(np.array([n - 2]))
    return sa


def _sorted_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the reduced string: by recursion where it has few names; where it has many, by names of
    pairs, then of pairs of pairs and so on, until all differ, as induction works through the names' buckets one by one."""
    if int(names.max()) < WIDE:
        return suffix_array(np.append(names + 1, 0).astype(np.uint16))[1:]
    n = len(names)
    rank, step = names.astype(np.int64), 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[:-step] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers whose last symbol is 0 and unique: leftmost-smaller substrings are sorted by
    induction and named, their string is sorted by recursion if names repeat, and its order induces all suffixes."""
    n, size = len(t), int(t.max()) + 1
    t = np.ascontiguousarray(t)
    if n == 1:
        return np.zeros(1, np.int64)
    s = types(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = s[1:] & ~s[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) > 1:
        order = _induce(t, s, lms, size)
        order = order[is_lms[order]]
        upto = np.zeros(n, np.int64)
        upto[lms[:-1]] = lms[1:]
        upto[lms[-1]] = n - 1
        a, b = order[:-1], order[1:]
        length = upto - np.arange(n) + 1
        same = length[a] == length[b]
        live, j = np.flatnonzero(same), 0
        while len(live):
            bad = t[a[live] + j] != t[b[live] + j]
            same[live[bad]] = False
            live = live[~bad]
            j += 1
            live = live[length[a[live]] > j]
        named = np.zeros(n, np.int64)
        named[order] = np.concatenate(([0], np.cumsum(~same)))
        lms = order if not same.any() else lms[_sorted_names(named[lms])]
    return _induce(t, s, lms, size)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """PLCP: for each position, the common prefix with the suffix before it in order. Only irreducible values are compared."""
    n = len(t)
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n, dtype=np.int32)
    has = phi >= 0
    reducible = has & (i > 0) & (phi > 0)
    reducible[reducible] = t[i[reducible] - 1] == t[phi[reducible] - 1]
    live = np.flatnonzero(has & ~reducible).astype(np.int32)
    value = np.zeros(n, np.int32)
    padded = np.concatenate((t, np.zeros(1, t.dtype)))
    got = np.zeros(len(live), np.int32)
    at = np.arange(len(live))
    while len(at):
        p, q = live[at] + got[at], phi[live[at]] + got[at]
        ok = (p < n) & (q < n)
        ok[ok] = padded[p[ok]] == padded[q[ok]]
        at = at[ok]
        got[at] += 1
    value[live] = got
    reach = np.where(has & ~reducible, value + i, i)
    return np.maximum(np.maximum.accumulate(reach) - i, 0) * has
