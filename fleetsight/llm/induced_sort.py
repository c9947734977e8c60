"""Suffix arrays by induced sorting, and permuted common prefixes, over byte arrays.

Suffixes are larger (L) or smaller (S) than the one behind them. The leftmost-smaller ones (LMS) are put in order first:
their substrings are sorted by one induction, named, and the string of names is sorted recursively when names repeat.
A second induction from the ordered LMS suffixes then places all others, in linear time. Over a small alphabet the
inductions go bucket by bucket with array operations; over the many names of a deeper level they scan entry by entry.
"""

from __future__ import annotations

import numpy as np

INDEX = np.int32


def _smaller(s: np.ndarray) -> np.ndarray:
    """S-type flags; the last symbol is the unique smallest."""
    up = s[:-1] < s[1:]
    at = np.flatnonzero(s[:-1] != s[1:])
    return np.r_[up[at[np.searchsorted(at, np.arange(len(s) - 1))]], True]


def _by_bucket(s: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    counts = np.bincount(s, minlength=sigma)
    ends = np.cumsum(counts)
    sa = np.full(len(s), -1, INDEX)
    chars = s[lms]
    order = np.argsort(chars, kind="stable")
    lms, chars = lms[order], chars[order]
    edge = np.searchsorted(chars, np.arange(sigma + 1))
    head, full = (ends - counts), counts > 0

    def put(found: np.ndarray, at: np.ndarray, step: int) -> None:
        """Places suffixes at the ends of their buckets, in the order given."""
        c = s[found]
        order = np.argsort(c, kind="stable")
        c, found = c[order], found[order]
        new = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        k = np.diff(np.r_[new, len(c)])
        sa[at[c] + step * (np.arange(len(c)) - np.repeat(new, k))] = found
        at[c[new]] += step * k

    def before(found: np.ndarray, want_small: bool) -> np.ndarray:
        prev = found[found > 0] - 1
        return prev[small[prev] == want_small]

    start = head.copy()
    for c in np.flatnonzero(full):
        wave, later, done = sa[start[c] : head[c]], [], head[c]
        while len(wave):
            prev = before(wave, False)
            same = s[prev] == c
            later.append(prev[~same])
            own = prev[same]
            sa[done : done + len(own)] = own
            wave, done = own, done + len(own)
        head[c] = done
        later.append(before(lms[edge[c] : edge[c + 1]], False))
        later = np.concatenate(later)
        if len(later):
            put(later, head, 1)
    tail = ends - 1
    large_end = head  # the L part of each bucket ends here
    for c in np.flatnonzero(full)[::-1]:
        wave, later, done = sa[tail[c] + 1 : ends[c]][::-1], [], tail[c]
        while len(wave):
            prev = before(wave, True)
            same = s[prev] == c
            later.append(prev[~same])
            own = prev[same]
            sa[done - len(own) + 1 : done + 1] = own[::-1]
            wave, done = own, done - len(own)
        tail[c] = done
        later.append(before(sa[start[c] : large_end[c]][::-1], True))
        later = np.concatenate(later)
        if len(later):
            put(later, tail, -1)
    sa[0] = len(s) - 1  # the last symbol follows nothing
    return sa


def _by_entry(s: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    n = len(s)
    ends = np.cumsum(np.bincount(s, minlength=sigma))
    sa = [-1] * n
    tail = ends.tolist()
    for p, c in zip(lms[::-1].tolist(), s[lms[::-1]].tolist()):
        tail[c] -= 1
        sa[tail[c]] = p
    # symbol before a position where it is of the type wanted, else -1; position 0 and the empty entry -1 have none
    large, little = (np.r_[-1, np.where(small[:-1] == kind, s[:-1], -1), -1].tolist() for kind in (False, True))
    head = [0, *ends[:-1].tolist()]
    for p in sa:  # meets the entries it writes, all of them ahead
        c = large[p]
        if c >= 0:
            h = head[c]
            sa[h] = p - 1
            head[c] = h + 1
    tail = ends.tolist()
    for p in reversed(sa):
        c = little[p]
        if c >= 0:
            tail[c] = t = tail[c] - 1
            sa[t] = p - 1
    sa[0] = n - 1
    return np.array(sa, INDEX)


def _names(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings in text order, equal ones alike, numbered in sorted order."""
    length = np.zeros(len(s), INDEX)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    at = np.flatnonzero(same)
    k = 0
    while len(at):
        live = length[a[at]] > k
        at = at[live]
        equal = s[a[at] + k] == s[b[at] + k]
        same[at[~equal]] = False
        at = at[equal]
        k += 1
    name = np.zeros(len(s), INDEX)
    name[ordered] = np.r_[0, np.cumsum(~same)]
    return name[lms]


def _sorted(s: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of ``s``, whose last symbol is 0 and occurs nowhere else."""
    if len(s) == 1:
        return np.zeros(1, INDEX)
    induce = _by_bucket if sigma * 64 <= len(s) else _by_entry
    small = _smaller(s)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(INDEX)
    rough = induce(s, small, lms, sigma)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    names = _names(s, lms, rough[is_lms[rough]])
    top = int(names.max()) + 1
    if top == len(lms):
        order = np.empty(len(lms), INDEX)
        order[names] = lms
    else:
        order = lms[_sorted(names, top)]
    return induce(s, small, order, sigma)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of a byte array in ascending order; a suffix that ends sorts first."""
    if len(data) == 0:
        return np.zeros(0, INDEX)
    return _sorted(np.r_[data.astype(INDEX) + 1, INDEX(0)], 257)[1:]


def common_prefixes(data: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: at a position, the length shared with the suffix sorted just before it (0 for the first).

    Only positions whose left neighbours differ are compared, eight bytes at a time; at every other position the value
    is the one to its left less one.
    """
    n = len(data)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    here = np.arange(n)
    anew = np.ones(n, bool)
    both = (here > 0) & (phi > 0)
    anew[both] = data[here[both] - 1] != data[phi[both] - 1]
    at = here[anew]
    other = phi[at]
    value = np.zeros(len(at), np.int64)
    padded = np.r_[data, np.zeros(8, np.uint8)]
    words = np.ndarray((n + 1,), "<u8", padded.tobytes(), strides=(1,))
    live = np.flatnonzero(other >= 0)
    while len(live):
        a, b = at[live] + value[live], other[live] + value[live]
        room = n - np.maximum(a, b)
        differ = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        low = differ & (~differ + np.uint64(1))  # lowest differing bit
        step = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        value[live] += np.minimum(step, room)
        live = live[(step == 8) & (room > 8)]
    run = np.cumsum(anew) - 1
    return value[run] - (here - at[run])
