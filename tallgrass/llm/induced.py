"""Suffix arrays by induced sorting, in array operations.

Suffixes are classified as smaller or larger than their right neighbour; the leftmost-smaller (LMS) substrings are sorted by inducing, named, and
the string of their names is sorted recursively; from the sorted LMS suffixes the larger and then the smaller suffixes are induced.

Inducing is a scan in which an entry may place another further on. Here a run of buckets is scanned at once: if no entry in it places
another inside the same run, all its placements are made in one step, else the run is halved, down to single buckets, in which
the chain of equal symbols is followed wave by wave. Every entry is placed once, in the order of the scan.
"""

from __future__ import annotations

import numpy as np


def _types(text: np.ndarray) -> np.ndarray:
    """True for suffixes that are smaller than their right neighbour; the last one counts as such."""
    step = np.sign(np.diff(text))
    rise = np.append(step, 1)
    n = len(text)
    decided = np.where(rise != 0, np.arange(n), n)
    decided = np.minimum.accumulate(decided[::-1])[::-1]  # the next place whose comparison is not a tie
    return rise[decided] > 0


class _Scan:
    """One direction of inducing. ``free`` is where the next entry of each bucket goes."""

    def __init__(self, text: np.ndarray, sa: np.ndarray, chosen: np.ndarray, starts: np.ndarray, free: np.ndarray, forward: bool):
        self.text, self.sa, self.chosen, self.starts, self.free, self.forward = text, sa, chosen, starts, free, forward
        self.short = np.uint16 if len(starts) <= 1 << 16 else np.int32  # two bytes are sorted by radix

    def _before(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Left neighbours of the entries, of the type to be induced, in the order of the scan, and their symbols."""
        if not self.forward:
            entries = entries[::-1]
        left = entries[entries > 0] - 1
        left = left[self.chosen[left]]
        return left, self.text[left]

    def _place(self, left: np.ndarray, symbols: np.ndarray) -> None:
        n = len(left)
        if not n:
            return
        order = symbols.astype(self.short).argsort(kind="stable")
        ranked = symbols[order]
        new = (ranked[1:] != ranked[:-1]).nonzero()[0]
        first = np.zeros(len(new) + 1, np.int64)
        first[1:] = new + 1
        counts = np.empty_like(first)
        counts[:-1] = first[1:] - first[:-1]
        counts[-1] = n - first[-1]
        heads = ranked[first]
        if self.forward:
            at = (self.free[heads] - first).repeat(counts) + np.arange(n)
            self.free[heads] += counts
        else:
            at = (self.free[heads] + first).repeat(counts) - np.arange(n)
            self.free[heads] -= counts
        self.sa[at] = left[order]

    def _one(self, c: int) -> None:
        """A single bucket: first what it has from elsewhere and from itself, of the induced type, then the rest."""
        lo, hi = self.starts[c], self.starts[c + 1]
        done = lo if self.forward else hi - 1
        while (done < self.free[c]) if self.forward else (done > self.free[c]):
            upto = self.free[c]
            left, symbols = self._before(self.sa[done:upto] if self.forward else self.sa[upto + 1 : done + 1])
            self._place(left, symbols)
            done = upto
        rest = self.sa[done:hi] if self.forward else self.sa[lo : done + 1]
        self._place(*self._before(rest[rest >= 0]))

    def run(self, c1: int, c2: int) -> None:
        """Buckets c1 ... c2 - 1."""
        if c2 - c1 == 1:
            self._one(c1)
            return
        entries = self.sa[self.starts[c1] : self.starts[c2]]
        entries = entries[entries >= 0]
        left, symbols = self._before(entries)
        if not len(left):
            return
        if (symbols >= c2).all() if self.forward else (symbols < c1).all():
            self._place(left, symbols)
            return
        middle = (c1 + c2) // 2
        for part in ((c1, middle), (middle, c2))[:: 1 if self.forward else -1]:
            self.run(*part)

    def all(self) -> None:
        n_buckets = len(self.starts) - 1
        # as many buckets at once as will hardly place entries among themselves
        step = max(1, int((2 * n_buckets * n_buckets / max(1, len(self.text))) ** 0.5))
        for c in range(0, n_buckets, step) if self.forward else range((n_buckets - 1) // step * step, -1, -step):
            self.run(c, min(c + step, n_buckets))


def _induce(text: np.ndarray, small: np.ndarray, starts: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that follows from the LMS suffixes in the order ``lms``."""
    n = len(text)
    sa = np.full(n, -1, np.int32)
    symbols = text[lms]
    order = np.argsort(symbols.astype(np.uint16 if len(starts) <= 1 << 16 else np.int32), kind="stable")
    ranked = symbols[order]
    last = np.searchsorted(ranked, ranked, side="right")
    sa[starts[ranked + 1] - (last - np.arange(len(ranked)))] = lms[order]
    _Scan(text, sa, ~small, starts, starts[:-1].copy(), True).all()
    sa[small[sa] & (sa >= 0)] = -1  # the LMS suffixes are placed anew, but for the last one, which nothing induces
    sa[0] = n - 1
    _Scan(text, sa, small, starts, starts[1:] - 1, False).all()
    return sa


def _names(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The rank of each LMS substring, equal ones sharing theirs. ``order`` has the substrings (by number) sorted."""
    ends = np.append(lms[1:], lms[-1])
    a, b = order[:-1], order[1:]
    size = ends - lms
    same = size[a] == size[b]
    active = np.flatnonzero(same)
    for step in range(int(size.max(initial=0)) + 1):
        active = active[size[a[active]] >= step]
        if not len(active):
            break
        equal = text[lms[a[active]] + step] == text[lms[b[active]] + step]
        same[active[~equal]] = False
        active = active[equal]
    names = np.empty(len(lms), np.int32)
    names[order] = np.cumsum(np.r_[0, ~same])
    return names


def suffix_array(text: np.ndarray, n_symbols: int) -> np.ndarray:
    """The suffix array of ``text`` (integers below ``n_symbols``), whose last symbol is its smallest and is there once."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    small = _types(text)
    starts = np.r_[0, np.cumsum(np.bincount(text, minlength=n_symbols))]
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    number = np.full(n, -1, np.int32)
    number[lms] = np.arange(len(lms))
    sa = _induce(text, small, starts, lms)
    order = number[sa]
    order = order[order >= 0]
    if len(lms) > 1:
        names = _names(text, lms, order)
        top = int(names.max()) + 1
        order = order if top == len(lms) else suffix_array(names, top)
        sa = _induce(text, small, starts, lms[order])
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The permuted array of common prefixes: for each place, the symbols it shares with its predecessor in the suffix array, at most
    ``room`` of either. Only irreducible places, whose left neighbours differ, are compared; to their right the value falls by one a place."""
    n = len(text)
    before = np.empty(n, np.int32)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    inner = (place > 0) & (before > 0) & (room > 0)
    inner[1:] &= room[:-1] == room[1:] + 1  # the left neighbour belongs to the same context
    held = inner.copy()
    i = np.flatnonzero(inner)
    held[i] = (text[i - 1] == text[before[i] - 1]) & (before[i - 1] == before[i] - 1)
    fixed = np.flatnonzero(~held)
    value = np.zeros(n, np.int64)
    active = fixed[before[fixed] >= 0]
    other = before[active]
    limit = np.minimum(room[active], room[other])
    size = np.zeros(len(active), np.int64)
    live = np.flatnonzero(limit > 0)
    while len(live):
        equal = text[active[live] + size[live]] == text[other[live] + size[live]]
        live = live[equal]
        size[live] += 1
        live = live[size[live] < limit[live]]
    value[active] = size
    source = np.maximum.accumulate(np.where(held, 0, place))
    return np.maximum(value[source] - (place - source), 0)
