"""Suffix arrays of small texts in numpy: Larsson-Sadakane refinement and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np


def _words(text: np.ndarray, size: int = 8) -> np.ndarray:
    """The next eight bytes from each place as one big-endian number."""
    padded = np.concatenate((text, np.zeros(size, np.uint8)))
    out = np.zeros(len(text), dtype=np.uint64)
    for j in range(size):
        out = (out << np.uint64(8)) | padded[j : j + len(text)]
    return out


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` in the order of their suffixes' first ``depth`` bytes at least.

    Groups of equal prefixes are refined by the rank of what follows; the known
    length doubles each round, and places that are alone are left out of later
    rounds.
    """
    n = len(text)
    key = _words(text)
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    open_at = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    known = 8
    while known < depth and len(open_at):
        here = sa[open_at]
        key = (rank[here] << 32) | (rank[np.minimum(here + known, n)] + 1)
        order = np.argsort(key, kind="stable")
        key, here = key[order], here[order]
        sa[open_at] = here
        fresh = np.ones(len(key), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[here] = open_at[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))]
        open_at = open_at[~(fresh & np.append(fresh[1:], True))]
        known *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int, breaks: np.ndarray | None = None) -> np.ndarray:
    """Length of the prefix that each suffix in ``sa`` shares with the one before it.

    It is counted up to ``most`` at least from each of the ``breaks`` on, so
    right up to ``most`` less the distance to the last break.

    Kasai's rule: if a place's neighbour moves on by one with it, its common
    prefix is one shorter. Only places where that chain breaks are compared,
    eight bytes at a time.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    chained = np.zeros(n, dtype=bool)
    chained[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0)
    chained[1:] &= text[:-1] == text[before[:-1]]
    if breaks is not None:
        chained[breaks] = False
    head = np.flatnonzero(~chained)
    shared = np.zeros(len(head), dtype=np.int64)
    word = np.concatenate((_words(text), np.zeros(1, np.uint64)))
    live = np.flatnonzero(before[head] >= 0)
    while len(live):
        a, b = head[live] + shared[live], before[head[live]] + shared[live]
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
        differ = word[a] ^ word[b]
        full = differ == 0
        top = np.frexp(differ[~full].astype(np.float64))[1]  # exact enough only for the highest byte's check below
        equal = (64 - top) // 8
        wrong = (differ[~full] >> (np.uint64(64) - np.uint64(8) * (equal.astype(np.uint64) + np.uint64(1)))) == 0
        shared[live[~full]] += equal + wrong
        shared[live[full]] += 8
        live = live[full]
        live = live[shared[live] < most]
    at = np.arange(n)
    anchor = np.maximum.accumulate(np.where(chained, 0, at))
    of = np.cumsum(~chained) - 1
    return np.maximum(shared[of] - (at - anchor), 0)[sa]


def repeat_classes(text: np.ndarray, starts: np.ndarray, length: int, slices: np.ndarray, longest: int) -> np.ndarray:
    """A class number for each start; two are equal if the next ``length`` bytes are.

    ``slices`` are the places where slices of text begin, ``longest`` the size of the longest.
    """
    sa = suffix_array(text, length)
    wanted = np.zeros(len(text), dtype=bool)
    wanted[starts] = True
    lcp = common_prefixes(text, sa, length + longest, slices)
    group = np.cumsum(lcp < length)
    out = np.empty(len(text), dtype=np.int64)
    out[sa] = group
    return out[starts]
