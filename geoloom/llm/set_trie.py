"""Set-similarity join over a prefix tree of ordered sets, level by level in numpy."""

from __future__ import annotations

import numpy as np


class SetTrie:
    """Sorted number sequences with shared beginnings stored once.

    Nodes are compressed: each holds a stretch of tokens. Nodes stand in
    breadth-first order, so a probe moves from level to level over arrays and
    drops a subtree as soon as no set below can still reach the overlap asked for.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.order = np.array(sorted(range(len(sets)), key=lambda i: sets[i].tolist()), dtype=np.int64)
        self.sizes = np.asarray(sizes)
        ordered = [sets[i] for i in self.order]
        stretch: list[np.ndarray] = []
        children: list[tuple[int, int]] = []
        below: list[tuple[int, int]] = []  # the sets that pass through a node: a range in order
        ends: list[int] = []  # how many of those end at it
        depth_of: list[int] = []
        level = [(0, len(ordered), 0)] if len(ordered) else []
        shared = np.array([_shared(a, b) for a, b in zip(ordered, ordered[1:])] or [0], dtype=np.int64)
        self.levels: list[tuple[int, int]] = []
        while level:
            first, following = len(stretch), []
            for lo, hi, depth in level:
                to = int(shared[lo : hi - 1].min()) if hi - lo > 1 else len(ordered[lo])
                to = max(to, depth)
                stop = lo
                while stop < hi and len(ordered[stop]) == to:
                    stop += 1
                stretch.append(ordered[lo][depth:to])
                below.append((lo, hi))
                ends.append(stop - lo)
                depth_of.append(to)
                cuts = [stop, *(stop + 1 + np.flatnonzero(shared[stop : hi - 1] == to)).tolist(), hi] if stop < hi else [hi]
                at = len(following)
                following += [(a, b, to) for a, b in zip(cuts, cuts[1:])]
                children.append((at, len(following)))
            self.levels.append((first, len(stretch)))
            level = following
        self.tokens = np.concatenate(stretch) if stretch else np.zeros(0, np.int64)
        self.at = np.concatenate(([0], np.cumsum([len(x) for x in stretch]))).astype(np.int64)
        self.children = np.array(children, dtype=np.int64).reshape(-1, 2)
        self.below = np.array(below, dtype=np.int64).reshape(-1, 2)
        self.ends = np.array(ends, dtype=np.int64)
        self.depth = np.array(depth_of, dtype=np.int64)
        size, length = self.sizes[self.order], np.array([len(x) for x in ordered], dtype=np.int64)
        self.smallest = np.array([size[a:b].min() for a, b in below], dtype=np.int64)
        self.longest = np.array([length[a:b].max() for a, b in below], dtype=np.int64)

    def links(self, tokens: np.ndarray, size: int, flags: np.ndarray, percent: int, skip: np.ndarray | None = None) -> np.ndarray:
        """Numbers of the sets with ``100 * overlap >= percent * union``. ``flags`` is scratch, one place per token value; ``skip`` marks sets (in order) that need no answer."""
        flags[tokens] = 1
        found = []
        if len(self.ends):
            wanted = None if skip is None else np.concatenate(([0], np.cumsum(~skip)))
            hits = np.concatenate(([0], np.cumsum(flags[self.tokens])))
            node, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
            for first, _ in self.levels:
                at = first + node
                overlap = overlap + hits[self.at[at + 1]] - hits[self.at[at]]
                # the least overlap any set below needs, against what is there and what can still come
                need = -((-percent * (size + self.smallest[at])) // (100 + percent))
                left = np.minimum(self.longest[at] - self.depth[at], len(tokens) - overlap)
                live = overlap + left >= need
                if wanted is not None:
                    live &= wanted[self.below[at, 1]] > wanted[self.below[at, 0]]
                at, overlap = at[live], overlap[live]
                done = np.flatnonzero(self.ends[at])
                if len(done):
                    n = self.ends[at[done]]
                    place = np.repeat(self.below[at[done], 0], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    common, other = np.repeat(overlap[done], n), self.sizes[self.order[place]]
                    good = (100 + percent) * common >= percent * (size + other)
                    if skip is not None:
                        good &= ~skip[place]
                    found.append(place[good])
                n = self.children[at, 1] - self.children[at, 0]
                if not n.sum():
                    break
                node = np.repeat(self.children[at, 0], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                overlap = np.repeat(overlap, n)
        flags[tokens] = 0
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def spanning_links(sets: list[np.ndarray], sizes: np.ndarray, percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the sets into the same components as all links would.

    A probe passes over sets that already share its component. ``side`` (0 or
    1): only links between unequal sides are wanted.
    """
    trie = SetTrie(sets, sizes)
    group = np.arange(len(sets))  # component of each set, in the trie's order
    flags = np.zeros(int(max((x.max() for x in sets if len(x)), default=0)) + 1, dtype=np.int64)
    out = []
    for k, i in enumerate(trie.order):
        skip = group == group[k]
        if side is not None:
            skip = skip | (side[trie.order] == side[i])
        if skip.all():
            if side is None:
                break
            continue
        hit = trie.links(sets[i], int(sizes[i]), flags, percent, skip)
        for j in hit:
            if group[j] != group[k]:
                out.append((int(i), int(trie.order[j])))
                group[group == group[j]] = group[k]
    return out
