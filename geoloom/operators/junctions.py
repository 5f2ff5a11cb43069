"""Arms of a node that continue each other.

An arm's best partner lies next to its opposite bearing, so no pairs are listed:
nodes are dealt and their arms sorted by Spark, and a task walks through its rows
batch by batch and holds the arms of one node. Arms of one bearing are one group,
which is looked at as a whole; groups that are used up are passed over.
"""

from __future__ import annotations

import bisect
import heapq
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.spatial_join import dealt

#: What this module defines goes to the workers with the job, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST = 45.0


def turned(p: float, q: float) -> float:
    """By how many degrees a way turns from one arm into the other."""
    d = abs(p - q) % 360.0
    return abs(180.0 - min(d, 360.0 - d))


class Around:
    """The bearings of a node in order, once and once more a full circle on: from each, those next to its opposite, nearest first, on either side."""

    def __init__(self, bearings: list[float]):
        self.n, self.bearings = len(bearings), bearings
        self.at = bearings + [b + 360.0 for b in bearings]
        self.next = [list(range(2 * self.n + 2)) for _ in range(2)]  # places shifted by one; 0 and the last are the ends

    def _find(self, side: int, i: int) -> int:
        to = self.next[side]
        root = i
        while to[root] != root:
            root = to[root]
        while to[i] != root:
            to[i], i = root, to[i]
        return root

    def leave(self, g: int) -> None:
        for i in (g + 1, g + 1 + self.n):
            self.next[0][i], self.next[1][i] = i - 1, i + 1

    def opposite(self, g: int, side: int) -> Iterator[tuple[float, int]]:
        """(turn, group) to one side, 45 degrees at most."""
        i = bisect.bisect_left(self.at, self.bearings[g] + 180.0) + side
        while 0 < (i := self._find(side, i)) <= 2 * self.n:
            other = (i - 1) % self.n
            turn = turned(self.bearings[g], self.bearings[other])
            if turn > MOST:
                return
            yield turn, other
            i += 2 * side - 1


def _grouped(arms: list[tuple]) -> tuple[list[float], list[list[tuple]]]:
    """The bearings, and the (arm, line) of each, the least last; arms (bearing, arm, line) come sorted."""
    bearings, groups = [], []
    for bearing, arm, line in arms:
        if not bearings or bearings[-1] != bearing:
            bearings.append(bearing)
            groups.append([])
        groups[-1].append((arm, line))
    for g in groups:
        g.reverse()
    return bearings, groups


def best_pairs(arms: list[tuple], _: int) -> Iterator[tuple]:
    """(a, b, turn) that are best for both by (turn, a, b). Of a bearing's arms the least comes first with all others, so it is the only one that can."""
    bearings, groups = _grouped(arms)
    around, best = Around(bearings), []
    for g in range(len(groups)):
        found = None
        for side in (0, 1):
            for turn, h in around.opposite(g, side):
                if found and turn > found[0]:
                    break
                found = min(found or (turn, groups[h][-1][0], h), (turn, groups[h][-1][0], h))
        best.append(found)
    for g, found in enumerate(best):
        if found and best[found[2]][2] == g and groups[g][-1][0] < found[1]:
            yield groups[g][-1][0], found[1], found[0]


def _least_pair(one: list[tuple], two: list[tuple]) -> tuple | None:
    """The first pair (a, b) of arms of two groups that belong to different lines."""
    (p, line), (q, other) = one[-1], two[-1]
    if line != other:
        return (p, q) if p < q else (q, p)
    found = []
    for head, rest in ((p, two), (q, one)):
        arm = next((a for a, own in reversed(rest) if own != line), None)
        if arm is not None:
            found.append((head, arm) if head < arm else (arm, head))
    return min(found, default=None)


def picked_pairs(arms: list[tuple], n: int) -> Iterator[tuple]:
    """(a, b, turn) picked one by one by (turn, a, b), each arm once, never two of one line; the arms of a node with two pair at any angle."""
    if n == 2:
        if len(arms) == 2 and arms[0][2] != arms[1][2]:
            yield *sorted((arms[0][1], arms[1][1])), turned(arms[0][0], arms[1][0])
        return
    bearings, groups = _grouped(arms)
    around, of = Around(bearings), {arm: (g, line) for g, rows in enumerate(groups) for arm, line in rows}

    def first(g: int) -> tuple | None:
        """The first pair left to a group."""
        found = None
        for side in (0, 1):
            for turn, h in around.opposite(g, side):
                if found and turn > found[0]:
                    break
                pair = _least_pair(groups[g], groups[h])
                if pair and (found is None or (turn, *pair) < found):
                    found = (turn, *pair)
        return found

    queue = [(*found, g) for g in range(len(groups)) if (found := first(g))]
    heapq.heapify(queue)
    while queue:
        turn, a, b, g = heapq.heappop(queue)
        if a in of and b in of:
            yield a, b, turn
            for arm in (a, b):
                at, line = of.pop(arm)
                k = len(groups[at]) - 1
                while groups[at][k][0] != arm:
                    k -= 1
                groups[at].pop(k)
                if not groups[at]:
                    around.leave(at)
        if groups[g] and (found := first(g)):
            heapq.heappush(queue, (*found, g))


def by_node(arms: DataFrame, pairs: Callable[[list[tuple], int], Iterator[tuple]]) -> DataFrame:
    """(node, a, b, turn): the pairs of each node's arms (node, arm, line, bearing; null for none)."""
    kinds = {c: arms.schema[c].dataType.simpleString() for c in ("node", "arm")}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, n, held, out, typ = None, 0, [], [], None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), typ)], ("node", "a", "b", "turn"))

        for batch in batches:
            of, arm = (batch.schema.field(c).type for c in ("node", "arm"))
            typ = (of, arm, arm, pa.float64())
            for i, a, line, bearing in zip(*(batch.column(c).to_pylist() for c in ("node", "arm", "line", "bearing"))):
                if i != node:
                    out += ((node, *p) for p in pairs(held, n))
                    node, n, held = i, 0, []
                    if len(out) >= 10000:
                        yield batch_of(out)
                        out = []
                n += 1
                if bearing is not None:
                    held.append((bearing, a, line))
        out += ((node, *p) for p in pairs(held, n))
        if out:
            yield batch_of(out)

    rows = arms.where("node is not null").select("node", "arm", "line", F.col("bearing").cast("double").alias("bearing"))
    ordered = dealt(rows, "node").sortWithinPartitions("node", "bearing", "arm")
    return ordered.mapInArrow(walk, f"node {kinds['node']}, a {kinds['arm']}, b {kinds['arm']}, turn double")
