"""Queries without SQL against brute force: rings, junctions, greedy picks."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from geoloom.operators import graph as G
from geoloom.operators import lines, sequence
from geoloom.plans import areas, catalog, shapes
from geoloom.sources import tables as T
from tests.test_whole import least_ids, pairs_one_by_one

Q = catalog.queries()


def regions_of(cls):
    near = [((r, c), q) for r, c in cls for q in ((r + 1, c), (r, c + 1)) if cls.get(q) == cls[r, c]]
    return least_ids(cls, near)


def holes(cells):
    """4-connected cells of a region; 8-connected parts of what is around, less the one outside."""
    rows, cols = [r for r, _ in cells], [c for _, c in cells]
    free = {(r, c) for r in range(min(rows) - 1, max(rows) + 2) for c in range(min(cols) - 1, max(cols) + 2)} - set(cells)
    of = least_ids(free, [((r, c), (r + y, c + x)) for r, c in free for y, x in ((0, 1), (1, 0), (1, 1), (1, -1)) if (r + y, c + x) in free])
    return len(set(of.values())) - 1


def test_rings(spark):
    rng = random.Random(8)
    cls = {(r, c): rng.randrange(2) for r in range(22) for c in range(22)} | {(5, 5): 3, (6, 6): 3, (40, 40): 1}
    cells = spark.createDataFrame([(r, c, k) for (r, c), k in cls.items()], "rr long, cc long, cls long")
    got = defaultdict(list)
    for r in shapes.region_rings(cells, 1000, "cls").collect():
        got[r.region].append((r.edges, r.area))
    parts = defaultdict(list)
    for p, i in regions_of(cls).items():
        parts[i[0] * 1000 + i[1]].append(p)
    assert set(got) == set(parts)
    for i, cells in parts.items():
        outer = sum(sum(1 for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)) if q not in cells) for r, c in cells)
        assert sum(a for _, a in got[i]) == len(cells) and sum(n for n, _ in got[i]) == outer
        assert sum(a > 0 for _, a in got[i]) == 1 and sum(a < 0 for _, a in got[i]) == holes(cells)


def test_region_layer_adds_up(spark, sf):
    rows = Q["snk06_region_layer"](spark, sf).collect()
    assert sum(r.area for r in rows) == 16 * shapes._cells(spark, sf).count() and all(r.outline >= 16 for r in rows)


def test_joined_through_junctions(spark, sf):
    cls = {r.line: r.k for r in sequence.segments(T.vertices(spark, sf)).select((F.col("line_id") * 100000 + F.col("pos")).alias("line"), F.substring("cls", 1, 1).alias("k")).collect()}
    arms = [(f"{node}:{cls[line]}", arm, line, bearing) for node, arm, line, bearing in areas._ends(spark, sf).select("node", "arm", "line", "bearing").collect()]
    line = {arm: at for _, arm, at, _ in arms}
    want = least_ids(set(line.values()), [(line[a], line[b]) for _, a, b in pairs_one_by_one(arms)])
    assert sorted(map(tuple, Q["grf04_joined_lines"](spark, sf).select("line", "stroke").collect())) == sorted(want.items())


def one_by_one(points, distance, blocked=()):
    kept = []
    for i, x, y, k in points:
        if all(math.hypot(x - a, y - b) > distance or k != c for _, a, b, c in kept) and all(math.hypot(x - a, y - b) > distance for a, b in blocked):
            kept.append((i, x, y, k))
    return sorted(p[0] for p in kept)


def test_thinned_points(spark, sf):
    v = [tuple(r) for r in T.vertices(spark, sf).select("line_id", "pos", "x", "y", "cls").collect()]
    boxes = [(r.x0, r.y0, r.x1, r.y1) for r in T.rects(spark, sf).where("kind = 'BUILDING'").collect()]
    free = [(i * 100000 + p, x, y, c) for i, p, x, y, c in sorted(v, key=lambda r: (r[1], r[0])) if not any(a <= x < e and b <= y < f for a, b, e, f in boxes)]
    assert sorted(r.id for r in Q["top02_thinned_points"](spark, sf).collect()) == one_by_one(free, 6.0)


def test_trees_beside_kept(spark, sf):
    v = [tuple(r) for r in T.vertices(spark, sf).select("line_id", "pos", "x", "y", "source").collect()]
    old = [(x, y) for _, p, x, y, s in v if s == "dtm" and p == 1]
    new = [(i * 100000 + p, x, y, 0) for i, p, x, y, s in sorted(v, key=lambda r: (r[1], r[0])) if s == "osm"]
    assert sorted(r.id for r in Q["top03_trees_beside_kept"](spark, sf).collect()) == one_by_one(new, 7.0, old)


def test_lines_by_priority(spark, sf):
    seg = sequence.segments(T.vertices(spark, sf)).where("len > 0")
    length, source, n, hits = defaultdict(float), {}, defaultdict(int), defaultdict(set)
    for r in seg.collect():
        length[r.line_id] += r.len
        source[r.line_id] = r.source
    st = sequence.stations(seg, 25.0)
    for r in st.collect():
        n[r.line_id] += 1
    for r in lines.covering_lines(st, seg.withColumnRenamed("line_id", "by_line"), 2.0, "by_line", 0.5).collect():
        hits[r.line_id, r.by_line].add(r.k)
    order = sorted(length, key=lambda i: ({"dtm": 0, "osm": 1}.get(source[i], 2), -round(length[i], 3), i))
    kept = []
    for i in order:
        if all(len(hits[i, j]) <= 0.08 * n[i] for j in kept):
            kept.append(i)
    assert sorted(r.id for r in Q["jon06_priority_lines"](spark, sf).collect()) == sorted(kept)


@pytest.mark.parametrize("tolerance", [20.0, 57.3, 120.0])
def test_simplified(spark, sf, tolerance):
    v = defaultdict(list)
    for r in sorted(T.vertices(spark, sf).select("line_id", "pos", "x", "y").collect()):
        v[r.line_id].append((r.pos, r.x, r.y))

    def off(p, a, b):
        dx, dy = b[1] - a[1], b[2] - a[2]
        t = max(0, min(1, ((p[1] - a[1]) * dx + (p[2] - a[2]) * dy) / (dx * dx + dy * dy or 1)))
        return math.hypot(p[1] - a[1] - t * dx, p[2] - a[2] - t * dy)

    def keep(pts):
        if len(pts) < 3:
            return {p[0] for p in pts}
        m = max(range(1, len(pts) - 1), key=lambda k: (off(pts[k], pts[0], pts[-1]), -k))
        return keep(pts[: m + 1]) | keep(pts[m:]) if off(pts[m], pts[0], pts[-1]) > tolerance else {pts[0][0], pts[-1][0]}

    want = {(i, p) for i, pts in v.items() for p in keep(pts)}
    assert {tuple(r) for r in lines.simplified(T.vertices(spark, sf), tolerance).collect()} == want


def test_taken_in_order(spark):
    rng = random.Random(2)
    pairs = {(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(90)) if b < a}
    kept = []
    for i in range(40):
        if not any((i, j) in pairs for j in kept):
            kept.append(i)
    got = G.taken_in_order(spark.range(40), spark.createDataFrame(sorted(pairs), "id long, j long"))
    assert sorted(r.id for r in got.collect()) == kept
