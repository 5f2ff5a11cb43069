"""Arrangements against flood fill, Euler's formula and known small nets."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import enclosures as E
from geoloom.operators import planar as P


def segs(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "sid long, ax double, ay double, bx double, by double")


def box(x0, y0, x1, y1):
    return [(x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)]


def flooded(rows):
    """Areas of the bounded faces of axis-parallel segments, by flood fill over the cells between all coordinates."""
    xs, ys = sorted({v for r in rows for v in (r[0], r[2])}), sorted({v for r in rows for v in (r[1], r[3])})
    wall = set()
    for ax, ay, bx, by in rows:
        if ax == bx:
            wall |= {("v", xs.index(ax), j) for j in range(ys.index(min(ay, by)), ys.index(max(ay, by)))}
        else:
            wall |= {("h", i, ys.index(ay)) for i in range(xs.index(min(ax, bx)), xs.index(max(ax, bx)))}
    seen, areas = set(), []
    n, m = len(xs) - 1, len(ys) - 1
    for start in ((i, j) for i in range(n) for j in range(m)):
        if start in seen:
            continue
        seen.add(start)
        todo, area, out = [start], 0.0, False
        while todo:
            i, j = todo.pop()
            area += (xs[i + 1] - xs[i]) * (ys[j + 1] - ys[j])
            for ni, nj, w in ((i - 1, j, ("v", i, j)), (i + 1, j, ("v", i + 1, j)), (i, j - 1, ("h", i, j)), (i, j + 1, ("h", i, j + 1))):
                if w in wall:
                    continue
                if not (0 <= ni < n and 0 <= nj < m):
                    out = True
                elif (ni, nj) not in seen:
                    seen.add((ni, nj))
                    todo.append((ni, nj))
        if not out:
            areas.append(round(area, 4))
    return sorted(areas)


def test_boxes_by_flood_fill(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(40):
        x, y = rng.randrange(0, 60), rng.randrange(0, 60)
        rows += box(x, y, x + rng.randrange(2, 25), y + rng.randrange(2, 25))
    rows += box(100, 100, 140, 140) + box(110, 110, 130, 130) + box(112, 112, 115, 115) + box(120, 112, 125, 118) + [(100, 120, 105, 120), (130, 120, 135, 120), (118, 100, 118, 90)]
    found = P.faces(P.noded(segs(spark, rows), 0.5, 8.0), 8.0)
    got = found.faces.collect()
    assert sorted(round(r.area, 4) for r in got) == flooded(rows)
    nested = {round(r.area): (r.holes, round(r.perimeter)) for r in got}
    assert nested[1200] == (1, 160) and nested[400 - 9 - 30] == (2, 80)


@pytest.mark.parametrize("grid", [0.01, 1.0])
def test_slanted_lines_keep_to_eulers_formula(spark, grid):
    rng = random.Random(9)
    rows = [tuple(rng.uniform(0, 50) for _ in range(4)) for _ in range(35)] + [(0, 0, 50, 50), (10, 10, 30, 30), (0, 0, 0, 0)]
    net = P.noded(segs(spark, rows), grid, 7.0)
    edges = [(r.ux, r.uy, r.vx, r.vy) for r in net.edges.collect()]
    assert len(edges) == len(set(edges)) and all((a, b) < (c, d) for a, b, c, d in edges)
    # no two edges cross, and no node lies inside an edge
    cross = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    nodes = {(a, b) for a, b, *_ in edges} | {(c, d) for *_, c, d in edges}
    for i, e in enumerate(edges):
        p, q = e[:2], e[2:]
        assert not any(cross(p, q, r) == 0 and min(p, q) < r < max(p, q) for r in nodes)
        for f in edges[:i]:
            r, s = f[:2], f[2:]
            assert not (cross(p, q, r) * cross(p, q, s) < 0 and cross(r, s, p) * cross(r, s, q) < 0)
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for e in edges:
        parent[find(e[:2])] = find(e[2:])
    parts = len({find(n) for n in nodes})
    found = P.faces(net, 7.0)
    assert found.faces.count() == len(edges) - len(nodes) + parts
    inside = {r.face: (r.x, r.y) for r in P.inner_points(found).collect()}
    around = collections.defaultdict(list)
    for r in found.sides.where("face is not null").collect():
        around[r.face].append((r.ox * grid, r.oy * grid, r.dx * grid, r.dy * grid))
    for face, (x, y) in inside.items():
        hits = {g: sum((ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax) for ax, ay, bx, by in s) % 2 for g, s in around.items()}
        assert [g for g, h in hits.items() if h] == [face]
    rings = collections.defaultdict(list)
    for r in E.outer_rings(found, found.faces).collect():
        rings[r.face].append((r.place, r.x, r.y))
    want = {r.face: r.perimeter for r in found.faces.collect()}
    for face, ring in rings.items():
        at = [(x, y) for _, x, y in sorted(ring)]
        assert [p for p, *_ in sorted(ring)] == list(range(len(ring)))
        assert math.isclose(sum(math.dist(p, q) for p, q in zip(at, at[1:] + at[:1])), want[face], rel_tol=1e-9)


def test_ring_around_rings(spark):
    """Two loops side by side in a third: one hangs under the other's outside."""
    rows = box(0, 0, 20, 20) + box(2, 2, 6, 6) + box(2, 8, 6, 12) + box(10, 30, 12, 33) + box(2, 14, 6, 18)
    got = {round(r.area, 3): r.holes for r in P.faces(P.noded(segs(spark, rows), 0.1, 2.0), 2.0).faces.collect()}
    assert got == {400 - 48: 3, 16: 0, 6: 0}


def test_no_segments(spark):
    found = P.faces(P.noded(segs(spark, [(0, 0, 0, 0)]).where("sid < 0")))
    assert found.faces.count() == 0 and P.inner_points(found).count() == 0


def test_owners_of_faces(spark):
    rng = random.Random(2)
    boxes = [(i, rng.randrange(3), *(x := (rng.randrange(0, 30), rng.randrange(0, 30))), x[0] + rng.randrange(1, 12), x[1] + rng.randrange(1, 12)) for i in range(30)]
    ring = "array(named_struct('x', x0, 'y', y0), named_struct('x', x1, 'y', y0), named_struct('x', x1, 'y', y1), named_struct('x', x0, 'y', y1))"
    areas = spark.createDataFrame([(i, k, *map(float, b)) for i, k, *b in boxes], "fid long, rank int, x0 double, y0 double, x1 double, y1 double").select("fid", "rank", F.expr(ring).alias("ring"))
    found, owner = P.coverage(areas, 0.5, 4.0)
    got = {r.fid: round(r.a, 3) for r in owner.join(found.faces, "face").groupBy("fid").agg(F.sum("area").alias("a")).collect()}
    want = collections.Counter()
    for i in range(50):
        for j in range(50):
            over = [(k, f) for f, k, x0, y0, x1, y1 in boxes if x0 <= i < x1 and y0 <= j < y1]
            if over:
                want[min(over)[1]] += 1
    assert got == dict(want)


def fences(spark, lines):
    rows = [(i, k, *map(float, (*a, *b))) for i, line in enumerate(lines) for k, (a, b) in enumerate(zip(line, line[1:]))]
    return spark.createDataFrame(rows, "line_id long, pos int, ax double, ay double, bx double, by double")


def test_enclosures(spark):
    lines = [
        [(0, 0), (10, 0), (10, 10), (0, 10), (0, 3)],  # a gap of 3 m in its own line: no bridge to itself
        [(20, 0), (30, 0), (30, 10), (20, 10), (20, 0)],  # closed
        [(40, 0), (50, 0), (50, 10)], [(50, 14), (40, 14), (40, 2)],  # two lines, gaps of 4 and 2 m
        [(60, 0), (60, 30)], [(61.5, 0), (61.5, 30)], [(60, 0), (61.5, 0)], [(60, 30), (61.5, 30)],  # a strip 1.5 m wide
        [(70, 0), (73, 0), (73, 3), (70, 3), (70, 0)],  # 9 square metres
        [(80, 0), (92, 0)], [(92, 4), (80, 4)],  # both ends 4 m apart: a quarter of the boundary is bridged
        [(100, 0), (105, 0)], [(105, 4), (100, 4)],  # 8 of 18 m are bridges
    ]
    private = spark.createDataFrame([(1, 20.0, 0.0, 26.0, 10.0), (2, 59.0, 5.0, 70.0, 26.0)], "fid long, x0 double, y0 double, x1 double, y1 double")
    found, kept = E.enclosed(fences(spark, lines), private)
    got = sorted((round(r.area, 2), round(r.bridge_share, 3), round(r.private_share, 3), r.compact) for r in kept.collect())
    assert got == [(45.0, 0.0, 0.7, False), (48.0, 0.25, 0.0, True), (100.0, 0.0, 0.6, True), (140.0, round(6 / 48, 3), 0.0, True)]


def test_area_in_common_with_boxes(spark):
    rng = random.Random(3)
    star = [(10 + r * math.cos(a), 10 + r * math.sin(a)) for a, r in ((k * math.pi / 6, 9 if k % 2 else 4) for k in range(12))]
    found = P.faces(P.noded(segs(spark, [(*a, *b) for a, b in zip(star, star[1:] + star[:1])] + box(9, 9, 11, 11)), 0.001, 5.0), 5.0)
    boxes = [(i, x, y, x + rng.uniform(1, 9), y + rng.uniform(1, 9)) for i, (x, y) in enumerate((rng.uniform(0, 18), rng.uniform(0, 18)) for _ in range(6))]
    got = E.covered_area(found, spark.createDataFrame(boxes, "fid long, x0 double, y0 double, x1 double, y1 double"), found.faces, 5.0)
    total = sum(r.covered for r in got.collect())
    n, hits = 400, 0
    for i in range(n):
        for j in range(n):
            x, y = (i + 0.5) * 20 / n, (j + 0.5) * 20 / n
            if sum((ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax) for (ax, ay), (bx, by) in zip(star, star[1:] + star[:1])) % 2:
                hits += sum(x0 <= x < x1 and y0 <= y < y1 for _, x0, y0, x1, y1 in boxes)
    assert abs(total - hits * (20 / n) ** 2) < 0.02 * total


def test_pieces_of_a_coverage(spark, sf):
    """The query on whole tables, against flood fill over the cells between all coordinates."""
    from geoloom.plans import faces as Q
    from geoloom.sources import tables as T

    rects = [(r.fid, Q.RANKS[r.kind], *(round(10 * v) for v in (r.x0, r.y0, r.x1, r.y1))) for r in T.rects(spark, sf).collect()]
    xs, ys = sorted({v for r in rects for v in (r[2], r[4])}), sorted({v for r in rects for v in (r[3], r[5])})
    nx, ny = {v: i for i, v in enumerate(xs)}, {v: i for i, v in enumerate(ys)}
    owner = {}
    for fid, rank, x0, y0, x1, y1 in sorted(rects, key=lambda r: r[1::-1]):
        for i in range(nx[x0], nx[x1]):
            for j in range(ny[y0], ny[y1]):
                owner.setdefault((i, j), fid)
    want, seen = collections.Counter(), set()
    for start, fid in owner.items():
        if start in seen:
            continue
        seen.add(start)
        todo, area, rim = [start], 0, 0
        while todo:
            i, j = todo.pop()
            w, h = xs[i + 1] - xs[i], ys[j + 1] - ys[j]
            area += w * h
            for n, edge in (((i - 1, j), h), ((i + 1, j), h), ((i, j - 1), w), ((i, j + 1), w)):
                if owner.get(n) != fid:
                    rim += edge
                elif n not in seen:
                    seen.add(n)
                    todo.append(n)
        want[fid, round(area / 100, 2), round(rim / 10, 2)] += 1
    got = collections.Counter((r.fid, r.area, r.rim) for r in Q.set14_pieces(spark, sf).collect())
    assert got == want
