"""Whole-table queries against brute force."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from geoloom.operators import graph as G
from geoloom.operators import grid, sequence
from geoloom.operators import terrain as R
from geoloom.plans import areas, catalog
from geoloom.sources import tables as T

Q = catalog.queries()


def least_ids(ids, links):
    """Each id's component by its least id."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for i in sorted(ids):
        todo = [i] if i not in out else []
        while todo:
            j = todo.pop()
            if j not in out:
                out[j] = i
                todo += near[j]
    return out


@pytest.fixture(scope="module")
def vertices(spark, sf):
    return sorted((r.line_id, r.pos, r.x, r.y, r.source) for r in T.vertices(spark, sf).collect())


@pytest.fixture(scope="module")
def segments(vertices):
    return [(v, w) for v, w in zip(vertices, vertices[1:]) if v[0] == w[0]]


@pytest.fixture(scope="module")
def orders(spark, sf):
    return [tuple(r) for r in T.table(spark, sf, "orders").select("o_orderkey", "o_custkey").collect()]


def test_crossings_of_all_lines(spark, sf, segments):
    side = lambda p, q, r: (q[2] - p[2]) * (r[3] - p[3]) - (q[3] - p[3]) * (r[2] - p[2])
    n, lines = defaultdict(int), defaultdict(set)
    for a, b in (s for s in segments if s[0][4] == "osm"):
        for c, d in (s for s in segments if s[0][4] == "topo"):
            if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                n[a[0]] += 1
                lines[a[0]].add(c[0])
    got = Q["jon27_line_crossings"](spark, sf).collect()
    assert {(r.a_id, r.crossings, r.lines) for r in got} == {(k, n[k], len(lines[k])) for k in n} and len(got) == len(n)


def test_chains_of_all_orders(spark, sf, orders):
    ends = defaultdict(list)
    for o, c in orders:
        ends[c].append(o)
        ends[o % 3001 + 100000].append(o)
    want = least_ids([o for o, _ in orders], [e for e in ends.values() if len(e) == 2 and e[0] != e[1]])
    assert sorted(map(tuple, Q["grf03_chains"](spark, sf).select("id", "chain").collect())) == sorted(want.items())


def test_reach_over_all_orders(spark, sf, orders):
    ids = {r[0] for r in T.table(spark, sf, "customer").select("c_custkey").collect()}
    links = [(c, o % 1499 + 1) for o, c in orders]
    of = least_ids(ids | {i for e in links for i in e}, links)
    live = {of[i] for i in ids if i % 500 == 7}
    assert sorted(r.id for r in Q["grf05_reachable"](spark, sf).collect()) == sorted(i for i in ids if of[i] in live)


def test_customers_above_1500_link(spark, tmp_path):
    spark.createDataFrame([(7, "BUILDING", 0), (2000, "BUILDING", 0), (2001, "BUILDING", 0)], "c_custkey long, c_mktsegment string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1499 * 9 + 6, 2000)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    assert sorted(r.id for r in Q["grf05_reachable"](spark, str(tmp_path)).collect()) == [7, 2000]


def test_spacing_of_all_vertices(spark, sf, vertices):
    kept = []
    for i, x, y in ((v[0] * 100000 + v[1], v[2], v[3]) for v in sorted(vertices, key=lambda v: (-(v[0] % 97), v[0] * 100000 + v[1]))):
        if all((x - a) ** 2 + (y - b) ** 2 > 144 for _, a, b in kept):
            kept.append((i, x, y))
    assert sorted(r.id for r in Q["top01_spaced"](spark, sf).collect()) == sorted(k[0] for k in kept)


def test_snapping_of_both_ends(spark, sf, vertices):
    last = {v[0]: v for v in vertices}
    ends = {v[0] * 2: v[2:4] for v in vertices if v[1] == 1} | {v[0] * 2 + 1: v[2:4] for v in last.values() if v[1] > 1}
    links = [(a, b) for a in ends for b in ends if a < b and (ends[a][0] - ends[b][0]) ** 2 + (ends[a][1] - ends[b][1]) ** 2 <= 16]
    node = least_ids(ends, links)
    assert sorted((r.id, r.node) for r in Q["grf01_snapped"](spark, sf).collect()) == sorted(node.items())


def test_beside_road_of_whole_lines(spark, sf, segments):
    def off(x, y, a, b):
        dx, dy = b[2] - a[2], b[3] - a[3]
        t = max(0, min(1, ((x - a[2]) * dx + (y - a[3]) * dy) / (dx * dx + dy * dy or 1)))
        return math.hypot(x - a[2] - t * dx, y - a[3] - t * dy)

    roads, n, hits = [s for s in segments if s[0][4] == "dtm"], defaultdict(int), defaultdict(int)
    for r in sequence.stations(sequence.segments(T.vertices(spark, sf)).where("source = 'topo'"), 25.0).collect():
        n[r.line_id] += 1
        hits[r.line_id] += any(off(r.x, r.y, a, b) <= 8 for a, b in roads)
    got = {r.line_id: r.beside for r in Q["jon16_beside_road"](spark, sf).collect()}
    assert got == {k: hits[k] >= 0.7 * n[k] for k in n}


def brute_zones(cells, rows, cols, least):
    disk = lambda k: [(y, x) for y in range(-k, k + 1) for x in range(-k, k + 1) if y * y + x * x <= k * k]
    grown = {(r + y, c + x) for r, c in cells for y, x in disk(5)}
    zone = {(r, c) for r, c in grown if 0 <= r < rows and 0 <= c < cols and all((r + y, c + x) in grown for y, x in disk(3))}
    of = least_ids(zone, [((r, c), q) for r, c in zone for q in ((r + 1, c), (r, c + 1)) if q in zone])
    size = defaultdict(int)
    for i in of.values():
        size[i] += 1
    return {q for q in zone if size[of[q]] * 16 >= least}


def test_settlement_of_all_buildings(spark, sf):
    m = {(r, c) for q in T.rects(spark, sf).where("kind = 'BUILDING'").collect() for r in range(110) for c in range(110) if q.x0 <= c * 4 + 2 < q.x1 and q.y0 <= r * 4 + 2 < q.y1}
    assert {tuple(r) for r in Q["ras21_settlement"](spark, sf).collect()} == brute_zones(m, 110, 110, 3000)


def test_lone_buildings_are_no_settlement(spark):
    cells = [(10, 10), (0, 30), *((r, c) for r in range(30, 45) for c in range(25, 45, 3))]
    got = {tuple(r) for r in R.settlement_zones(spark.createDataFrame(cells, "rr long, cc long"), 60, 60, 4.0).collect()}
    assert got == brute_zones(set(cells), 60, 60, 3000) and got and (10, 10) not in got


def merged_by_hand(cls, least, passes):
    for _ in range(passes):
        near = {(r, c): [q for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)) if q in cls] for r, c in cls}
        of = least_ids(cls, [(p, q) for p in cls for q in near[p] if cls[p] == cls[q]])
        parts = defaultdict(list)
        for p, i in of.items():
            parts[i].append(p)
        new = dict(cls)
        for i, cells in parts.items():
            votes = defaultdict(int)
            for p in cells:
                for q in near[p]:
                    votes[cls[q]] += of[q] != i
            votes = {k: n for k, n in votes.items() if n}
            if len(cells) < least and votes:
                new |= dict.fromkeys(cells, min(votes, key=lambda k: (-votes[k], k)))
        cls = new
    return cls


@pytest.mark.parametrize("passes", [1, 4])
def test_small_regions_by_hand(spark, passes):
    rng = random.Random(5)
    cls = {(r, c): rng.randrange(4) for r in range(14) for c in range(14)}
    cells = spark.createDataFrame([(r, c, k) for (r, c), k in cls.items()], "rr long, cc long, cls long")
    assert {(r.rr, r.cc): r.cls for r in R.small_regions_merged(cells, 100, "cls", 3, passes).collect()} == merged_by_hand(cls, 3, passes)
    assert merged_by_hand(cls, 3, 1) != merged_by_hand(cls, 3, 4)


def test_registered_regions_take_four_passes(spark, sf):
    c = grid.surfaces(T.points(spark, sf), T.CELL_M)
    n = defaultdict(int)
    for k in merged_by_hand({(r.rr, r.cc): r.cls for r in c.withColumn("cls", grid.ladder(F.col("chm"), (8.0, 20.0))).collect()}, 3, 4).values():
        n[k] += 1
    assert {r.cls: r.cells for r in Q["ras22_merged_regions"](spark, sf).collect()} == n
    n = defaultdict(int)
    h = grid.canopy_height(F.col("dsm"), F.col("dem"))
    for k in merged_by_hand({(r.rr, r.cc): r.cls for r in c.withColumn("cls", grid.ladder(h, (4.0, 12.0, 20.0))).collect()}, 3, 4).values():
        n[k] += 1
    assert {r.cls: r.share for r in Q["pip03_vegetation"](spark, sf).collect()} == pytest.approx({k: v / sum(n.values()) for k, v in n.items()}, abs=2e-6)


def pairs_one_by_one(arms):
    nodes, out = defaultdict(list), set()
    for node, arm, line, bearing in arms:
        nodes[node].append((arm, line, bearing))
    for node, at in nodes.items():
        pairs, used = [], set()
        for a, la, p in at:
            for b, lb, q in at:
                if a < b and la != lb and p is not None and q is not None:
                    t = abs(180 - min(abs(p - q), 360 - abs(p - q)))
                    pairs += [(t, a, b)] if t <= 45 or len(at) == 2 else []
        for _, a, b in sorted(pairs):
            if not {a, b} & used:
                used |= {a, b}
                out.add((node, a, b))
    return out


def test_strokes_take_every_arm(spark, sf):
    arms = [tuple(r) for r in areas._ends(spark, sf).select("node", "arm", "line", "bearing").collect()]
    line = {arm: at for _, arm, at, _ in arms}
    want = least_ids(set(line.values()), [(line[a], line[b]) for _, a, b in pairs_one_by_one(arms)])
    assert sorted(map(tuple, Q["grf08_strokes"](spark, sf).select("line", "stroke").collect())) == sorted(want.items())


def test_pairs_go_on_after_the_first_round(spark):
    arms = [(1, 1, 1, 0.0), (1, 2, 2, 180.0), (1, 3, 3, 10.0), (1, 4, 4, 215.0), (2, 5, 5, 0.0), (2, 6, 6, 90.0), (3, 7, 7, 0.0), (3, 8, 7, 180.0), (4, 9, 9, 5.0), (4, 10, 10, None)]
    got = {(r.node, r.a, r.b) for r in G.paired(spark.createDataFrame(arms, "node long, arm long, line long, bearing double")).collect()}
    assert got == pairs_one_by_one(arms) == {(1, 1, 2), (1, 3, 4), (2, 5, 6)}


@pytest.mark.parametrize("cell", [7.0, 32.0, 500.0])
def test_crossings_do_not_depend_on_cells(spark, sf, cell):
    from geoloom.operators import spatial_join as J

    seg = sequence.segments(T.vertices(spark, sf))
    a = seg.where("source = 'osm' and line_id < 40").select(F.col("line_id").alias("a_id"), F.col("pos").alias("a_seg"), "ax", "ay", "bx", "by")
    b = seg.where("source = 'topo' and line_id < 40").select(F.col("line_id").alias("b_id"), F.col("pos").alias("b_seg"), F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("bx").alias("dx"), F.col("by").alias("dy"))
    keys = ["a_id", "a_seg", "b_id", "b_seg"]
    assert sorted(map(tuple, J.crossings(a, b, cell).select(*keys).collect())) == sorted(map(tuple, J.crossings(a, b, 100.0).select(*keys).collect())) != []
