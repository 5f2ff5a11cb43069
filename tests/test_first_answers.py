"""Stations, rays and points ask no more than their answer needs; the results stay those of brute force or SQL."""

import random

from geoloom.operators import lines, picks
from geoloom.operators import graph
from geoloom.operators import spatial_join as J
from geoloom.plans import checks, details
from geoloom.plans import lines as line_plans
from tests.oracle import assert_same
from geoloom.plans import catalog

SQL = catalog.oracle_sql()


def _forbidden(*a, **k):
    raise AssertionError("pairs are listed")


def test_station_covers_are_first_hits(spark, sf, duck, monkeypatch):
    monkeypatch.setattr(J, "points_in_boxes", _forbidden)
    assert_same(line_plans.jon41_row_support(spark, sf), duck.sql(SQL["jon41_row_support"]))
    assert_same(details.udf01_sampled_predicates(spark, sf), duck.sql(SQL["udf01_sampled_predicates"]))


def test_few_rays_are_cut(spark, monkeypatch):
    from geoloom.sources import tables as T

    rng = random.Random(11)
    v = [(k, p, rng.uniform(0, 200), rng.uniform(0, 200), "dtm") for k in range(40) for p in range(1, 5)] + [(99, p, 20.0 * p, 50.0, "dtm") for p in range(9)]
    r = [(i, "HOUSEHOLD", x, y, x + rng.choice([2.0, 5.0, 8.0, 40.0]), y + rng.choice([3.0, 7.0, 30.0])) for i in range(160) for x, y in [(rng.randrange(200) * 1.0, rng.randrange(200) * 1.0)]]
    # a strip of two areas that meet at the line, and one of just 8 m: touching edges and the limit itself
    r += [(900, "HOUSEHOLD", 30.0, 45.0, 70.0, 50.0), (901, "HOUSEHOLD", 30.0, 50.0, 70.0, 52.0), (902, "HOUSEHOLD", 90.0, 46.0, 120.0, 54.0)]
    vertices, rects = spark.createDataFrame(v, "line_id long, pos long, x double, y double, source string"), spark.createDataFrame(r, "fid long, kind string, x0 double, y0 double, x1 double, y1 double")
    monkeypatch.setattr(T, "vertices", lambda *_: vertices)
    monkeypatch.setattr(T, "rects", lambda *_: rects)
    cut, whole = [], lines.in_boxes
    monkeypatch.setattr(lines, "in_boxes", lambda s, *more: cut.append(s.count()) or whole(s, *more))
    got = sorted(map(tuple, checks.jon21_narrow_runs(spark, "").collect()))
    few = cut.pop()
    monkeypatch.setattr(checks, "_maybe_narrow", lambda st, *_: st)
    assert got == sorted(map(tuple, checks.jon21_narrow_runs(spark, "").collect())) and len(got) > 2
    assert few < 0.6 * cut.pop()


def test_lanes_are_copied_few_times(spark):
    rng = random.Random(3)
    p = [(i, rng.uniform(0, 90), rng.uniform(0, 90), rng.uniform(-1, 1), rng.uniform(-1, 1)) for i in range(200)]
    d = spark.createDataFrame(p, "id long, x double, y double, ux double, uy double")
    assert d.select(J.sectors_opposite(d.ux, d.uy).alias("s")).selectExpr("max(size(s)) n").first().n <= 2
    q = d.select(d.id.alias("o"), d.x.alias("rx"), d.y.alias("ry"))
    same = lambda **k: sorted((r.id, r.o) for r in J.within(d, q, 10.0, **k).collect())
    want = sorted((a[0], b[0]) for a in p for b in p if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 100)
    assert same() == same(size=20.0) == same(size=37.0) == want


def test_a_quota_of_one_needs_no_spacing(spark, monkeypatch):
    spaced, seen = graph.spaced, []
    monkeypatch.setattr(graph, "spaced", lambda p, *a, **k: seen.append(p.count()) or spaced(p, *a, **k))
    points = spark.createDataFrame([(1, 1, 0.0, 0.0, 2.0), (2, 1, 9.0, 4.0, 3.0), (3, 1, 8.0, 4.0, 3.0), (4, 2, 0.0, 0.0, 1.0), (5, 2, 1.0, 0.0, 1.0), (6, 2, 9.0, 0.0, 0.0), (7, 3, 0.0, 0.0, 0.0)], "id long, zone long, x double, y double, score double")
    zones = spark.createDataFrame([(1, 1), (2, 2), (3, 0)], "zone long, quota long")
    assert sorted(map(tuple, picks.zone_picks(points, zones, 5.0).collect())) == [(2, 1, 1), (4, 2, 1), (6, 2, 2)] and seen == [3]


def test_playgrounds_list_no_pairs_of_points(spark, monkeypatch):
    from tests.test_picks import brute, tables

    rng = random.Random(8)
    grounds = [(k, w * h, x, y, x + w, y + h) for k, (x, y, w, h) in enumerate([(0.0, 0.0, 20.0, 20.0), (15.0, 10.0, 40.0, 30.0)] * 3)]
    at = lambda: (rng.uniform(0, 60), rng.uniform(0, 45))
    mapped = [(i, *at(), rng.random() < 0.3, rng.random() < 0.3) for i in range(30)]
    detected = [(i, *at(), float(rng.randrange(9))) for i in range(150)]
    monkeypatch.setattr(J, "within", _forbidden)
    pairs = J.points_in_boxes
    monkeypatch.setattr(J, "points_in_boxes", lambda p, b, *more: pairs(p, b, *more) if b.count() == 2 else _forbidden())
    got = {tuple(r) for r in picks.playground_objects(*tables(spark, grounds, mapped, detected), 1000).select("id", "zone", "rank", "source").collect()}
    want = {r for r in brute(grounds, mapped, detected, 1000)}
    assert got == want and len(want) > 2
