"""Existence joins end at the first hit; shapes are there once."""

import random

from geoloom.operators import lines
from geoloom.operators import spatial_join as J
from pyspark.sql import functions as F


def _points(spark, n=300):
    rng = random.Random(3)
    return spark.createDataFrame([(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(n)], "id long, x double, y double")


def test_inside_gives_a_point_once_under_many_copies(spark):
    boxes = spark.createDataFrame([(10.0, 10.0, 30.0, 50.0), (20.0, 5.0, 60.0, 40.0)] * 50, "x0 double, y0 double, x1 double, y1 double")
    p = _points(spark)
    want = {r.id for r in p.collect() if 10 <= r.x < 30 and 10 <= r.y < 50 or 20 <= r.x < 60 and 5 <= r.y < 40}
    assert sorted(r.id for r in J.inside(p, boxes).collect()) == sorted(want)
    assert {r.id for r in J.inside(p, boxes, how="left_anti").collect()} == set(range(300)) - want
    assert J.inside(p, boxes, also=F.col("x0") == 99.0).count() == 0


def test_away_from_points_and_segments(spark):
    p = _points(spark)
    others = [(20.0, 20.0), (20.0, 20.0), (77.5, 31.25)]
    got = J.away_from(p, spark.createDataFrame(others, "rx double, ry double"), 15.0)
    assert {r.id for r in got.collect()} == {r.id for r in p.collect() if all((r.x - a) ** 2 + (r.y - b) ** 2 > 225 for a, b in others)}
    seg = spark.createDataFrame([(0.0, 0.0, 100.0, 50.0), (90.0, 90.0, 90.0, 90.0)], "ax double, ay double, bx double, by double")
    d2 = J.segment_distance2(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")))
    near = {r.id for r in p.crossJoin(seg).where(d2 <= 25).collect()}
    assert {r.id for r in J.away_from_segments(p, seg, 5.0).collect()} == set(range(300)) - near


def test_spans_read_a_shape_once(spark, monkeypatch):
    seg = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 0.0, 0.0, 100.0)], "line_id long, pos int, ax double, ay double, bx double, by double, m0 double, len double")
    boxes = spark.createDataFrame([(i, 10.0, -1.0, 20.0, 1.0) for i in range(40)], "fid long, x0 double, y0 double, x1 double, y1 double")
    asked, whole = [], lines.in_boxes
    monkeypatch.setattr(lines, "in_boxes", lambda s, b, *more: asked.append(b.count()) or whole(s, b, *more))
    assert [(r.s0, r.s1) for r in lines.inside_spans(seg, boxes).collect()] == [(10.0, 20.0)] and asked == [1]


def test_beside_any_asks_all_segments_for_what_the_first_pass_leaves(spark):
    rng = random.Random(8)
    p = _points(spark)
    rows = [tuple(rng.uniform(0, 100) for _ in range(4)) for _ in range(60)] + [(50.0, 50.0, 50.0, 50.0)]
    seg = spark.createDataFrame(rows, "ax double, ay double, bx double, by double")
    for n in (5, 61):  # few lines, of which the first pass may have none, and dense ones
        some = spark.createDataFrame(rows[:n], seg.schema)
        d2 = J.segment_distance2(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")))
        want = sorted(r.id for r in p.crossJoin(some).where(d2 <= 4).select("id").distinct().collect())
        assert sorted(r.id for r in J.beside_any(p, some, 2.0).collect()) == want
