"""First hits come in rounds: lines and points lie as dense as they may, few of them meet a sample."""

import random

from geoloom.operators import spatial_join as J
from pyspark.sql import functions as F


def _points(spark, n=300):
    rng = random.Random(5)
    return spark.createDataFrame([(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(n)], "id long, x double, y double")


def test_reached_cells_hold_all_that_is_near(spark):
    rng = random.Random(2)
    rows = [tuple(rng.uniform(-50, 100) for _ in range(4)) for _ in range(40)] + [(8.0, 8.0, 8.0, 8.0), (0.0, 16.0, 96.0, 16.0), (24.0, 0.0, 24.0, 80.0)]
    seg = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "s long, ax double, ay double, bx double, by double")
    p = _points(spark).unionByName(spark.createDataFrame([(1000, 0.0, 16.0), (1001, 8.0, 8.0)], "id long, x double, y double"))
    d2 = J.segment_distance2(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")))
    for distance, size in ((0.3, 2.0), (5.0, 4.0), (3.0, 16.0)):
        want = sorted((r.id, r.s) for r in p.crossJoin(seg).where(d2 <= distance * distance).collect())
        assert sorted((r.id, r.s) for r in J.near_segments(p, seg, distance, size).collect()) == want


def test_dense_segments_meet_few_samples(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(0.0, y, 100.0, y + rng.uniform(-1, 1)) for y in (rng.uniform(0, 100) for _ in range(4000))] * 3
    seg = spark.createDataFrame(rows, "ax double, ay double, bx double, by double")
    p = _points(spark)
    d2 = J.segment_distance2(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")))
    sent, whole = [], J._reached
    monkeypatch.setattr(J, "_reached", lambda s, *more: sent.append(s.count()) or whole(s, *more))
    for distance, most in ((3.0, 700), (0.01, 4000)):
        sent.clear()
        want = sorted(r.id for r in p.crossJoin(seg.distinct()).where(d2 <= distance * distance).select("id").distinct().collect())
        assert sorted(r.id for r in J.beside_segments(p, seg, distance).collect()) == want
        assert sum(sent) <= most


def test_points_beside_points_come_once(spark):
    p = _points(spark)
    rng = random.Random(6)
    for n in (3, 500):
        others = spark.createDataFrame([(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(n)] * 4, "rx double, ry double")
        near = (F.col("x") - F.col("rx")) ** 2 + (F.col("y") - F.col("ry")) ** 2 <= 64
        want = sorted(r.id for r in p.crossJoin(others).where(near).select("id").distinct().collect())
        assert sorted(r.id for r in J.beside(p, others, 8.0).collect()) == want


def test_nearest_looks_no_farther_than_it_needs(spark, monkeypatch):
    rng = random.Random(9)
    p = _points(spark)
    asked, whole = [], J.within
    monkeypatch.setattr(J, "within", lambda l, r, reach, *more: asked.append((reach, l.count(), r.count())) or whole(l, r, reach, *more))
    for n in (4, 30000):
        asked.clear()
        others = spark.createDataFrame([(round(rng.uniform(0, 100), 1), round(rng.uniform(0, 100), 1)) for _ in range(n)] * 3, "rx double, ry double")
        d2 = (F.col("x") - F.col("rx")) ** 2 + (F.col("y") - F.col("ry")) ** 2
        want = {r.id: r.d for r in p.crossJoin(others).where(d2 <= 64).groupBy("id").agg(F.sqrt(F.min(d2)).alias("d")).collect()}
        got = {r.id: r.distance for r in J.nearest(p.unionByName(p), others, "id", 8.0).collect()}
        assert got == want and all(r == others.distinct().count() for _, _, r in asked)
    assert sum(k for reach, k, _ in asked if reach > 2) == 0
