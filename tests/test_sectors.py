"""Lanes meet those of opposite sectors only, and miss none that turns by 150 degrees."""

import math

import __spark_entry__ as entry
from geoloom.operators import spatial_join as J
from pyspark.sql import functions as F


def test_opposite_sectors_hold_all_opposite_directions(spark):
    turns = [0.0, 1e-9, 15.0, 29.999999, 30.0, 30.0000001]
    rows = []
    for u in (k * 7.2 for k in range(50)):
        for v in (u + 180.0 + s * t for t in turns for s in (1, -1)):
            rows.append((*(f(math.radians(a)) for a in (u, v) for f in (math.cos, math.sin)),))
    rows += [(1.0, 0.0, -1.0, 0.0), (1.0, -0.0, -1.0, -0.0), (-1.0, 0.0, 1.0, -0.0), (0.0, 1.0, -0.0, -1.0)]
    d = spark.createDataFrame(rows, "ux double, uy double, vx double, vy double")
    missed = d.where(~F.array_contains(J.sectors_opposite(F.col("ux"), F.col("uy")), J.sector(F.col("vx"), F.col("vy"))))
    assert missed.where("ux * vx + uy * vy <= -0.8660254").collect() == [] and d.where("ux * vx + uy * vy <= -0.8660254").count() > 500


def test_pairs_are_equal_in_the_given_columns(spark):
    p = spark.createDataFrame([(i, i % 3, float(i % 7), float(i % 5)) for i in range(60)], "id long, k long, x double, y double")
    q = p.toDF("other", "k", "rx", "ry")
    want = J.within(p, q.withColumnRenamed("k", "l"), 2.0).where("k = l").select("id", "other", "d2")
    assert sorted(map(tuple, J.within(p, q, 2.0, on=("k",)).select("id", "other", "d2").collect())) == sorted(map(tuple, want.collect())) != []


def test_lanes_meet_by_class_and_sector(spark, sf):
    plan = entry.queries()["jon30_opposite_lanes"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    join = next(row for row in plan.splitlines() if "Join" in row)
    assert "cls" in join and "sector" in join
