"""Invariants and small cases where SQL is no oracle."""

import random

from pyspark.sql import functions as F

from geoloom.functions import geometry as geo
from geoloom.operators import classify as C
from geoloom.operators import focal, graph
from geoloom.operators import spatial_join as J


def test_spacing_equals_one_by_one(spark):
    rng = random.Random(3)
    pts = [(i, rng.random() * 60, rng.random() * 60, rng.randrange(9)) for i in range(150)]
    got = {r.id for r in graph.spaced(spark.createDataFrame(pts, "id long, x double, y double, score long"), 6.0).collect()}
    kept = []
    for i, x, y, _ in sorted(pts, key=lambda p: (-p[3], p[0])):
        if all((x - a) ** 2 + (y - b) ** 2 > 36 for _, a, b in kept):
            kept.append((i, x, y))
    assert got == {k[0] for k in kept}


def test_cell_size_does_not_matter(spark, sf):
    from geoloom.sources import tables as T

    a, b = T.rects(spark, sf).where("lvl = 0"), T.rects(spark, sf).where("lvl = 1")
    rows = [sorted((r.a_fid, r.b_fid) for r in J.overlaps(a, b, size).collect()) for size in (7.0, 32.0, 500.0)]
    assert rows[0] == rows[1] == rows[2] != []


def test_tiles_do_not_matter(spark, monkeypatch):
    cells = spark.range(900).select(F.floor(F.col("id") / 30).alias("rr"), (F.col("id") % 30).alias("cc"), (F.col("id") * 7919 % 101).alias("v"))
    whole = sorted(map(tuple, focal.box(cells, 3, "max").select("rr", "cc", "s").collect()))
    monkeypatch.setattr(focal, "TILE", 8)
    assert sorted(map(tuple, focal.box(cells, 3, "max").select("rr", "cc", "s").collect())) == whole


def test_voltage_and_extent(spark):
    df = spark.createDataFrame([("110000;22 kV",), ("x",), (None,), ("1.5kv,300 v",)], "v string")
    assert [r[0] for r in df.select(C.max_voltage(F.col("v"))).collect()] == [110000, None, None, 1500]
    e = spark.createDataFrame([("1,2,3,4",), ("3,2,1,4",), ("1,2,3",), ("a,2,3,4",), ("1,2,3,95",)], "e string")
    assert [r[0] is not None for r in e.select(C.extent(F.col("e"))).collect()] == [True, False, False, False, False]


def test_utm(spark):
    x, y = geo.utm(F.lit(15.0), F.lit(50.0), 33)
    mx, my = geo.web_mercator(F.lit(15.0), F.lit(50.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y"), mx.alias("mx"), my.alias("my")).first()
    assert abs(r.x - 500000) < 1e-6 and abs(r.y - 5538630.703) < 0.01 and abs(r.mx - 1669792.362) < 0.01 and abs(r.my - 6446275.841) < 0.01


def test_components_of_a_path(spark):
    links = spark.range(1, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in graph.components(links).collect()} == {1}
    assert graph.labelled(spark.range(300, 303), spark.createDataFrame([], "a long, b long")).count() == 3


def test_propagation_stops_at_closed_ids(spark):
    ids = spark.range(1, 8)
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6)], "a long, b long")
    got = graph.propagated(ids, links, ids.where("id = 1"), ids.where("id in (2, 4, 6)"))
    assert {r.id for r in got.collect()} == {1, 2}


def test_requests_are_blocked_by_the_last_probe_before_them(spark):
    """A later failure doesn't block an earlier request, and an outage of another day still holds."""
    from geoloom.operators import ops

    at = lambda day, hour: f"2024-01-{day:02d} {hour:02d}:00:00"
    probes = spark.createDataFrame([(1, "a", at(1, 8), True), (2, "a", at(2, 8), False), (3, "a", at(6, 8), True), (4, "b", at(1, 9), False), (5, "b", at(1, 10), True), (6, "b", at(9, 1), False)], "n long, k string, ts string, ok boolean").withColumn("ts", F.to_timestamp("ts"))
    asked = spark.createDataFrame([(10, "a", at(1, 7)), (11, "a", at(1, 9)), (12, "a", at(5, 1)), (13, "a", at(6, 9)), (14, "b", at(1, 9)), (15, "b", at(8, 1)), (16, "c", at(1, 1)), (17, None, at(1, 1))], "n long, k string, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.n: r.blocked for r in ops.blocked(asked, probes, ["k"], "ts", "n").collect()}
    assert got == {10: False, 11: False, 12: True, 13: False, 14: True, 15: False, 16: False, 17: False}


def test_fair_order(spark):
    from geoloom.operators import ops

    rows = [(1, "x", 0, "2024-01-01 00:00:00", 30.0), (2, "x", 0, "2024-01-01 00:00:10", 5.0), (3, "x", 0, "2024-01-01 00:00:20", 5.0), (4, "y", 0, "2024-01-02 00:00:00", None), (5, "x", 0, "2024-01-02 00:00:05", 1.0), (6, "x", 0, "2024-01-02 00:00:05", 1.0)]
    jobs = spark.createDataFrame(rows, "job_id long, ip string, q int, created_at string, build_seconds double").withColumn("created_at", F.to_timestamp("created_at"))
    got = {r.job_id: (r.recent, r.active, r.place) for r in ops.fair_order(jobs, "ip", "q").collect()}
    assert got == {1: (0, 0, 1), 4: (0, 0, 2), 2: (1, 1, 3), 3: (2, 1, 5), 5: (2, 0, 4), 6: (3, 1, 6)}


def test_pools_ten_metres_off_make_a_playground_private(spark, tmp_path):
    from geoloom.plans import network
    from geoloom.sources import tables as T

    rects = spark.createDataFrame([(1, "MACHINERY", 0, 0.0, 0.0, 10.0, 10.0), (2, "AUTOMOBILE", 0, 18.0, 0.0, 20.0, 5.0), (3, "MACHINERY", 0, 100.0, 0.0, 110.0, 10.0), (4, "AUTOMOBILE", 0, 118.0, 18.0, 120.0, 20.0)], "fid long, kind string, lvl int, x0 double, y0 double, x1 double, y1 double")
    held, T.rects = T.rects, lambda *_: rects
    try:
        assert {r.fid: r.at_pool for r in network.jon37_private_playgrounds(spark, "").collect()} == {1: True, 3: False}
    finally:
        T.rects = held
