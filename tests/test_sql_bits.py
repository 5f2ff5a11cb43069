"""Cases at sf0.1 in which the last bit, or a row without a successor, decides."""

import datetime

from geoloom.operators import lines, ops
from geoloom.operators import spatial_join as J
from pyspark.sql import functions as F


def test_an_open_outage_is_seen_last_at_its_last_failure(spark):
    at = [datetime.datetime(2024, 1, 1, 0, m) for m in range(6)]
    ok = [True, False, False, True, False, False]
    probes = spark.createDataFrame([(i, t, 1, o) for i, (t, o) in enumerate(zip(at, ok))], "event_id long, ts timestamp, source_key int, ok boolean")
    got = {r.outage: (r.up_at, r.last_seen) for r in ops.outage_spans(probes).collect()}
    assert got == {1: (at[3], at[3]), 2: (None, at[5])}


def test_equally_far_vertices_split_at_the_first(spark):
    xy = [(123.2, 11.6), (150.1, 218.3), (168.7, 318.1), (179.7, 291.1), (19.8, 265.4), (354.3, 298.9), (125.2, 297.6), (368.6, 63.8), (377.6, 150.8), (323.4, 320.2), (353.1, 47.3), (5.1, 283.3), (15.9, 147.7), (139.0, 191.0), (223.8, 237.4)]
    v = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(xy, 1)], "line_id long, pos int, x double, y double")
    kept = {r.pos for r in lines.simplified(v, 57.3).collect()}
    assert 3 in kept and 4 not in kept


def test_distance_divides_by_the_square_of_the_length(spark):
    ax, ay, bx, by, px, py = 168.7, 318.1, 354.3, 298.9, 179.7, 291.1
    row = spark.range(1).select(J.segment_distance2(*(F.lit(v) for v in (px, py, ax, ay, bx, by))).alias("d")).first().d
    dx, dy = bx - ax, by - ay
    t = ((px - ax) * dx + (py - ay) * dy) / ((dx * dx + dy * dy) ** 0.5) ** 2
    assert row == (px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2
