"""Lines that others cover are found in rounds: where lines lie dense, few lines meet all others."""

import random

import pytest
from geoloom.operators import lines, sequence
from pyspark.sql import functions as F


def _seg(spark, n, copies=1, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        pts = [(rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(rng.randrange(2, 7))]
        rows += [(i * copies + c, p, x, y) for c in range(copies) for p, (x, y) in enumerate(pts)]
    return sequence.segments(spark.createDataFrame(rows, "line_id long, pos long, x double, y double"))


def _hits(seg, distance, least_cos=0.0):
    """Stations of each line, and those that each other line covers, every pair asked for."""
    st = sequence.stations(seg, 5.0)
    n = {r.line_id: r.n for r in st.groupBy("line_id").agg(F.count("*").alias("n")).collect()}
    hit = lines.covering_lines(st, seg.withColumnRenamed("line_id", "by_line"), distance, "by_line", least_cos).where("line_id <> by_line")
    return n, {(r.line_id, r.by_line): r.n for r in hit.groupBy("line_id", "by_line").agg(F.count("*").alias("n")).collect()}


@pytest.mark.parametrize(("n", "copies", "distance"), [(60, 1, 6.0), (30, 3, 4.0), (50, 1, 0.5)])
def test_not_outdone(spark, n, copies, distance):
    seg = _seg(spark, n, copies)
    stations, hits = _hits(seg, distance)
    total = {r.line_id: r.t for r in seg.groupBy("line_id").agg(F.round(F.sum("len"), 6).alias("t")).collect()}
    gone = {i for (i, j), k in hits.items() if total[i] < total[j] and k * 10 >= 3 * stations[i]}
    want = sorted((i, k) for i, k in stations.items() if i not in gone)
    assert sorted(map(tuple, lines.not_outdone(seg, 5.0, distance, 0.3).collect())) == want != []


@pytest.mark.parametrize(("n", "copies", "distance"), [(90, 1, 2.0), (30, 3, 2.0), (40, 1, 0.2)])
def test_taken_lines(spark, n, copies, distance):
    seg = _seg(spark, n, copies)
    stations, hits = _hits(seg, distance, 0.5)
    order = sorted(stations, key=lambda i: (i % 4, -i))
    kept = []
    for i in order:
        if all(hits.get((i, j), 0) * 100 <= 8 * stations[i] for j in kept):
            kept.append(i)
    o = spark.createDataFrame([(i, k) for k, i in enumerate(order)], "line_id long, o long")
    assert sorted(r.line_id for r in lines.taken_lines(seg, o, 5.0, distance, 0.08, 0.5).collect()) == sorted(kept) != []


def test_dense_lines_meet_few(spark, monkeypatch):
    seg = _seg(spark, 400)
    met, whole = [], lines._cover_counts
    monkeypatch.setattr(lines, "_cover_counts", lambda a, b, *more: met.append(a.select("line_id").distinct().count() * b.select("line_id").distinct().count()) or whole(a, b, *more))
    lines.not_outdone(seg, 5.0, 6.0, 0.3).count()
    assert sum(met) < 400 * 400 / 4
    met.clear()
    lines.taken_lines(seg, seg.select("line_id", F.col("line_id").alias("o")).distinct(), 5.0, 2.0, 0.08, 0.5).count()
    assert sum(met) < 400 * 400 / 4
