"""Picks with a spacing write no pairs: what a round writes stays below the points."""

import random

import pytest
from geoloom.operators import graph, picks
from geoloom.operators import spatial_join as J


def _one_by_one(points, distance, open_end):
    kept = []
    for i, x, y, s in sorted(points, key=lambda p: (-p[3], p[0])):
        near = [(a - x) ** 2 + (b - y) ** 2 for _, a, b in kept]
        if not any(d < distance * distance or (d == distance * distance and not open_end) for d in near):
            kept.append((i, x, y))
    return {k[0] for k in kept}


@pytest.mark.parametrize("open_end", [False, True])
def test_spaced_equals_one_by_one_without_pairs(spark, monkeypatch, open_end):
    rng = random.Random(5)
    points = [(i, float(rng.randrange(40)), float(rng.randrange(40)), rng.randrange(7)) for i in range(1500)]
    monkeypatch.setattr(J, "within", None)  # the pairs of 1,500 points on 40 x 40
    monkeypatch.setattr(graph, "within", None)
    got = graph.spaced(spark.createDataFrame(points, "id long, x double, y double, score long"), 5.0, open_end=open_end)
    assert sorted(r.id for r in got.collect()) == sorted(_one_by_one(points, 5.0, open_end))


def test_zones_are_spaced_by_themselves_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(J, "within", None)
    points = spark.createDataFrame([(1, 1, 0.0, 0.0, 2), (2, 1, 3.0, 4.0, 1), (3, 2, 1.0, 0.0, 1), (4, 1, 1.0, 0.0, 1)], "id long, zone long, x double, y double, score long")
    zones = spark.createDataFrame([(1, 5), (2, 5)], "zone long, quota long")
    assert {r.id for r in picks.zone_picks(points, zones, 5.0).collect()} == {1, 2, 3}


def test_points_without_a_place_stay(spark):
    points = spark.createDataFrame([(1, None, 0.0, 2), (2, float("nan"), 0.0, 1), (3, 0.0, 0.0, 1), (4, 0.0, 1.0, None)], "id long, x double, y double, score long")
    assert {r.id for r in graph.spaced(points, 5.0).collect()} == {1, 2, 4}
