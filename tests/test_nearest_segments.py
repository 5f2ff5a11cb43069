"""The nearest segment of each point: few segments are asked where they lie dense, and cells around where they don't."""

import random

import numpy as np
import pytest
from geoloom.operators import nearest_segments as N
from geoloom.operators import spatial_join as J
from pyspark.sql import functions as F


def _tables(spark, points, lines, spread, reach, seed=5):
    rng = random.Random(seed)
    at = lambda: rng.randrange(spread * 10) / 10
    p = [(i, at(), at()) for i in range(points)]
    s = []
    for _ in range(lines):
        x, y = at(), at()
        s += [(x, y, x + rng.uniform(-reach, reach), y + rng.uniform(-reach, reach))] * rng.randrange(1, 3)
    s += [(x, y, x, y) for _, x, y in p[:5]] + [(x + 3.0, y, x + 3.0, y) for _, x, y in p[5:20]]
    return spark.createDataFrame(p, "id long, x double, y double"), spark.createDataFrame(s, "ax double, ay double, bx double, by double")


@pytest.mark.parametrize(("points", "lines", "spread", "reach"), [(300, 400, 60, 60), (200, 40, 400, 10), (400, 30, 400, 300)])
def test_least_distances_are_those_of_all_pairs(spark, points, lines, spread, reach):
    p, s = _tables(spark, points, lines, spread, reach)
    want = J.near_segments(p, s, 15.0).groupBy("id").agg(F.min("d2").alias("d2"))
    got = N.nearest_segments(p, s, 15.0, 16.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_dense_segments_meet_few_points(monkeypatch):
    """A pair of each point and segment would be 4,000,000 distances."""
    rng = np.random.default_rng(1)
    a, b = rng.uniform(0, 16, (4000, 2)), rng.uniform(0, 16, (4000, 2))
    d = b - a
    s = np.stack([a[:, 0], a[:, 1], d[:, 0], d[:, 1], (d * d).sum(1)])
    x, y = rng.uniform(0, 16, (2, 1000))
    asked, plain = [], N._d2
    monkeypatch.setattr(N, "_d2", lambda x, y, s: asked.append(s.shape[1]) or plain(x, y, s))
    got = N._least(x, y, s)
    assert list(got) == [plain(p, q, s).min() for p, q in zip(x, y)] and sum(asked) < 1_000_000
