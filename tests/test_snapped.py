"""Ends that snap together are found by cells; no pairs of ends are listed."""

import random

import pytest
from geoloom.operators import graph as G
from tests.test_whole import least_ids


def _clusters(seed, n, span):
    rng = random.Random(seed)
    at = [(rng.uniform(-span, span), rng.uniform(-span, span)) for _ in range(6)]
    pts = [rng.choice(at) for _ in range(n)]
    return [(i * 3 + 5, round(x + rng.gauss(0, 2.5), 1), round(y + rng.gauss(0, 2.5), 1)) for i, (x, y) in enumerate(pts)]


@pytest.mark.parametrize(("seed", "n", "span", "tolerance"), [(1, 60, 30, 4.0), (2, 250, 40, 1.0), (3, 250, 40, 0.3), (4, 400, 15, 0.5)])
def test_ends_share_nodes(spark, seed, n, span, tolerance):
    ends = [*_clusters(seed, n, span), (1, 500.0, 500.0), (2, 500.0, 500.0 + tolerance), (3, None, 1.0), (4, float("nan"), 0.1)]
    near = [(i, j) for i, x, y in ends for j, p, q in ends if i < j and x is not None and p is not None and (x - p) ** 2 + (y - q) ** 2 <= tolerance * tolerance]
    want = least_ids({e[0] for e in ends}, near)
    got = G.snapped(spark.createDataFrame(ends, "id long, x double, y double"), tolerance).collect()
    assert {r.id: r.node for r in got} == want
    assert all(r.degree == sum(k == r.node for k in want.values()) for r in got)


def test_cells_whose_outermost_places_are_too_far(spark):
    """Places within two neighbouring cells are near, but none of the outermost ones is."""
    ring = [(-0.9, -1.3), (0.9, -1.3), (-1.3, -0.9), (1.3, -0.9), (-0.9, 1.3), (0.9, 1.3), (-1.3, 0.9), (1.3, 0.9)]
    for gap in (1.9, 1.99, 2.0, 2.01, 2.1):
        one = [(-gap / 2, 0.0), *((x * 0.1 - 2.3, y) for x, y in ring)]
        pts = [(i, x + 50, y + 50) for i, (x, y) in enumerate(one + [(-x, y) for x, y in one])]
        near = [(i, j) for i, x, y in pts for j, p, q in pts if i < j and (x - p) ** 2 + (y - q) ** 2 <= 4.0]
        got = G.snapped(spark.createDataFrame(pts, "id long, x double, y double"), 2.0).collect()
        assert {r.id: r.node for r in got} == least_ids({p[0] for p in pts}, near)


def test_no_pairs_are_listed(spark, monkeypatch):
    rng = random.Random(8)
    ends = spark.createDataFrame([(i, rng.uniform(0, 20), rng.uniform(0, 20)) for i in range(4000)], "id long, x double, y double")
    rows, whole = [], G.written
    monkeypatch.setattr(G, "written", lambda df: rows.append((w := whole(df)).count()) or w)
    assert G.snapped(ends, 4.0).select("node").distinct().count() == 1
    assert max(rows) <= 4000
