"""Arms of a node meet those next to their opposite bearing; no pairs are listed, however many arms a node has."""

import random

from geoloom.operators import graph as G
from geoloom.operators import junctions
from tests.test_whole import pairs_one_by_one


def _arms(seed, nodes=40, most=14):
    """Coarse bearings, so that turns tie and bearings repeat; lines with both ends at a node; 0 and 360; arms without a bearing."""
    rng, out = random.Random(seed), []
    for node in range(nodes):
        step = rng.choice([0.5, 10.0, 45.0])
        for _ in range(rng.randrange(1, most)):
            line = len(out) // 2
            bearing = rng.choice([None, 360.0, 180.0, *(rng.randrange(int(360 / step) + 1) * step for _ in range(9))])
            out.append((node, line * 2, line, bearing))
            if bearing is not None and rng.random() < 0.4:
                out.append((node, line * 2 + 1, line, (bearing + 180.0) % 360.0))
                continue
            if len(out) % 2:
                out.append((node, line * 2 + 1, line, rng.choice([None, round(rng.uniform(0, 360), 4)])))
    return out


def _best(arms):
    by, out = {}, set()
    for node, a, _, p in arms:
        for other, b, _, q in arms:
            if node == other and a < b and p is not None and q is not None and (t := abs(180 - min(abs(p - q) % 360, 360 - abs(p - q) % 360))) <= 45:
                for arm in (a, b):
                    by[node, arm] = min(by.get((node, arm), (t, a, b)), (t, a, b))
    for (node, arm), (t, a, b) in by.items():
        if arm == a and by[node, b] == (t, a, b):
            out.add((node, a, b))
    return out


def test_pairs_as_one_by_one(spark):
    for seed in range(6):
        arms = _arms(seed)
        df = spark.createDataFrame(arms, "node long, arm long, line long, bearing double").repartition(5)
        assert {(r.node, r.a, r.b) for r in G.paired(df).collect()} == pairs_one_by_one(arms) != set()
        assert {(r.node, r.a, r.b) for r in G.straightest(df.drop("line")).collect()} == _best(arms) != set()


def test_copies_of_a_short_line(spark):
    arms = [(1, i * 2 + k, i, 30.0 + 180.0 * k) for i in range(15) for k in (0, 1)] + [(1, 100, 50, 32.0)]
    got = {(r.node, r.a, r.b) for r in G.paired(spark.createDataFrame(arms, "node long, arm long, line long, bearing double")).collect()}
    assert got == pairs_one_by_one(arms)


def test_no_pairs_are_listed(spark, monkeypatch):
    rng = random.Random(3)
    arms = spark.createDataFrame([(1, i, i, round(rng.uniform(0, 360), 4)) for i in range(3000)], "node long, arm long, line long, bearing double")
    rows, whole = [], G.written
    monkeypatch.setattr(G, "written", lambda df: rows.append((w := whole(df)).count()) or w)
    assert G.paired(arms).count() > 1000
    assert max(rows) <= 3000
    assert "Join" not in G.straightest(arms)._jdf.queryExecution().toString()


def test_a_queue_asks_few_groups_again(monkeypatch):
    asked, whole = [], junctions.Around.opposite
    monkeypatch.setattr(junctions.Around, "opposite", lambda *a: asked.append(1) or whole(*a))
    arms = sorted((float(i % 360), i, i) for i in range(360 * 90))
    assert len(list(junctions.picked_pairs(arms, len(arms)))) == 180 * 90
    assert len(asked) < 6 * len(arms)
