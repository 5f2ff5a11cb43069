"""Picks with a spacing and a quota against taking one by one."""

import collections
import math
import random

from geoloom.operators import picks as K


def brute(grounds, mapped, detected, scale, r=K.Rules()):
    zone_of = lambda x, y: min((z for z, _, x0, y0, x1, y1 in grounds if x0 <= x < x1 and y0 <= y < y1), default=None)
    known, found = collections.defaultdict(list), collections.defaultdict(list)
    for i, x, y, tall, flat in mapped:
        if not flat and (z := zone_of(x, y)) is not None:
            known[z].append((-(10.0 if tall else 5.0), False, i, x, y))
    for i, x, y, s in detected:
        if (z := zone_of(x, y)) is not None and all(math.dist((x, y), k[3:]) > r.same for k in known[z]):
            found[z].append((-float(s), True, i, x, y))
    out = set()
    for z, area, *_ in grounds:
        kept = []
        for c in sorted(known[z] + found[z]):
            if all(math.dist(c[3:], k[3:]) >= r.gap_mm * scale / 1000 for k in kept):
                kept.append(c)
        for n, c in enumerate(kept[: 1 if area <= r.small else max(1, math.ceil(area / r.each))], 1):
            out.add((c[2], z, n, "detected" if c[1] else "mapped"))
    return out


def tables(spark, grounds, mapped, detected):
    return (
        spark.createDataFrame(grounds, "zone long, area double, x0 double, y0 double, x1 double, y1 double"),
        spark.createDataFrame(mapped, "id long, x double, y double, tall boolean, flat boolean"),
        spark.createDataFrame(detected, "id long, x double, y double, score double"),
    )


def test_spacing_and_quota(spark):
    rng = random.Random(5)
    grounds = [(k, w * h, x, y, x + w, y + h) for k, (x, y, w, h) in enumerate([(0.0, 0.0, 20.0, 20.0), (15.0, 10.0, 40.0, 30.0), (80.0, 0.0, 50.0, 50.0), (200.0, 0.0, 9.0, 9.0)])]
    at = lambda: (rng.uniform(0, 130), rng.uniform(0, 50))
    mapped = [(i, *at(), rng.random() < 0.3, rng.random() < 0.3) for i in range(40)]
    detected = [(i, *at(), float(rng.randrange(4))) for i in range(150)]
    for scale in (1000, 3000):
        got = {tuple(r) for r in K.playground_objects(*tables(spark, grounds, mapped, detected), scale).select("id", "zone", "rank", "source").collect()}
        assert got == brute(grounds, mapped, detected, scale)
    none = K.playground_objects(*tables(spark, grounds, [], []), 1000)
    assert none.count() == 0


def test_query(spark, sf):
    from geoloom.plans import network as Q

    grounds, mapped, detected = Q.playground_inputs(spark, sf)
    want = brute(*([tuple(r) for r in d.collect()] for d in (grounds, mapped, detected)), 1000)
    assert {tuple(r) for r in Q.top06_playground_objects(spark, sf).select("id", "zone", "rank", "source").collect()} == want and len(want) > 5
