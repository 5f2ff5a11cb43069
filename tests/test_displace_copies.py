"""Copies of objects and paths go through the rounds once, and all rows have the result of one."""

import random

from geoloom.operators import displace as D

OBJECTS = "id long, x0 double, y0 double, x1 double, y1 double"
AXES = "axis long, seg int, ax double, ay double, bx double, by double, half double"


def test_copies_share_a_fate(spark, monkeypatch):
    rng = random.Random(4)
    box = lambda i, w: (x := rng.uniform(0, 60), y := rng.uniform(0, 60), x + w, y + w)
    boxes = [box(i, 0.0 if i % 2 else 5.0) for i in range(24)]
    paths = [(rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(4)]
    objects = lambda n: spark.createDataFrame([(i + 100 * c, *b) for c in range(n) for i, b in enumerate(boxes)], OBJECTS)
    # axes of equal segments and another width are no copies
    axes = lambda n: spark.createDataFrame([(i + 10 * c, 0, *p, 1.0) for c in range(n) for i, p in enumerate(paths)] + [(99, 0, *paths[0], 2.0)], AXES)
    one = {r[0]: r[1:] for r in D.displaced(objects(1), axes(1), 5000, 2.0).collect()}
    met, plain = [], D.met
    monkeypatch.setattr(D, "met", lambda o, a, *more: met.append((o.count(), a.count())) or plain(o, a, *more))
    got = D.displaced(objects(3), axes(3), 5000, 2.0).collect()
    assert len(got) == 72 and all(r[1:] == one[r[0] % 100] for r in got) and len({r[1] for r in got}) > 2
    assert met == [(24, 5)]
