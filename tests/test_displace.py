"""Objects moved off paths, against the same rules one by one in plain Python."""

import collections
import math
import random

from geoloom.operators import displace as D

R = D.Rules()
OBJECTS = "id long, x0 double, y0 double, x1 double, y1 double"
AXES = "axis long, seg int, ax double, ay double, bx double, by double, half double"


def foot(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return a[0] + t * dx, a[1] + t * dy


def vector(box, seg):
    """From the segment to the box: outside it by coordinates clamped to the box, else 0."""
    x0, y0, x1, y1 = box
    a, b = seg
    lo, hi = 0.0, 1.0
    for p, d, low, high in ((a[0], b[0] - a[0], x0, x1), (a[1], b[1] - a[1], y0, y1)):
        if d == 0:
            if not low <= p <= high:
                lo, hi = 1.0, 0.0
        else:
            t, u = sorted(((low - p) / d, (high - p) / d))
            lo, hi = max(lo, t), min(hi, u)
    if lo <= hi:
        return 0.0, 0.0
    clamp = lambda q: (min(max(q[0], x0), x1), min(max(q[1], y0), y1))
    near = [(clamp(q), q) for q in seg] + [(c, foot(c, a, b)) for c in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    o, s = min(near, key=lambda n: math.dist(*n))
    return o[0] - s[0], o[1] - s[1]


def brute(objects, axes, scale, widest):
    m, out = scale / 1000, {}
    lines = collections.defaultdict(list)
    for axis, _, ax, ay, bx, by, half in axes:
        lines[axis].append((((ax, ay), (bx, by)), half))
    slack, beyond = R.slack * m, R.beyond * m

    def distances(box, tx=0.0, ty=0.0):
        b = (box[0] + tx, box[1] + ty, box[2] + tx, box[3] + ty)
        res = {}
        for k, segs in lines.items():
            v, s = min(((vector(b, s), s) for s, _ in segs), key=lambda n: math.hypot(*n[0]))
            res[k] = (math.hypot(*v), v, s, segs[0][1])
        return res

    for i, *box in objects:
        point = box[0] == box[2] and box[1] == box[3]
        extra = (R.point_radius * point + R.gap) * m
        before = distances(box)
        if not any(h + extra - d > slack for d, _, _, h in before.values()):
            out[i] = ("clear", 0.0, 0.0)
            continue
        if min(d for d, *_ in before.values()) > slack:
            ks = [k for k, n in before.items() if n[0] <= widest + extra]
            tx = ty = 0.0
            for _ in range(R.rounds):
                now = distances(box, tx, ty)
                deep = [(-(now[k][3] + extra - now[k][0]), k) for k in ks if now[k][3] + extra - now[k][0] > slack and now[k][0] > slack * 1e-6]
                if not deep:
                    break
                o, k = min(deep)
                tx += now[k][1][0] / now[k][0] * (beyond - o)
                ty += now[k][1][1] / now[k][0] * (beyond - o)
            end = distances(box, tx, ty)
            if 0 < math.hypot(tx, ty) <= R.most * m and not any(end[k][0] + slack < min(before[k][0], end[k][3] + extra) for k in end):
                out[i] = ("moved", tx, ty)
                continue
        if not point:
            out[i] = ("area", 0.0, 0.0)
            continue
        d, k = min((n[0], k) for k, n in before.items() if n[0] < n[3] + extra - slack)
        _, v, (a, b), half = before[k]
        n = (v[0] / d, v[1] / d) if d >= beyond else (-(b[1] - a[1]) / math.dist(a, b), (b[0] - a[0]) / math.dist(a, b))
        d = d if d >= beyond else 0.0
        best = None
        for far in (half + extra + beyond - d, -(half + extra + beyond) - d):
            t = (n[0] * far, n[1] * far)
            if abs(far) <= max(R.most, R.point_most) * m and all(q[0] >= q[3] + extra - slack for q in distances(box, *t).values()) and (best is None or abs(far) < best[0]):
                best = (abs(far), *t)
        out[i] = ("stepped", *best[1:]) if best else ("kept", 0.0, 0.0)
    return out, distances


def run(spark, objects, axes, scale, widest):
    got = D.displaced(spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(axes, AXES), scale, widest).collect()
    return {r["id"]: r for r in got}


def test_against_one_by_one(spark):
    rng = random.Random(9)
    axes = []
    for k in range(14):
        x, y, half = rng.uniform(0, 150), rng.uniform(0, 150), rng.choice([1.0, 2.0, 3.0])
        for s in range(3):
            nx, ny = x + rng.uniform(-25, 25), y + rng.uniform(-25, 25)
            axes.append((k, s, x, y, nx, ny, half))
            x, y = nx, ny
    objects = []
    for i in range(160):
        x, y = rng.uniform(0, 150), rng.uniform(0, 150)
        w, h = (0.0, 0.0) if i % 2 else (rng.uniform(2, 9), rng.uniform(2, 9))
        objects.append((i, x, y, x + w, y + h))
    # a point on an axis, and one with a corner lacking
    objects.append((900, axes[0][2] * 0.5 + axes[0][4] * 0.5, axes[0][3] * 0.5 + axes[0][5] * 0.5) + (axes[0][2] * 0.5 + axes[0][4] * 0.5, axes[0][3] * 0.5 + axes[0][5] * 0.5))
    got = run(spark, [*objects, (901, None, 1.0, 2.0, 3.0)], axes, 5000, 3.0)
    want, distances = brute(objects, axes, 5000, 3.0)
    assert set(got) == set(want)
    for i, (status, tx, ty) in want.items():
        assert got[i]["status"] in ({"clipped", "dropped"} if status == "area" else {status}), (i, status, got[i])
        assert abs(got[i]["tx"] - tx) < 1e-6 and abs(got[i]["ty"] - ty) < 1e-6
    kinds = collections.Counter(r["status"] for r in got.values())
    assert all(kinds[k] > 2 for k in ("clear", "moved", "clipped")) and kinds["stepped"] + kinds["kept"] > 2
    # what was moved lies beside no path that it was clear of, and near enough
    for i, *box in objects:
        if got[i]["status"] == "moved":
            assert math.hypot(got[i]["tx"], got[i]["ty"]) <= R.most * 5 + 1e-9


def test_clipping(spark):
    axes = [(1, 0, -50.0, 5.0, 50.0, 5.0, 1.0)]
    got = run(spark, [(1, 0.0, 0.0, 12.0, 20.0), (2, 0.0, 3.0, 1.0, 7.0), (3, 0.0, 0.0, 12.0, 20.0)], axes, 5000, 1.0)
    # the band is 1 m wide on both sides, and the gap another metre
    for i in (1, 3):
        r = got[i]
        assert r["status"] == "clipped" and r["pieces"] == 2 and abs(r["left_area"] - 12 * (20 - 4)) <= 12 * 1.0
    assert got[2]["status"] == "dropped" and got[2]["pieces"] == 0


def test_nothing(spark):
    assert run(spark, [], [(1, 0, 0.0, 0.0, 1.0, 1.0, 1.0)], 5000, 1.0) == {}
    assert run(spark, [(1, 0.0, 0.0, 1.0, 1.0)], [], 5000, 1.0)[1]["status"] == "clear"


def test_query(spark, sf):
    from geoloom.plans import tidying as Q

    objects, axes, widest = Q.moved_inputs(spark, sf)
    want, _ = brute([tuple(r) for r in objects.collect()], [tuple(r) for r in axes.select(*(c.split()[0] for c in AXES.split(", "))).collect()], 5000, widest)
    got = {r["id"]: r for r in Q.grf21_displaced(spark, sf).collect()}
    assert set(got) == set(want)
    for i, (status, tx, ty) in want.items():
        assert got[i]["status"] in ({"clipped", "dropped"} if status == "area" else {status}), (i, status, got[i])
        assert abs(got[i]["tx"] - tx) < 1e-5 and abs(got[i]["ty"] - ty) < 1e-5
    assert {r["status"] for r in got.values()} >= {"clear", "moved", "clipped"}
