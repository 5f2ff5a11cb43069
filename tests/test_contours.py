"""Contours against marching and linking in plain Python, smoothing against loops over numpy arrays."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import contours as C


def table(spark, z, **flags):
    rows = [(r, c, None if math.isnan(z[r, c]) else float(z[r, c]), *(bool(f[r, c]) for f in flags.values())) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(rows, "rr long, cc long, z double" + "".join(f", {k} boolean" for k in flags))


def gauss(v, ok, sigma):
    n = int(4 * sigma + 0.5)
    out = np.full(v.shape, np.nan)
    for r in range(v.shape[0]):
        for c in range(v.shape[1]):
            num = den = 0.0
            for i in range(max(0, r - n), min(v.shape[0], r + n + 1)):
                for j in range(max(0, c - n), min(v.shape[1], c + n + 1)):
                    if ok[i, j]:
                        w = math.exp(-0.5 * ((i - r) ** 2 + (j - c) ** 2) / sigma**2)
                        num, den = num + w * v[i, j], den + w
            out[r, c] = num / den if den else np.nan
    return out


def step(x, lo, hi):
    t = np.clip((x - lo) / np.maximum(hi - lo, 1e-9), 0, 1)
    return t * t * (3 - 2 * t)


@pytest.mark.parametrize("rules", [C.Smoothing(), C.TOWN])
def test_adaptive_surface(spark, rules):
    rng = np.random.default_rng(1)
    size, interval, scale = 6.0, 5.0, 10000
    y, x = np.mgrid[0:14, 0:16]
    z = 500 + np.where(x > 10, (x - 10) * 4.0, 0.05 * x) + rng.normal(0, 0.2, x.shape)
    z[3, 4] += 3
    z[8, 2] = z[13, 15] = np.nan
    ok = ~np.isnan(z)
    urban, green, protect = (np.zeros(z.shape, bool) for _ in range(3))
    urban[5:8, 9:13], green[10:12, 1:5], protect[0:2, 6:9] = True, True, True
    gy, gx = np.gradient(z, size)
    grad = np.hypot(gx, gy)
    spacing = interval / np.maximum(np.nan_to_num(gauss(np.nan_to_num(grad), ok & ~np.isnan(grad), rules.slope / size)), 1e-6) / scale * 1000
    u = np.minimum(2 * gauss(urban * 1.0, ok, rules.urban / size), 1) * step(spacing, *rules.urban_mm)
    flat = np.maximum(step(spacing, *rules.flat_mm), u)
    delta = (gauss(z, ok, rules.strong / size) - z) * (1 - u) + (gauss(z, ok, rules.urban_strong / size) - z) * u
    w = np.minimum(gauss(flat, ok, rules.zone / size) * flat, 1)
    w = np.where(w < 0.02, 0, w)
    if rules.keep_green:
        w = w * (1 - np.minimum(2 * gauss(green * 1.0, ok, rules.urban / size), 1))
        w = np.where(w < 0.02, 0, w)
    w = w * (1 - step(np.abs(delta), rules.detail[0] + u * rules.urban_detail, rules.detail[1] + u * rules.urban_detail))
    w = w * (1 - np.minimum(2 * gauss(protect * 1.0, ok, rules.urban / 2 / size), 1))
    w = np.where(w < 0.02, 0, w)
    want = np.where(w > 0, z + w * np.clip(delta, -0.3 * interval, 0.3 * interval), z)
    got = {(r.rr, r.cc): (r.z, r.w) for r in C.adaptive_surface(table(spark, z, urban=urban, green=green, protect=protect), size, interval, scale, rules).collect()}
    assert len(got) == z.size
    for (r, c), (v, weight) in got.items():
        if ok[r, c]:
            assert abs(v - want[r, c]) < 1e-7 and abs(weight - w[r, c]) < 1e-7
        else:
            assert v is None and weight is None
    assert 0 < (w[ok] > 0).mean() < 1


def marched(z, interval, offset=0.0):
    """Lines as lists of points, by linking unordered segments of the same triangles."""
    near = collections.defaultdict(list)
    for r in range(z.shape[0] - 1):
        for c in range(z.shape[1] - 1):
            a, b, d, e = (r, c), (r, c + 1), (r + 1, c), (r + 1, c + 1)
            if any(math.isnan(z[p]) for p in (a, b, d, e)):
                continue
            for tri in ((a, b, d), (b, e, d)):
                v = [z[p] for p in tri]
                for k in range(math.floor((min(v) - offset) / interval) + 1, math.floor((max(v) - offset) / interval) + 1):
                    level = k * interval + offset
                    ends = [(k, *sorted((p, q))) for p, q in ((tri[0], tri[1]), (tri[1], tri[2]), (tri[2], tri[0])) if (z[p] >= level) != (z[q] >= level)]
                    assert len(ends) == 2
                    near[ends[0]].append(ends[1])
                    near[ends[1]].append(ends[0])

    def point(n):
        k, p, q = n
        t = (k * interval + offset - z[p]) / (z[q] - z[p])
        return round(p[1] + t * (q[1] - p[1]), 6), round(p[0] + t * (q[0] - p[0]), 6)

    lines, seen = [], set()
    for n in sorted(near, key=lambda n: len(near[n])):  # open ends first
        if n in seen:
            continue
        path, at = [], n
        while at is not None:
            seen.add(at)
            path.append(at)
            at = next((m for m in near[at] if m not in seen), None)
        closed = len(near[n]) == 2
        lines.append((n[0], closed, [point(m) for m in path]))
    return lines


def canonical(closed, pts):
    """The same for every start and direction."""
    if not closed:
        return min(tuple(pts), tuple(pts[::-1]))
    turns = [tuple(q[i:] + q[:i]) for q in (pts, pts[::-1]) for i in range(len(q)) if q[i] == min(q)]
    return min(turns)


def test_lines_are_linked_and_turned(spark):
    rng = np.random.default_rng(6)
    y, x = np.mgrid[0:13, 0:17]
    z = 10 + 3 * np.sin(x / 2.1) * np.cos(y / 1.7) + rng.normal(0, 0.3, x.shape)
    z[4, 4], z[9, 10], z[2, 12] = np.nan, 10.0, 12.5
    for interval, offset in ((2.5, 0.0), (2.5, 1.25)):
        got = collections.defaultdict(list)
        for r in C.contour_lines(table(spark, z), interval, offset).collect():
            got[str(r.line_id)].append((r.pos, r.k, r.closed, round(r.x, 6), round(r.y, 6)))
        found = []
        for rows in got.values():
            rows.sort()
            assert [p for p, *_ in rows] == list(range(len(rows)))
            pts = [(px, py) for *_, px, py in rows]
            closed = rows[0][2]
            assert not closed or pts[0] == pts[-1]
            found.append((rows[0][1], closed, canonical(closed, pts[:-1] if closed else pts)))
            # higher ground is on the left of every step
            for (ax, ay), (bx, by) in zip(pts, pts[1:]):
                if math.dist((ax, ay), (bx, by)) > 1e-3:
                    mx, my, n = (ax + bx) / 2, (ay + by) / 2, math.dist((ax, ay), (bx, by))
                    sx, sy = mx - (by - ay) / n * 1e-4, my + (bx - ax) / n * 1e-4
                    c, r = min(math.floor(sx), 15), min(math.floor(sy), 11)
                    fx, fy = sx - c, sy - r
                    v = z[r, c] * (1 - fx - fy) + z[r, c + 1] * fx + z[r + 1, c] * fy if fx + fy <= 1 else z[r + 1, c + 1] * (fx + fy - 1) + z[r + 1, c] * (1 - fx) + z[r, c + 1] * (1 - fy)
                    assert v >= rows[0][1] * interval + offset - 1e-6
        assert sorted(found) == sorted((k, closed, canonical(closed, pts)) for k, closed, pts in marched(z, interval, offset))
        assert {c for _, c, _ in found} == {True, False}


def test_hills_depressions_and_ticks(spark):
    y, x = np.mgrid[0:21, 0:41]
    z = 100 + 8 * np.exp(-((x - 10) ** 2 + (y - 10) ** 2) / 18) - 8 * np.exp(-((x - 30) ** 2 + (y - 10) ** 2) / 18)
    facts = C.line_facts(C.contour_lines(table(spark, z), 2.0, 1.0))
    got = {r.level: (r.closed, r.area > 0, r.ticks) for r in facts.withColumn("ticks", C.slope_ticks(facts, 8.0, 12.0, 2)).collect()}
    assert {k: v[:2] for k, v in got.items()} == {v: (True, v > 100) for v in (93.0, 95.0, 97.0, 99.0, 101.0, 103.0, 105.0, 107.0)}
    assert all(got[v][2] == 0 for v in (101.0, 103.0, 105.0, 107.0)) and got[99.0][2] == 2 and got[93.0][2] == 1


def test_ordered_lists_and_rings(spark):
    links = [(1, 5), (5, 3), (3, None), (7, 2), (2, 9), (9, 7), (4, None), (8, 8), (11, 10), (10, 12), (12, 11)]
    got = collections.defaultdict(list)
    for r in C.ordered(spark.createDataFrame(links, "id long, next long")).collect():
        got[r.path].append((r.place, r.id, r.closed))
    assert {tuple((i, c) for _, i, c in sorted(v)) for v in got.values()} == {((1, False), (5, False), (3, False)), ((2, True), (9, True), (7, True)), ((4, False),), ((8, True),), ((10, True), (12, True), (11, True))}
    assert all([p for p, *_ in sorted(v)] == list(range(len(v))) for v in got.values())


def test_helper_lines_keep_their_distance(spark):
    lines = lambda rows: spark.createDataFrame(rows, "line_id long, pos long, level double, x double, y double")
    main = lines([(1, 0, 1.0, 0.0, 0.0), (1, 1, 1.0, 20.0, 0.0)])
    helper = lines([(9, k, 1.5, float(k), abs(k - 10) * 0.5) for k in range(21)])
    got = {(r.first, r.last, r.vertices, round(r.length, 6)) for r in C.helper_runs(helper, main, 2.0, 3.0).collect()}
    near = [k for k in range(21) if abs(k - 10) * 0.5 <= 2.0]
    assert got == {(0, min(near) - 1, min(near), round((min(near) - 1) * math.hypot(1, 0.5), 6)), (max(near) + 1, 20, 20 - max(near), round((19 - max(near)) * math.hypot(1, 0.5), 6))}


def test_no_cells(spark):
    assert C.contour_lines(table(spark, np.full((3, 3), np.nan)), 1.0).count() == 0
    assert C.contour_lines(table(spark, np.ones((3, 3))).where(F.lit(False)), 1.0).count() == 0


def test_chain(spark, sf):
    """Codes, lengths and drawn vertices of the whole chain, from its own surface by plain marching."""
    from geoloom.plans import contouring as Q

    cells = Q._surface(spark, sf).collect()
    z = np.full((Q.SIDE, Q.SIDE), np.nan)
    for r in cells:
        z[r.rr, r.cc] = np.nan if r.z is None else r.z
    want, found = collections.defaultdict(list), collections.defaultdict(list)
    for k, closed, pts in marched(z, Q.INTERVAL):
        at = [(Q.SIZE * x, Q.SIZE * y) for x, y in (pts + pts[:1] if closed else pts)]
        length = sum(math.dist(p, q) for p, q in zip(at, at[1:]))
        if length >= Q.LEAST_LENGTH:
            want["102" if k % 5 == 0 else "101", k * Q.INTERVAL, closed, len(at)].append(length)
    got = Q.pip05_contours(spark, sf).collect()
    for r in got:
        if r.code != "103":
            found[r.code, r.level, r.closed, r.vertices].append(r.length)
    assert {k: len(v) for k, v in found.items()} == {k: len(v) for k, v in want.items()}
    assert all(abs(p - q) < 2e-3 for k in want for p, q in zip(sorted(want[k]), sorted(found[k])))
    assert all(r.drawn >= 2 and (r.ticks == 0 or r.sunk and r.closed) for r in got)
    assert all(r.level % Q.INTERVAL == Q.INTERVAL / 2 and r.length >= Q.LEAST_HELPER for r in got if r.code == "103")
    assert {r.code for r in got} >= {"101", "103"}
