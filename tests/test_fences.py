"""Ticks of fences against loops over the lines."""

import collections
import math

from geoloom.operators import enclosures as E


def brute(rows, private, public):
    lines = collections.defaultdict(list)
    for line, _, ax, ay, bx, by in sorted(rows):
        lines[line].append(((ax, ay), (bx, by)))
    inside = lambda boxes, x, y: any(x0 <= x < x1 and y0 <= y < y1 for x0, y0, x1, y1 in boxes)
    out = {}
    for line, segs in lines.items():
        pts = [segs[0][0], *(b for _, b in segs)]
        gap, length = math.dist(pts[0], pts[-1]), sum(math.dist(a, b) for a, b in segs)
        area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1])) / 2
        ring = len(segs) >= 3 and (gap <= 0.3 or gap <= min(6.0, E.RING_SHARE * length)) and abs(area) >= 15
        net, m0 = 0, 0.0
        for a, b in segs:
            n = math.dist(a, b)
            if n == 0:
                continue
            t = ((b[0] - a[0]) / n, (b[1] - a[1]) / n)
            for k in range(10_000):
                d = 3.0 + 6.0 * k - m0
                if d >= n:
                    break
                if d >= 0:
                    x, y = a[0] + t[0] * d, a[1] + t[1] * d
                    for s in (1, -1):
                        p = (x - s * 1.2 * t[1], y + s * 1.2 * t[0])
                        net -= s * (inside(private, *p) - inside(public, *p))  # ticks on the right
            m0 += n
        out[line] = (ring, net, area > 0 if ring else net < 0)
    return out


def test_ticks(spark, sf):
    from geoloom.plans import faces as Q

    f, private, public = Q.turned_fences(spark, sf)
    boxes = lambda d: [tuple(r) for r in d.select("x0", "y0", "x1", "y1").collect()]
    want = brute([tuple(r) for r in f.select("line_id", "pos", "ax", "ay", "bx", "by").collect()], boxes(private), boxes(public))
    got = {r.line_id: (r.ring, r.net, r.reverse) for r in Q.win15_fence_ticks(spark, sf).collect()}
    assert got == want and any(v[2] for v in want.values())


def test_open_lines_turn_to_private_ground(spark):
    rows = [(1, 0, 0.0, 0.0, 30.0, 0.0, 30.0, 0.0), (2, 0, 0.0, 10.0, 30.0, 10.0, 30.0, 0.0), (3, 0, 100.0, 0.0, 130.0, 0.0, 30.0, 0.0), (4, 0, 0.0, 5.0, 30.0, 5.0, 30.0, 0.0)]
    seg = spark.createDataFrame(rows, "line_id long, pos int, ax double, ay double, bx double, by double, len double, m0 double")
    box = lambda *b: spark.createDataFrame([tuple(map(float, x)) for x in b], "x0 double, y0 double, x1 double, y1 double")
    got = {r.line_id: (r.net, r.reverse) for r in E.oriented(seg, box((0, 0, 30, 10)), box((0, 10, 30, 20))).collect()}
    assert got == {1: (-5, True), 2: (10, False), 3: (0, False), 4: (0, False)}
    left = {r.line_id: r.reverse for r in E.oriented(seg, box((0, 0, 30, 10)), box((0, 10, 30, 20)), ticks_on_left=True).collect()}
    assert left == {1: False, 2: True, 3: False, 4: False}
