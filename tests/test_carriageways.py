"""Carriageways against loops over stations."""

import collections
import math
from statistics import median

from geoloom.operators import carriageways as C


def hit(p, n, s, kerbs, reach):
    best = None
    q = (p[0] + s * n[0] * reach, p[1] + s * n[1] * reach)
    for ax, ay, bx, by in kerbs:
        side = lambda r: (bx - ax) * (r[1] - ay) - (by - ay) * (r[0] - ax)  # noqa: E731, B023
        of = lambda r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
        if side(p) * side(q) < 0 and of((ax, ay)) * of((bx, by)) < 0:
            d = reach * side(p) / (side(p) - side(q))
            best = d if best is None else min(best, d)
    return best


def brute(axes, kerbs, r=C.Rules()):
    out = {}
    on_other = lambda k, p: any(j != k and min(seg_dist(p, s) for s in axis_segments(a)) <= r.junction for j, a in axes.items())
    for k, pts in axes.items():
        segs, m = [], 0.0
        for a, b in zip(pts, pts[1:]):
            segs.append((m, a, b, math.dist(a, b)))
            m += math.dist(a, b)
        ms = [i * r.step for i in range(math.ceil(m / r.step))]
        if m - ms[-1] > 0.05:
            ms.append(m)
        st = []
        for d in ms:
            m0, a, b, n = next(s for s in segs[::-1] if s[0] <= d)
            t, u = (d - m0) / n, ((b[0] - a[0]) / n, (b[1] - a[1]) / n)
            st.append(((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])), (-u[1], u[0])))
        raw = [(hit(p, n, 1, kerbs, r.reach), hit(p, n, -1, kerbs, r.reach)) for p, n in st]
        ok = [x is not None and y is not None and min(x, y) >= r.least_side and r.width[0] <= x + y <= r.width[1] for x, y in raw]
        near = lambda i: [raw[j] for j in range(max(0, i - r.half_window), min(len(raw), i + r.half_window + 1)) if ok[j]]  # noqa: E731, B023
        sm = [tuple(median(w[c] for w in near(i)) for c in (0, 1)) if ok[i] else None for i in range(len(st))]
        if sum(ok) >= r.measured * len(ok):
            anchors, run = [], []
            for i in range(len(sm) + 1):
                if i < len(sm) and sm[i]:
                    run.append(i)
                else:
                    anchors += run if len(run) >= r.least_run else []
                    run = []
            for a, b in zip(anchors, anchors[1:]):
                if b - a > 1 and ms[b] - ms[a] <= r.gap:
                    for i in range(a + 1, b):
                        t = (ms[i] - ms[a]) / (ms[b] - ms[a])
                        sm[i] = tuple(sm[a][c] + t * (sm[b][c] - sm[a][c]) for c in (0, 1))
            if anchors and on_other(k, pts[0]) and ms[anchors[0]] <= r.gap:
                sm[: anchors[0]] = [sm[anchors[0]]] * anchors[0]
            if anchors and on_other(k, pts[-1]) and ms[-1] - ms[anchors[-1]] <= r.gap:
                sm[anchors[-1] + 1 :] = [sm[anchors[-1]]] * (len(sm) - anchors[-1] - 1)
        run = []
        for i in range(len(sm) + 1):
            if i < len(sm) and sm[i]:
                run.append(i)
            else:
                if len(run) >= r.least_run and m // r.step >= r.least_run:
                    for j in run:
                        (x, y), (nx, ny) = st[j]
                        out[k, j] = tuple(round(v, 6) for v in (*sm[j], x + nx * sm[j][0], y + ny * sm[j][0], x - nx * sm[j][1], y - ny * sm[j][1]))
                run = []
    return out


def axis_segments(pts):
    return list(zip(pts, pts[1:]))


def seg_dist(p, s):
    (ax, ay), (bx, by) = s
    t = max(0.0, min(1.0, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
    return math.hypot(p[0] - ax - t * (bx - ax), p[1] - ay - t * (by - ay))


def tables(spark, axes, kerbs):
    rows = []
    for k, pts in axes.items():
        m = 0.0
        for i, (a, b) in enumerate(zip(pts, pts[1:])):
            rows.append((k, i, *map(float, (*a, *b)), math.dist(a, b), m))
            m += math.dist(a, b)
    return spark.createDataFrame(rows, "line_id long, pos int, ax double, ay double, bx double, by double, len double, m0 double"), spark.createDataFrame([tuple(map(float, k)) for k in kerbs], "ax double, ay double, bx double, by double")


AXES = {
    1: [(0, 0), (61, 0)],  # kerbs with a gap of 8 m and a bay; its end lies on axis 2
    2: [(61, -30), (61, 30)],  # kerbs on one side only
    3: [(0, 100), (25, 100), (50, 110)],  # bends between wide kerbs
    4: [(0, 200), (5, 200)],  # too short
    5: [(0, 300), (60, 300)],  # a gap too long
}
KERBS = [
    (1, 3, 20, 3.4), (28, 3.2, 52, 3), (1, -4, 52, -4), (10, 3, 10, 6), (64, -30, 64, 30),
    (-5, 106, 27, 106), (27, 106, 45, 116), (-5, 95, 26, 95), (26, 95, 60, 106), (-5, 202, 10, 202), (-5, 198, 10, 198),
    (0.5, 303, 14.5, 303), (0.5, 297, 14.5, 297), (45.5, 304, 60.5, 304), (45.5, 297, 60.5, 297),
]


def test_carriageways(spark):
    want = brute(AXES, KERBS)
    edges = C.carriageways(*tables(spark, AXES, KERBS))
    got = {(r.line_id, r.i): tuple(round(v, 6) for v in (r.left, r.right, r.lx, r.ly, r.rx, r.ry)) for r in edges.collect()}
    assert got == want
    by = collections.Counter(k for k, _ in got)
    assert by[1] == 31 and 2 not in by and by[3] > 20 and 4 not in by and 0 < by[5] < 30
    sizes = {(r.line_id, r.stations): (r.first, round(r.last, 3), round(r.area, 3)) for r in C.carriageway_sizes(edges).collect()}
    assert sizes[1, 31][:2] == (2.0, 61.0) and 400 < sizes[1, 31][2] < 460


def test_query(spark, sf):
    from geoloom.plans import faces as Q

    axes, kerbs = Q.kerbed_axes(spark, sf)
    lines = collections.defaultdict(list)
    for r in axes.collect():
        lines[r.line_id] += [(r.ax, r.ay), (r.bx, r.by)]
    want = brute(dict(lines), [(r.ax, r.ay, r.bx, r.by) for r in kerbs.collect()])
    got = Q.jon19_carriageways(spark, sf).collect()
    assert sum(r.stations for r in got) == len(want) > 50
