"""Chained ticks against picking pairs one by one, shapes and rock areas against plain loops."""

import collections
import math
import random

from geoloom.operators import cliffs as C
from geoloom.operators import graph as G


def table(spark, ticks):
    return spark.createDataFrame([(i, *map(float, t)) for i, t in enumerate(ticks)], "id long, ax double, ay double, bx double, by double")


def greedy(ticks, r=C.Rules()):
    """Chains as tuples of tick numbers, from the lesser end on; rings from their least tick on, with a mark."""
    mid = [((a + c) / 2, (b + d) / 2) for a, b, c, d in ticks]
    tan = [((c - a) / math.hypot(c - a, d - b), (d - b) / math.hypot(c - a, d - b)) for a, b, c, d in ticks]
    pairs = []
    for i in range(len(ticks)):
        for j in range(i + 1, len(ticks)):
            dx, dy = mid[j][0] - mid[i][0], mid[j][1] - mid[i][1]
            d2 = dx * dx + dy * dy
            p, q = tan[i][0] * dx + tan[i][1] * dy, tan[j][0] * dx + tan[j][1] * dy
            if r.least**2 <= d2 <= r.gap**2 and abs(tan[i][0] * tan[j][0] + tan[i][1] * tan[j][1]) >= math.cos(math.radians(r.angle)) and min(abs(p), abs(q)) >= r.along * math.sqrt(d2):
                pairs.append((d2, 2 * i + (p > 0), 2 * j + (q < 0)))
    met = {}
    for _, a, b in sorted(pairs):
        if a not in met and b not in met:
            met[a], met[b] = b, a
    out, seen = collections.Counter(), set()
    for start in sorted(range(2 * len(ticks)), key=lambda e: (e ^ 1 in met, e)):
        if start // 2 in seen:
            continue
        chain, e, ring = [], start, False
        while True:
            chain.append(e // 2)
            seen.add(e // 2)
            if e not in met:
                break
            e = met[e] ^ 1
            if e // 2 == chain[0]:
                ring = True
                break
        if ring:
            k = chain.index(min(chain))
            chain = chain[k:] + chain[:k]
            chain = [chain[0], *min(chain[1:], chain[:0:-1])]
        elif chain[0] > chain[-1]:
            chain.reverse()
        out[ring, tuple(chain)] += 1
    return out


def field(seed, n):
    rng = random.Random(seed)
    ticks = []
    for _ in range(n):
        x, y, a = rng.uniform(0, 60), rng.uniform(0, 60), rng.choice([0.3, 0.35, 1.7]) + rng.uniform(-0.3, 0.3)
        ticks.append((x - 1.5 * math.cos(a), y - 1.5 * math.sin(a), x + 1.5 * math.cos(a), y + 1.5 * math.sin(a)))
    # a ring of ticks, some turned round
    for k in range(12):
        a = k * math.pi / 6
        t = (100 + 9 * math.cos(a) - math.sin(a), 9 * math.sin(a) + math.cos(a), 100 + 9 * math.cos(a) + math.sin(a), 9 * math.sin(a) - math.cos(a))
        ticks.append(t if k % 3 else (*t[2:], *t[:2]))
    return ticks


def test_chains_equal_one_by_one(spark):
    ticks = field(3, 160)
    want = greedy(ticks)
    mids = {(round((a + c) / 2, 6), round((b + d) / 2, 6)): i for i, (a, b, c, d) in enumerate(ticks)}
    lines = collections.defaultdict(list)
    for r in C.chained_ticks(table(spark, ticks)).collect():
        lines[r.line_id].append((r.pos, r.x, r.y, r.closed, r.ticks))
    got = collections.Counter()
    for rows in lines.values():
        rows.sort()
        ring, n = rows[0][3], rows[0][4]
        pts = [(x, y) for _, x, y, *_ in rows]
        if n == 1:
            i = next(i for i, (a, b, c, d) in enumerate(ticks) if {(a, b), (c, d)} == set(pts))
            got[False, (i,)] += 1
            continue
        inner = pts[:-1] if ring else pts[1:-1]
        chain = [mids[round(x, 6), round(y, 6)] for x, y in inner]
        if ring:
            assert pts[0] == pts[-1]
            k = chain.index(min(chain))
            chain = chain[k:] + chain[:k]
            chain = [chain[0], *min(chain[1:], chain[:0:-1])]
        else:  # from outer end to outer end
            for end, tick, other in ((pts[0], chain[0], inner[1]), (pts[-1], chain[-1], inner[-2])):
                a, b, c, d = ticks[tick]
                far = max(((a, b), (c, d)), key=lambda p: math.dist(p, other))
                assert math.dist(end, far) < 1e-9
        got[ring, tuple(chain)] += 1
    assert got == want and any(ring for ring, _ in got) and max(len(c) for _, c in got) >= 6


def test_matching_equals_one_by_one(spark):
    rng = random.Random(1)
    pairs = [(a, b, rng.randrange(40)) for a in range(40) for b in range(40, 80) if rng.random() < 0.2]
    used, want = set(), set()
    for c, a, b in sorted((c, a, b) for a, b, c in pairs):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    assert {(r.a, r.b) for r in G.matched(spark.createDataFrame(pairs, "a long, b long, cost long")).collect()} == want
    assert G.matched(spark.createDataFrame([], "a long, b long, cost long")).count() == 0


def test_shapes(spark):
    arc = lambda deg, n, r: [(r * math.cos(math.radians(k * deg / n)), r * math.sin(math.radians(k * deg / n))) for k in range(n + 1)]
    lines = {
        1: ([(0, 0), (30, 1), (60, 0)], True),
        2: (arc(80, 8, 40), True),
        3: (arc(170, 12, 40), False),  # turns too far
        4: ([(0, 0), (20, 0), (20, 20), (10, -10)], False),  # crosses itself
        5: ([(0, 0), (30, 0), (30, 5), (0, 5)], False),  # comes back
        6: ([(k * 5.0, (k % 2) * 6.0) for k in range(12)], False),  # a zigzag
        7: ([(k * 5.0, (k % 2) * 1.0) for k in range(12)], True),  # teeth that are smoothed away
        8: (arc(360, 20, 10), False),
    }
    rows = [(i, k, float(x), float(y)) for i, (pts, _) in lines.items() for k, (x, y) in enumerate(pts)]
    got = {r.line_id: r for r in C.judged(spark.createDataFrame(rows, "line_id long, pos long, x double, y double")).collect()}
    assert {i: r.simple for i, r in got.items()} == {i: ok for i, (_, ok) in lines.items()}
    assert {i for i, r in got.items() if r.crosses} == {4}
    assert abs(got[2].turning - 40) < 1e-6 and abs(got[1].chord - 60) < 1e-9  # the arc is two sides, roughly


def test_rock_areas(spark):
    """A field of ticks is an area, a single wall is none, a wide one is; by the same steps on sets of cells."""
    rng = random.Random(8)
    ticks = [(x, y, x + 2, y + 1) for x, y in ((rng.uniform(0, 25), rng.uniform(0, 20)) for _ in range(120))]
    ticks += [(60 + k * 2.0, 10.0, 62 + k * 2.0, 10.0) for k in range(20)] + [(60 + k * 2.0, 40 + 2.5 * j, 62 + k * 2.0, 40 + 2.5 * j) for k in range(25) for j in range(2)]
    r = C.Rules()
    disk = lambda q: [(i, j) for i in range(-math.floor(q), math.floor(q) + 1) for j in range(-math.floor(q), math.floor(q) + 1) if i * i + j * j <= q * q]
    grow = lambda s, q: {(i + a, j + b) for i, j in s for a, b in disk(q)}
    shrink = lambda s, q: {(i, j) for i, j in s if all((i + a, j + b) in s for a, b in disk(q))}

    def dist(px, py, a, b, c, d):
        t = max(0.0, min(1.0, ((px - a) * (c - a) + (py - b) * (d - b)) / ((c - a) ** 2 + (d - b) ** 2)))
        return math.hypot(px - a - t * (c - a), py - b - t * (d - b))

    s = {(i, j) for a, b, c, d in ticks for i in range(math.floor(min(b, d)) - 4, math.floor(max(b, d)) + 5) for j in range(math.floor(min(a, c)) - 4, math.floor(max(a, c)) + 5) if dist(j + 0.5, i + 0.5, a, b, c, d) <= r.buffer}
    s = shrink(grow(s, r.close), r.close)
    s = grow(shrink(s, r.open), r.open)
    s = shrink(grow(shrink(s, r.shrink), r.smooth), r.smooth)
    parts, seen = [], set()
    for start in s:
        if start in seen:
            continue
        part, todo = {start}, [start]
        while todo:
            i, j = todo.pop()
            for n in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if n in s and n not in part:
                    part.add(n)
                    todo.append(n)
        seen |= part
        best = min(((round((max(u) - min(u) + 1) * (max(v) - min(v) + 1), 6), d, max(u) - min(u) + 1, max(v) - min(v) + 1) for d in range(0, 90, 5) for c, q in [(math.cos(math.radians(d)), math.sin(math.radians(d)))] for u, v in [([(j + 0.5) * c + (i + 0.5) * q for i, j in part], [(i + 0.5) * c - (j + 0.5) * q for i, j in part])]))
        parts.append((len(part), min(best[2:]), max(best[2:]), frozenset(part)))
    kept = [p for p in parts if not (p[2] > r.aspect * p[1] and p[1] < r.aspect_width)]
    cells, facts, left = C.rock_areas(table(spark, ticks))
    got = collections.defaultdict(set)
    for c in cells.collect():
        got[c.area].add((c.rr, c.cc))
    assert {frozenset(v) for v in got.values()} == {p[3] for p in kept} and len(kept) >= 1
    assert sorted((f.cells, round(f.width, 6), round(f.length, 6)) for f in facts.collect()) == sorted((n, round(w, 6), round(h, 6)) for n, w, h, _ in kept)
    halo = grow(set().union(*(p[3] for p in kept)), r.halo)
    assert {t.id for t in left.collect()} == {i for i, (a, b, c, d) in enumerate(ticks) if (math.floor((b + d) / 2), math.floor((a + c) / 2)) not in halo}


def test_queries(spark, sf):
    """Chains of all step cells of the table, one by one; areas have the cells of the operator."""
    from geoloom.plans import cliffs as Q

    rows = {r.id: (r.ax, r.ay, r.bx, r.by) for r in C.distinct_ticks(Q.ticks(spark, sf)).collect()}
    ids = sorted(rows)
    want = collections.Counter((ring, len(c), ids[c[-1]] if not ring else None) for (ring, c), n in greedy([rows[i] for i in ids]).items() for _ in range(n))
    got = Q.grf16_cliff_lines(spark, sf).collect()
    assert collections.Counter((r.closed, r.ticks, r.last_tick if not r.closed else None) for r in got) == want and len(ids) > 50
    areas = Q.grf17_rock_areas(spark, sf).collect()
    assert sum(r.cells for r in areas) == C.rock_areas(Q.ticks(spark, sf))[0].count() and len(areas) > 0


def test_distinct_ticks_and_none(spark):
    ticks = [(0, 0, 3, 0), (0.1, 0.1, 3.1, 0.1), (3, 0, 0, 0), (0, 0, 0, 3), (5, 5, 5, 5), (20, 0, 23, 0)]
    assert {r.id for r in C.distinct_ticks(table(spark, ticks)).collect()} == {0, 3, 5}
    assert C.chained_ticks(table(spark, ticks).where("id < 0")).count() == 0
    assert C.rock_areas(table(spark, ticks).where("id < 0"))[0].count() == 0
