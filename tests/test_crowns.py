"""Regions' properties, and crowns on paved ground, against plain loops over a small raster."""

import math
import random

from geoloom.operators import crowns as C

R = C.Rules()
CELLS = "rr long, cc long, h double, green boolean, building boolean, water boolean"


def components(cells):
    left, out = set(cells), []
    while left:
        todo, found = [min(left)], set()
        while todo:
            p = todo.pop()
            if p in left:
                left.discard(p)
                found.add(p)
                todo += [(p[0] + a, p[1] + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]
        out.append(found)
    return out


def disk(r):
    return [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r]


def grown(cells, offsets):
    return {(r + a, c + b) for r, c in cells for a, b in offsets}


def brute(rows, existing, size, extent):
    h = {(r, c): v or 0.0 for r, c, v, *_ in rows}
    green, building, water = ({(x[0], x[1]) for x in rows if x[k]} for k in (3, 4, 5))
    near = grown(green, disk(C.steps(R.green_reach, size)))
    veg = {p for p, v in h.items() if v > R.tall and p not in building and p in near}
    grey = {p for p, v in h.items() if v > R.other and p not in building and p not in near}
    d = disk(C.steps(R.mass, size))
    mass = grown({p for p in grey if all((p[0] + a, p[1] + b) in grey for a, b in d)}, d)
    other = {p for p, v in h.items() if v > R.other and p not in building and (p in near or p in mass)}
    inside = lambda p: extent[0] <= p[0] < extent[2] and extent[1] <= p[1] < extent[3]
    k, out = C.steps(R.around, size), set()
    for own in components(veg):
        area = len(own) * size * size
        rr, cc = [p[0] for p in own], [p[1] for p in own]
        longest = (max(max(rr) - min(rr), max(cc) - min(cc)) + 1) * size
        if not R.least <= area <= R.most or max(h[p] for p in own) < R.top or area / (math.pi * (longest / 2) ** 2) < R.compact:
            continue
        ring = {p for p in grown(own, C.diamond(k)) - grown(own, C.diamond(1)) if inside(p)}
        if ring and len(ring & other) / len(ring) > R.around_share:
            continue
        x, y = (sum(cc) / len(cc) + 0.5) * size, (sum(rr) / len(rr) + 0.5) * size
        if any(math.dist((x, y), e) <= R.existing for e in existing):
            continue
        rad = math.sqrt(area / math.pi)
        reach = int(3 * rad / size) + 2
        cells = [(r, c) for r in range(int(y / size) - reach, int(y / size) + reach) for c in range(int(x / size) - reach, int(x / size) + reach) if inside((r, c))]
        q = {p: math.hypot((p[1] + 0.5) * size - x, (p[0] + 0.5) * size - y) / rad for p in cells}
        crown = [p in green for p in cells if q[p] <= 0.7]
        ground = [p in green for p in cells if 1.6 < q[p] <= 3 and p not in building and p not in water]
        if crown and ground and sum(crown) / len(crown) >= R.crown_green and sum(ground) / len(ground) < R.ground_green:
            out.add((round(x, 6), round(y, 6), area))
    return out


def found(df):
    return {(round(r["x"], 6), round(r["y"], 6), r["area"]) for r in df.collect()}


def test_crowns(spark):
    rng = random.Random(12)
    cells = {}
    for n in range(45):
        r0, c0, rad, top, leafy = rng.randrange(2, 118), rng.randrange(2, 118), rng.uniform(1.2, 5), rng.uniform(3, 12), rng.random() < 0.8
        for a, b in disk(6):
            if math.hypot(a, b) <= rad:
                cells[r0 + a, c0 + b] = [top * (1 - math.hypot(a, b) / 12), leafy, False, False]
    for name, count in ((1, 6), (2, 4), (3, 3)):  # lawns, buildings, water
        for _ in range(count):
            r0, c0 = rng.randrange(110), rng.randrange(110)
            for a in range(9):
                for b in range(6):
                    cells.setdefault((r0 + a, c0 + b), [None, False, False, False])[name] = True
    rows = [(r, c, *v) for (r, c), v in cells.items()] + [(3000, 5, None, None, None, None)]
    existing = [(30.0, 30.0), (80.0, 75.0)]
    extent = (0, 0, 120, 120)
    want = brute(rows, existing, 1.0, extent)
    trees = spark.createDataFrame(existing, "x double, y double")
    assert found(C.paved_trees(spark.createDataFrame(rows, CELLS), trees, 1.0, extent)) == want
    assert 3 < len(want) < 40
    assert C.paved_trees(spark.createDataFrame([], CELLS), trees, 1.0, extent).count() == 0


def test_properties(spark):
    shape = {(0, 0), (0, 1), (0, 2), (0, 3), (5, 5), (5, 6), (6, 5), (6, 6), (6, 7)}
    label = C.labelled(spark.createDataFrame([(r, c, float(r + c)) for r, c in shape], "rr long, cc long, v double"), "v")
    got = {tuple(r["region"]): r for r in C.properties(label, 2.0, "v").collect()}
    line, blob = got[0, 0], got[5, 5]
    assert (line["cells"], line["area"], line["perimeter"], line["x"], line["y"]) == (4, 16.0, 20.0, 4.0, 1.0)
    assert math.isclose(line["compact"], 4 / (math.pi * 4)) and math.isclose(line["elongation"], 4.0)
    assert (blob["cells"], blob["perimeter"], blob["highest"], blob["median"]) == (5, 20.0, 13.0, 11.0)
    ring = {(r["rr"], r["cc"]) for r in C.rings(label, 2, (0, 0, 50, 50)).collect() if tuple(r["region"]) == (0, 0)}
    own = {p for p in shape if p[0] == 0}
    assert ring == {p for p in grown(own, C.diamond(2)) - grown(own, C.diamond(1)) if min(p) >= 0}


def test_query(spark, sf):
    from geoloom.plans import tidying as Q

    cells, existing, extent = Q.crown_inputs(spark, sf)
    want = brute([tuple(r) for r in cells.select("rr", "cc", "h", "green", "building", "water").collect()], [(r["x"], r["y"]) for r in existing.collect()], 1.0, extent)
    assert found(Q.ras41_paved_trees(spark, sf)) == want and len(want) > 3
