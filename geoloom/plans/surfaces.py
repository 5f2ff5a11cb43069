"""Queries that refine class rasters and surfaces, and areas as cell sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import cellsets, focal, grid
from geoloom.operators import graph as G
from geoloom.plans.raster import _GRAD, _cells, _dense, _morph
from geoloom.plans.raster import SQL as RASTER_SQL
from geoloom.plans.raster import ras26_step_cells
from geoloom.sources import tables as T

WHITE, OPEN, LIGHT, MID, DENSE = 0, 1, 2, 3, 4
STEPS = (12.0, 18.0, 20.0, 22.0)
# Height (m) and colour (red, green, blue, opacity) of the canopy ramp's stops.
RAMP = ((0.0, (255, 255, 255, 0)), (4.0, (214, 240, 190, 90)), (10.0, (120, 198, 121, 150)), (18.0, (35, 132, 67, 200)), (26.0, (0, 69, 41, 255)))


def _classes(spark, d):
    """Dense cells with class ``cls`` (white where nothing is known) and canopy ``chm``."""
    return _dense(spark, d).select("rr", "cc", "valid", "chm", "dem", F.when(F.col("valid"), grid.ladder(F.col("chm"), STEPS)).otherwise(WHITE).cast("long").alias("cls"))


def _share(cells, condition, radius, out):
    """Share of the window's cells (as far as the grid goes) that meet a condition."""
    return focal.box_mean(cells.withColumn("__m", F.coalesce(condition, F.lit(False)).cast("int")), radius, "__m", out).drop("__m")


def class_median(cells, radius, cls="cls", out="median"):
    """Median class (the lower one of two) of small class numbers, exact: the window's counts are summed as digits of one number."""
    digits = 12  # counts below 4096, so radius 31 at most and five classes
    packed = focal.box(cells.withColumn("__p", F.expr(f"shiftleft(1L, cast({cls} * {digits} as int))")), radius, "sum", "__p", "__s")
    count = lambda k: F.expr(f"shiftright(__s, {k * digits}) & {(1 << digits) - 1}")
    total = sum((count(k) for k in range(1, 5)), count(0))
    value, so_far = F.lit(4), None
    steps = []
    for k in range(4):
        so_far = count(k) if so_far is None else so_far + count(k)
        steps.append((k, so_far))
    for k, c in reversed(steps):
        value = F.when(2 * c >= total, k).otherwise(value)
    return packed.withColumn(out, value.cast("long")).drop("__p", "__s")


def ras04_class_median(spark, d):
    return class_median(_classes(spark, d), 2).select("rr", "cc", "median")


def ras11_canopy_ramp(spark, d):
    """Colour of each cell's canopy height, between the ramp's stops."""
    h = F.greatest(F.lit(RAMP[0][0]), F.least(F.col("chm"), F.lit(RAMP[-1][0])))

    def channel(i):
        value = F.lit(RAMP[-1][1][i]).cast("double")
        for (a, ca), (b, cb) in reversed(list(zip(RAMP, RAMP[1:]))):
            value = F.when(h < b, ca[i] + (h - a) / (b - a) * (cb[i] - ca[i])).otherwise(value)
        return F.floor(value + 0.5).cast("long")

    return _cells(spark, d).select("rr", "cc", *(channel(i).alias(n) for i, n in enumerate(("red", "green", "blue", "opacity"))))


def ras13_reclaimed_open(spark, d):
    """White cells among open ones (55 %) are open."""
    s = _share(_classes(spark, d), F.col("cls") == OPEN, 1, "share")
    return s.select("rr", "cc", F.when((F.col("cls") == WHITE) & (F.col("share") >= 0.55), OPEN).otherwise(F.col("cls")).cast("long").alias("cls"))


def ras14_open_veto(spark, d):
    """Open cells under a median canopy (5 x 5 cells) of 14 m and more are white."""
    c = _classes(spark, d)
    around = focal.shifted(c.select("rr", "cc", F.coalesce("chm", F.lit(0.0)).alias("h")), [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3)])
    median = around.groupBy("rr", "cc").agg(F.expr("percentile(h, 0.5)").alias("h"))
    return c.join(median, ["rr", "cc"]).select("rr", "cc", F.when((F.col("cls") == OPEN) & (F.col("h") >= 14), WHITE).otherwise(F.col("cls")).cast("long").alias("cls"))


def ras15_open_reinforced(spark, d):
    """White cells of low canopy among low ones (30 % of 5 x 5) are open."""
    c = _classes(spark, d)
    low = F.coalesce(F.col("chm") < 23, F.lit(False))
    s = focal.box(c.withColumn("__m", low.cast("long")), 2, "sum", "__m", "hits")
    return s.select("rr", "cc", F.when((F.col("cls") == WHITE) & low & (F.col("hits") / 25.0 >= 0.3), OPEN).otherwise(F.col("cls")).cast("long").alias("cls"))


def ras16_softened_edge(spark, d):
    """White cells below 23.5 m beside open ones (12 %) become open, in two passes."""
    c = _classes(spark, d)
    for _ in range(2):
        s = _share(c, F.col("cls") == OPEN, 1, "share")
        c = s.withColumn("cls", F.when((F.col("cls") == WHITE) & (F.col("share") >= 0.12) & (F.col("chm") < 23.5), OPEN).otherwise(F.col("cls")).cast("long")).drop("share")
    return c.select("rr", "cc", "cls")


def ras18_canopy_classes(spark, d):
    """Height classes, median of 3 x 3, scrub in meadows opened, and white forest cleaned: opened by one cell, with a stricter edge to open land."""
    c = class_median(_classes(spark, d), 1).withColumn("cls", F.when(F.col("valid"), F.col("median")).otherwise(WHITE)).drop("median")
    s = _share(c, F.col("cls") == OPEN, 1, "share")
    pull = ((F.col("cls") == LIGHT) & (F.col("chm") < STEPS[2]) & (F.col("share") >= 0.45)) | ((F.col("cls") == MID) & (F.col("chm") < STEPS[1]) & (F.col("share") >= 0.6))
    c = s.withColumn("cls", F.when(F.coalesce(F.col("valid") & pull, F.lit(False)), OPEN).otherwise(F.col("cls"))).drop("share")
    c = c.withColumn("white", F.coalesce(F.col("valid") & (F.col("cls") == WHITE) & (F.col("chm") >= STEPS[3]), F.lit(False)))
    c = focal.opened(c, 1, "white", "clean")
    cross = focal.shifted(c.where(F.col("cls") == OPEN).select("rr", "cc"), [(0, 1), (1, 0), (0, -1), (-1, 0)]).select("rr", "cc").distinct().withColumn("touch", F.lit(True))
    c = _share(c, F.col("cls") == OPEN, 1, "share").join(cross, ["rr", "cc"], "left")
    keep = F.col("clean") & (F.col("touch").isNull() | (F.col("chm") >= 23))
    demoted = F.col("white") & ~keep
    return c.select("rr", "cc", F.when(demoted, F.when(F.col("share") >= 0.5, OPEN).otherwise(DENSE)).otherwise(F.col("cls")).cast("long").alias("cls"))


def ras20_understory(spark, d):
    """Cells with 15 % of low layer in 7 x 7 cells and 60 % of forest in 9 x 9."""
    c = _dense(spark, d).withColumn("h", F.coalesce("chm", F.lit(0.0)))
    s = _share(_share(c, F.col("h").between(1.0, 17.99), 3, "low"), F.col("h") > 19.0, 4, "forest")
    return s.where("low >= 0.15 and forest >= 0.6").select("rr", "cc")


def ras23_leafoff_mask(spark, d):
    """Forest areas less cover of other kinds, with the canopy there."""
    r = T.rects(spark, d)
    forest = cellsets.box_cells(r.where("kind in ('HOUSEHOLD', 'FURNITURE')"), T.CELL_M).distinct()
    other = cellsets.box_cells(r.where("kind in ('BUILDING', 'AUTOMOBILE')"), T.CELL_M)
    return cellsets.minus(forest, other).join(_cells(spark, d).select("rr", "cc", "chm"), ["rr", "cc"], "left")


def ras25_smoothed_terrain(spark, d):
    """Terrain averaged over 3 x 3 cells, then over blocks of 2 x 2, and read back between the blocks' centres."""
    m = focal.box_mean(_dense(spark, d).withColumn("v", F.col("dem")), 1)
    block = grid.blocks(m, 2, F.avg("mean").alias("b"))
    at = m.select("rr", "cc", ((F.col("rr") + 0.5) / 2 - 0.5).alias("fy"), ((F.col("cc") + 0.5) / 2 - 0.5).alias("fx"))
    corner = F.explode(F.array(*(F.struct((F.floor("fy") + a).alias("br"), (F.floor("fx") + b).alias("bc")) for a in (0, 1) for b in (0, 1)))).alias("k")
    four = at.select("rr", "cc", "fy", "fx", corner).select("rr", "cc", "fy", "fx", "k.br", "k.bc")
    w = (1 - F.abs(F.col("br") - F.col("fy"))) * (1 - F.abs(F.col("bc") - F.col("fx")))
    return four.join(block, ["br", "bc"]).groupBy("rr", "cc").agg(F.round(F.sum(w * F.col("b")) / F.sum(F.when(F.col("b").isNotNull(), w)) + 1e-7, 5).alias("dem"))


def ras35_offset_plane(spark, d):
    """Terrain less a vertical offset that is known at the four corners."""
    nw, ne, sw, se = 44.10, 44.32, 43.95, 44.25
    u, v = (F.col("cc") + 0.5) / 100.0, (F.col("rr") + 0.5) / 100.0
    offset = (sw * (1 - u) + se * u) * (1 - v) + (nw * (1 - u) + ne * u) * v
    return _cells(spark, d).select("rr", "cc", F.round(F.col("dem") - offset, 6).alias("dem"))


def ras36_snapped_bounds(spark, d):
    """Bounds of areas snapped outward to a 4 m grid, with its pixels and the pixel of the centre."""
    s = lambda c, f: f(F.col(c) / 4.0) * 4.0
    r = T.rects(spark, d).select("fid", s("x0", F.floor).alias("west"), s("y0", F.floor).alias("south"), s("x1", F.ceil).alias("east"), s("y1", F.ceil).alias("north"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    return r.select("fid", "west", "south", "east", "north", ((F.col("east") - F.col("west")) / 4).cast("long").alias("cols"), ((F.col("north") - F.col("south")) / 4).cast("long").alias("rows"), F.floor((F.col("x") - F.col("west")) / 4).alias("px"), F.floor((F.col("north") - F.col("y")) / 4).alias("py"))


def ras37_tidal_zone(spark, d):
    """Low, bare and flat cells that are connected to the sea over such cells."""
    g = focal.gradient(_dense(spark, d).withColumn("v", F.col("dem")), T.CELL_M)
    sea = cellsets.box_cells(T.rects(spark, d).where("kind = 'AUTOMOBILE' and lvl = -1"), T.CELL_M).distinct()
    steep = F.coalesce(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2), F.lit(0.0))
    low = cellsets.minus(g.where((F.col("dem") <= 502.0) & (F.col("chm") < 24.3) & (steep < 0.6)).select("rr", "cc"), sea)
    ident = F.col("rr") * 1000 + F.col("cc")
    all_cells = low.unionByName(sea.where("rr between 0 and 99 and cc between 0 and 99")).withColumn("a", ident)
    links = focal.shifted(all_cells, [(0, 1), (1, 0)]).drop("dy", "dx").join(all_cells.select("rr", "cc", F.col("a").alias("b")), ["rr", "cc"]).select("a", "b")
    live = G.reachable(all_cells.select(F.col("a").alias("id")), links, sea.select(ident.alias("id")))
    return low.withColumn("id", ident).join(live, "id", "left_semi").select("rr", "cc")


def ras39_green_pixels(spark, d):
    """Greenness of pixels by excess green and saturation."""
    e = lambda k: 1 / (1 + F.exp(-F.col("embedding")[k].cast("double") * 4))
    c = T.table(spark, d, "embeddings").select("vec_id", e(0).alias("r"), e(1).alias("g"), e(2).alias("b"))
    exg = (2 * F.col("g") - F.col("r") - F.col("b")) / (F.col("r") + F.col("g") + F.col("b"))
    sat = 1 - F.least("r", "g", "b") / F.greatest("r", "g", "b")
    return c.select("vec_id", F.round(exg, 6).alias("exg"), F.round(sat, 6).alias("saturation"), ((exg >= 0.02) & (sat >= 0.12)).alias("green"))


def ras47_step_zone(spark, d):
    """Step cells grown by a disk of 2 cells, for operators that keep clear of them."""
    return focal.disk_dilate(ras26_step_cells(spark, d), 2.0).where("rr between 0 and 99 and cc between 0 and 99").select("rr", "cc")


def set03_trimmed_class(spark, d):
    """Cells of the open class that no other source draws."""
    return cellsets.minus(_classes(spark, d).where(F.col("cls") == OPEN).select("rr", "cc"), cellsets.box_cells(T.rects(spark, d), T.CELL_M))


def set06_apart_from_roads(spark, d):
    """Sidewalks at least a cell away from roads; what is left of each."""
    r = T.rects(spark, d)
    walk = cellsets.box_cells(r.where("kind = 'FURNITURE'"), T.CELL_M, "fid")
    road = focal.disk_dilate(cellsets.box_cells(r.where("kind = 'BUILDING'"), T.CELL_M).distinct(), 1.0)
    return cellsets.minus(walk, road).groupBy("fid").agg(F.count("*").alias("cells"))


def set08_generalised(spark, d):
    """Areas closed and opened by a cell, and of what is left the connected parts of 12 cells and more."""
    own = cellsets.box_cells(T.rects(spark, d).where("kind = 'FURNITURE'"), T.CELL_M).distinct().withColumn("v", F.lit(True))
    dense = grid.grid_dimension(spark, 110, 110).join(own, ["rr", "cc"], "left").withColumn("v", F.coalesce("v", F.lit(False)))
    left = focal.opened(focal.closed(dense, 1, "v", "c"), 1, "c", "o").where("o").select("rr", "cc")
    parts = G.regions(left, 1000)
    size = parts.groupBy("component").agg(F.count("*").alias("cells")).where("cells >= 12")
    return parts.join(size, "component").select("rr", "cc", "cells")


def set11_water_under_bridges(spark, d):
    """Water cut where a bridge passes above it."""
    r = T.rects(spark, d)
    water = cellsets.box_cells(r.where("kind = 'HOUSEHOLD' and lvl < 1"), T.CELL_M, "fid")
    return cellsets.minus(water, cellsets.box_cells(r.where("lvl = 1"), T.CELL_M)).groupBy("fid").agg(F.count("*").alias("cells"))


def top04_capped_steps(spark, d):
    """The first 200 step cells by row and column."""
    return ras26_step_cells(spark, d).select("rr", "cc").orderBy("rr", "cc").limit(200)


def pip01_surfaces(spark, d):
    """Point cloud to terrain, surface and canopy: mean ground and highest hit a cell, gaps of the terrain filled from valid cells within 2 cells by inverse distance, canopy not below zero."""
    s = grid.densify(grid.terrain_surface(T.points(spark, d), T.CELL_M), 100, 100)
    moved = focal.shifted(s.where("terrain is not null").select("rr", "cc", "terrain"), [o for o in focal.disk(2) if o != (0, 0)])
    w = 1.0 / (F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx"))
    guess = moved.groupBy("rr", "cc").agg((F.sum(F.col("terrain") * w) / F.sum(w)).alias("guess"))
    full = s.join(guess, ["rr", "cc"], "left").withColumn("dem", F.coalesce("terrain", "guess"))
    return full.select("rr", "cc", F.round(F.col("dem") + 1e-7, 5).alias("dem"), F.col("surface").alias("dsm"), F.round(F.greatest(F.coalesce("surface", "dem") - F.col("dem"), F.lit(0.0)) + 1e-7, 5).alias("chm"))


_CR = "cr AS (SELECT rr, cc, valid, chm, dem, CASE WHEN NOT valid THEN 0 WHEN chm < 12 THEN 1 WHEN chm < 18 THEN 2 WHEN chm < 20 THEN 3 WHEN chm < 22 THEN 4 ELSE 0 END AS cls FROM fx_dense)"
_W = "n.rr BETWEEN c.rr - {k} AND c.rr + {k} AND n.cc BETWEEN c.cc - {k} AND c.cc + {k}"


def _fraction(src, name, k=1, what="n.cls = 1"):
    return f"{name} AS (SELECT c.rr, c.cc, avg(CASE WHEN {what} THEN 1 ELSE 0 END) AS share FROM {src} c JOIN {src} n ON {_W.format(k=k)} GROUP BY 1, 2)"


def _soften(src, share, out):
    return f"{_fraction(src, share)}, {out} AS (SELECT c.rr, c.cc, c.chm, CASE WHEN cls = 0 AND share >= 0.12 AND chm < 23.5 THEN 1 ELSE cls END AS cls FROM {src} c JOIN {share} s ON s.rr = c.rr AND s.cc = c.cc)"


def _ramp(i):
    stops = list(zip(RAMP, RAMP[1:]))
    cases = " ".join(f"WHEN least(chm, {RAMP[-1][0]}) < {b} THEN {ca[i]} + (greatest(chm, 0) - {a}) / {b - a} * ({cb[i] - ca[i]})" for (a, ca), (b, cb) in stops)
    return f"CAST(floor(CASE {cases} ELSE {RAMP[-1][1][i]} END + 0.5) AS BIGINT)"


_GRIDC = "g AS (SELECT r.range AS rr, k.range AS cc, (r.range + 0.5::DOUBLE) * 4 AS y, (k.range + 0.5::DOUBLE) * 4 AS x FROM range(0, 120) r, range(0, 120) k), rc AS (SELECT rr, cc, fid, kind, lvl FROM g JOIN fx_rects q ON g.x >= q.x0 AND g.x < q.x1 AND g.y >= q.y0 AND g.y < q.y1)"

SQL = {
    "ras04_class_median": f"WITH {_CR} SELECT c.rr, c.cc, CAST(quantile_disc(n.cls, 0.5) AS BIGINT) AS median FROM cr c JOIN cr n ON {_W.format(k=2)} GROUP BY 1, 2",
    "ras11_canopy_ramp": f"SELECT rr, cc, {_ramp(0)} AS red, {_ramp(1)} AS green, {_ramp(2)} AS blue, {_ramp(3)} AS opacity FROM fx_cells",
    "ras13_reclaimed_open": f"WITH {_CR}, {_fraction('cr', 's')} SELECT cr.rr, cr.cc, CASE WHEN cls = 0 AND share >= 0.55 THEN 1 ELSE cls END AS cls FROM cr JOIN s ON s.rr = cr.rr AND s.cc = cr.cc",
    "ras14_open_veto": f"WITH {_CR}, m AS (SELECT c.rr, c.cc, quantile_cont(coalesce(n.chm, 0), 0.5) AS h FROM cr c JOIN cr n ON {_W.format(k=2)} GROUP BY 1, 2) SELECT cr.rr, cr.cc, CASE WHEN cls = 1 AND h >= 14 THEN 0 ELSE cls END AS cls FROM cr JOIN m ON m.rr = cr.rr AND m.cc = cr.cc",
    "ras15_open_reinforced": f"WITH {_CR}, m AS (SELECT c.rr, c.cc, sum(CASE WHEN n.chm < 23 THEN 1 ELSE 0 END) AS hits FROM cr c JOIN cr n ON {_W.format(k=2)} GROUP BY 1, 2) SELECT cr.rr, cr.cc, CASE WHEN cls = 0 AND chm < 23 AND hits/25.0 >= 0.3 THEN 1 ELSE cls END AS cls FROM cr JOIN m ON m.rr = cr.rr AND m.cc = cr.cc",
    "ras16_softened_edge": f"WITH {_CR}, {_soften('cr', 's1', 'c1')}, {_soften('c1', 's2', 'c2')} SELECT rr, cc, cls FROM c2",
    "ras18_canopy_classes": f"""WITH {_CR}, a AS (SELECT c.rr, c.cc, c.valid, c.chm, CASE WHEN c.valid THEN quantile_disc(n.cls, 0.5) ELSE 0 END AS cls FROM cr c JOIN cr n ON {_W.format(k=1)} GROUP BY 1, 2, 3, 4), {_fraction('a', 's')},
      b AS (SELECT a.rr, a.cc, valid, chm, CASE WHEN valid AND ((cls = 2 AND chm < 20 AND share >= 0.45) OR (cls = 3 AND chm < 18 AND share >= 0.6)) THEN 1 ELSE cls END AS cls FROM a JOIN s ON s.rr = a.rr AND s.cc = a.cc),
      wh AS (SELECT rr, cc, CASE WHEN valid AND cls = 0 AND chm >= 22 THEN 1 ELSE 0 END AS v FROM b), {_morph('min', 'wh', 'we')}, {_morph('max', 'we', 'wo')}, {_fraction('b', 's2')}
      SELECT b.rr, b.cc, CAST(CASE WHEN wh.v = 1 AND NOT (wo.v = 1 AND (NOT EXISTS (SELECT 1 FROM b n WHERE n.cls = 1 AND abs(n.rr-b.rr) + abs(n.cc-b.cc) = 1) OR chm >= 23)) THEN CASE WHEN share >= 0.5 THEN 1 ELSE 4 END ELSE cls END AS BIGINT) AS cls
      FROM b JOIN wh ON wh.rr = b.rr AND wh.cc = b.cc JOIN wo ON wo.rr = b.rr AND wo.cc = b.cc JOIN s2 ON s2.rr = b.rr AND s2.cc = b.cc""",
    "ras20_understory": f"WITH h AS (SELECT rr, cc, coalesce(chm, 0) AS h FROM fx_dense), {_fraction('h', 'l', 3, 'n.h BETWEEN 1.0 AND 17.99')}, {_fraction('h', 'f', 4, 'n.h > 19')} SELECT l.rr, l.cc FROM l JOIN f ON f.rr = l.rr AND f.cc = l.cc WHERE l.share >= 0.15 AND f.share >= 0.6",
    "ras23_leafoff_mask": f"WITH {_GRIDC}, m AS (SELECT rr, cc FROM rc WHERE kind IN ('HOUSEHOLD', 'FURNITURE') EXCEPT SELECT rr, cc FROM rc WHERE kind IN ('BUILDING', 'AUTOMOBILE')) SELECT m.rr, m.cc, chm FROM m LEFT JOIN fx_cells c ON c.rr = m.rr AND c.cc = m.cc",
    "ras25_smoothed_terrain": f"WITH m AS (SELECT c.rr, c.cc, avg(n.dem) AS v FROM fx_dense c JOIN fx_dense n ON {_W.format(k=1)} GROUP BY 1, 2), b AS (SELECT rr // 2 AS br, cc // 2 AS bc, avg(v) AS b FROM m GROUP BY 1, 2) SELECT m.rr, m.cc, round(sum((1-abs(br-((m.rr+0.5)/2-0.5)))*(1-abs(bc-((m.cc+0.5)/2-0.5)))*b) / sum(CASE WHEN b IS NOT NULL THEN (1-abs(br-((m.rr+0.5)/2-0.5)))*(1-abs(bc-((m.cc+0.5)/2-0.5))) END) + 1e-7, 5) AS dem FROM m JOIN b ON br BETWEEN floor((m.rr+0.5)/2-0.5) AND floor((m.rr+0.5)/2-0.5)+1 AND bc BETWEEN floor((m.cc+0.5)/2-0.5) AND floor((m.cc+0.5)/2-0.5)+1 GROUP BY 1, 2",
    "ras35_offset_plane": "SELECT rr, cc, round(dem - ((43.95*(1-(cc+0.5::DOUBLE)/100) + 44.25*(cc+0.5::DOUBLE)/100)*(1-(rr+0.5::DOUBLE)/100) + (44.10*(1-(cc+0.5::DOUBLE)/100) + 44.32*(cc+0.5::DOUBLE)/100)*(rr+0.5::DOUBLE)/100), 6) AS dem FROM fx_cells",
    "ras36_snapped_bounds": "WITH s AS (SELECT fid, floor(x0/4)*4 AS west, floor(y0/4)*4 AS south, ceil(x1/4)*4 AS east, ceil(y1/4)*4 AS north, (x0+x1)/2 AS x, (y0+y1)/2 AS y FROM fx_rects) SELECT fid, west, south, east, north, CAST((east-west)/4 AS BIGINT) AS cols, CAST((north-south)/4 AS BIGINT) AS rows, CAST(floor((x-west)/4) AS BIGINT) AS px, CAST(floor((north-y)/4) AS BIGINT) AS py FROM s",
    "ras37_tidal_zone": f"WITH RECURSIVE {_GRAD}, {_GRIDC.replace('g AS', 'gg AS').replace('FROM g JOIN', 'FROM gg g JOIN')}, sea AS (SELECT DISTINCT rr, cc FROM rc WHERE kind = 'AUTOMOBILE' AND lvl = -1), low AS (SELECT d.rr, d.cc FROM fx_dense d JOIN g ON g.rr = d.rr AND g.cc = d.cc WHERE dem <= 502 AND chm < 24.3 AND coalesce(sqrt(gx*gx+gy*gy), 0) < 0.6 EXCEPT SELECT rr, cc FROM sea), al AS (SELECT rr, cc FROM low UNION SELECT rr, cc FROM sea WHERE rr BETWEEN 0 AND 99 AND cc BETWEEN 0 AND 99), f(rr, cc) AS (SELECT rr, cc FROM sea WHERE rr BETWEEN 0 AND 99 AND cc BETWEEN 0 AND 99 UNION SELECT a.rr, a.cc FROM f JOIN al a ON abs(a.rr-f.rr) + abs(a.cc-f.cc) = 1) SELECT low.rr, low.cc FROM low JOIN f ON f.rr = low.rr AND f.cc = low.cc",
    "ras39_green_pixels": "WITH c AS (SELECT vec_id, 1/(1+exp(-CAST(embedding[1] AS DOUBLE)*4)) AS r, 1/(1+exp(-CAST(embedding[2] AS DOUBLE)*4)) AS g, 1/(1+exp(-CAST(embedding[3] AS DOUBLE)*4)) AS b FROM embeddings) SELECT vec_id, round((2*g-r-b)/(r+g+b), 6) AS exg, round(1-least(r,g,b)/greatest(r,g,b), 6) AS saturation, (2*g-r-b)/(r+g+b) >= 0.02 AND 1-least(r,g,b)/greatest(r,g,b) >= 0.12 AS green FROM c",
    "ras47_step_zone": f"WITH st AS ({RASTER_SQL['ras26_step_cells']}) SELECT DISTINCT d.rr, d.cc FROM fx_dense d JOIN st s ON (d.rr-s.rr)*(d.rr-s.rr) + (d.cc-s.cc)*(d.cc-s.cc) <= 4",
    "set03_trimmed_class": f"WITH {_CR}, {_GRIDC} SELECT rr, cc FROM cr WHERE cls = 1 EXCEPT SELECT rr, cc FROM rc",
    "set06_apart_from_roads": f"WITH {_GRIDC}, b AS (SELECT DISTINCT rr, cc FROM rc WHERE kind = 'BUILDING') SELECT fid, count(*) AS cells FROM rc WHERE kind = 'FURNITURE' AND NOT EXISTS (SELECT 1 FROM b WHERE abs(b.rr-rc.rr) + abs(b.cc-rc.cc) <= 1) GROUP BY 1",
    "set08_generalised": f"WITH RECURSIVE {_GRIDC}, m AS (SELECT gd.rr, gd.cc, CASE WHEN EXISTS (SELECT 1 FROM rc WHERE kind = 'FURNITURE' AND rc.rr = gd.rr AND rc.cc = gd.cc) THEN 1 ELSE 0 END AS v FROM g gd WHERE gd.rr < 110 AND gd.cc < 110), {_morph('max', 'm', 'k1')}, {_morph('min', 'k1', 'k2')}, {_morph('min', 'k2', 'k3')}, {_morph('max', 'k3', 'k4')}, c AS (SELECT rr, cc, rr*1000 + cc AS id FROM k4 WHERE v = 1), l AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON abs(a.rr-b.rr) + abs(a.cc-b.cc) = 1), f(root, id) AS (SELECT id, id FROM c UNION SELECT f.root, l.b FROM f JOIN l ON f.id = l.a AND l.b > f.root), q AS (SELECT id, min(root) AS component FROM f GROUP BY 1), z AS (SELECT component, count(*) AS cells FROM q GROUP BY 1) SELECT c.rr, c.cc, z.cells FROM c JOIN q ON q.id = c.id JOIN z ON z.component = q.component WHERE z.cells >= 12",
    "set11_water_under_bridges": f"WITH {_GRIDC}, b AS (SELECT DISTINCT rr, cc FROM rc WHERE lvl = 1) SELECT fid, count(*) AS cells FROM rc WHERE kind = 'HOUSEHOLD' AND lvl < 1 AND NOT EXISTS (SELECT 1 FROM b WHERE b.rr = rc.rr AND b.cc = rc.cc) GROUP BY 1",
    "top04_capped_steps": f"WITH st AS ({RASTER_SQL['ras26_step_cells']}) SELECT rr, cc FROM st ORDER BY rr, cc LIMIT 200",
    "pip01_surfaces": "WITH s AS (SELECT CAST(floor(y/4) AS BIGINT) AS rr, CAST(floor(x/4) AS BIGINT) AS cc, avg(CASE WHEN cls = 2 THEN z END) AS t, max(CASE WHEN cls <> 2 THEN z END) AS u FROM fx_points GROUP BY 1, 2), d AS (SELECT g.rr, g.cc, s.t, s.u FROM fx_dense g LEFT JOIN s ON s.rr = g.rr AND s.cc = g.cc), q AS (SELECT c.rr, c.cc, sum(n.t/((n.rr-c.rr)*(n.rr-c.rr)+(n.cc-c.cc)*(n.cc-c.cc)))/sum(1.0/((n.rr-c.rr)*(n.rr-c.rr)+(n.cc-c.cc)*(n.cc-c.cc))) AS v FROM d c JOIN d n ON n.t IS NOT NULL AND (n.rr-c.rr)*(n.rr-c.rr)+(n.cc-c.cc)*(n.cc-c.cc) BETWEEN 1 AND 4 GROUP BY 1, 2), k AS (SELECT d.rr, d.cc, coalesce(t, v) AS dem, u FROM d LEFT JOIN q ON q.rr = d.rr AND q.cc = d.cc) SELECT rr, cc, round(dem + 1e-7, 5) AS dem, u AS dsm, round(greatest(coalesce(u, dem) - dem, 0) + 1e-7, 5) AS chm FROM k",
}

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("ras", "set", "top", "pip")) and callable(f) and n != "ras26_step_cells"}
