"""Queries of the cliff chain: ticks at steps of the terrain, chained to lines and merged to rock areas; and cliffs clear of buildings."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from geoloom.operators import cliffs as C
from geoloom.operators import focal
from geoloom.operators import spatial_join as J
from geoloom.plans.raster import _dense
from geoloom.plans.spatial import _segments
from geoloom.sources import tables as T

#: Metres: the least step, and lines of 1.2 mm on a map of 1:10,000.
STEP, LEAST = 15.0, 12.0
AXES = ((0, 1), (1, 0), (1, 1), (1, -1))


def ticks(spark, d):
    """(id, ax, ay, bx, by): a tick of 4 m along the wall in every cell whose ground falls across it by more than the wider trend explains."""
    base = _dense(spark, d).where("dem is not null").select("rr", "cc", "dem")
    offs = {(k, n): (f * dy, f * dx) for k, (dy, dx) in enumerate(AXES) for n, f in (("a", -1), ("b", 1), ("fa", -3), ("fb", 3))}
    at = lambda k, n: F.max(F.when((F.col("dy") == offs[k, n][0]) & (F.col("dx") == offs[k, n][1]), F.col("dem"))).alias(f"{n}{k}")
    around = focal.shifted(base, sorted(set(offs.values()))).groupBy("rr", "cc").agg(*(at(k, n) for k, n in offs))
    drop = lambda k: F.abs(F.col(f"a{k}") - F.col(f"b{k}")) - F.abs(F.col(f"fa{k}") - F.col(f"fb{k}")) / 3
    n = [math.hypot(*a) for a in AXES]
    best = F.array_max(F.array_compact(F.array(*(F.when(drop(k) >= STEP, F.struct(drop(k).alias("drop"), F.lit(-k).alias("k"), F.lit(-dy / n[k]).alias("tx"), F.lit(dx / n[k]).alias("ty"))) for k, (dy, dx) in enumerate(AXES)))))
    found = base.select("rr", "cc").join(around, ["rr", "cc"]).select("rr", "cc", best.alias("s")).where("s is not null")
    x, y = (F.col("cc") + 0.5) * T.CELL_M, (F.col("rr") + 0.5) * T.CELL_M
    half = T.CELL_M / 2
    return found.select((F.col("rr") * 1_000_000 + F.col("cc")).alias("id"), *((c + s * half * F.col(f"s.{t}")).alias(name) for name, c, s, t in (("ax", x, -1, "tx"), ("ay", y, -1, "ty"), ("bx", x, 1, "tx"), ("by", y, 1, "ty"))))


def grf16_cliff_lines(spark, d):
    """Every chain with its measures, and whether it is drawn: simple and long enough."""
    facts = C.banks(ticks(spark, d), LEAST)[1]
    drawn = F.col("simple") & (F.col("length") >= LEAST)
    return facts.select(F.shiftright("line_id", 1).alias("last_tick"), "ticks", "closed", F.round("length", 3).alias("length"), F.round("sinuosity", 4).alias("sinuosity"), F.round("turning", 2).alias("turning"), "crosses", drawn.alias("drawn"))


def grf17_rock_areas(spark, d):
    """Rock areas with their size, and the sides of the smallest rectangle around them."""
    cells, facts, _ = C.rock_areas(ticks(spark, d))
    corner = cells.groupBy("area").agg(F.min(F.struct("rr", "cc")).alias("p"))
    return facts.join(corner, "area").select("p.rr", "p.cc", "cells", F.round("width", 3).alias("width"), F.round("length", 3).alias("length"))


def jon27_clear_segments(spark, d):
    """Segments of lines that cross no building's outline: a semi join finds the others, and ends at a segment's first crossing."""
    seg = _segments(spark, d)
    a = seg.select(F.col("line_id").alias("a_id"), F.col("pos").alias("a_seg"), "ax", "ay", "bx", "by")
    r = T.rects(spark, d).where("kind = 'BUILDING'")
    side = lambda *c: F.struct(*(F.col(p).alias(q) for p, q in zip(c, ("cx", "cy", "dx", "dy"))))
    b = r.select(F.explode(F.array(side("x0", "y0", "x1", "y0"), side("x1", "y0", "x1", "y1"), side("x1", "y1", "x0", "y1"), side("x0", "y1", "x0", "y0"))).alias("s")).select("s.*")
    met = J.crossing(a, b, 16.0).select(F.col("a_id").alias("line_id"), F.col("a_seg").alias("pos")).distinct()
    return seg.select("line_id", "pos").join(met, ["line_id", "pos"], "left_anti")


_TURN = "({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x)"
_SIDE = lambda p, q, r: _TURN.format(p=p, q=q, r=r)

SQL = {
    "jon27_clear_segments": f"""WITH s AS (SELECT * FROM (SELECT line_id, pos, x AS ax, y AS ay, lead(x) OVER w AS ex, lead(y) OVER w AS ey FROM fx_vertices WINDOW w AS (PARTITION BY line_id ORDER BY pos)) WHERE ex IS NOT NULL),
      o AS (SELECT x0 AS cx, y0 AS cy, x1 AS dx, y0 AS dy FROM fx_rects WHERE kind = 'BUILDING' UNION ALL SELECT x1, y0, x1, y1 FROM fx_rects WHERE kind = 'BUILDING' UNION ALL SELECT x1, y1, x0, y1 FROM fx_rects WHERE kind = 'BUILDING' UNION ALL SELECT x0, y1, x0, y0 FROM fx_rects WHERE kind = 'BUILDING')
      SELECT line_id, pos FROM s EXCEPT SELECT line_id, pos FROM s JOIN o ON least(ax, ex) <= greatest(cx, dx) AND least(cx, dx) <= greatest(ax, ex) AND ({_SIDE('a', 'e', 'c')}) * ({_SIDE('a', 'e', 'd')}) < 0 AND ({_SIDE('c', 'd', 'a')}) * ({_SIDE('c', 'd', 'e')}) < 0""",
}

QUERIES = {f.__name__: f for f in (grf16_cliff_lines, grf17_rock_areas, jon27_clear_segments)}
