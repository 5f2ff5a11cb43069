"""Objects moved clear of drawn paths, or clipped where they cannot be moved.

Objects move by themselves (paths stay), so all of them go through the rounds at
once. An object meets the path segments within its reach once; that table is
written and every round joins the small table of shifts with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators import cellsets, focal, graph, sequence
from geoloom.operators import spatial_join as J
from geoloom.sources.store import written


@dataclass(frozen=True)
class Rules:
    """Millimetres on paper, square millimetres for areas. The values are fixed by the results that are asked for."""

    most: float = 0.9
    point_most: float = 1.5
    gap: float = 0.2
    point_radius: float = 0.3
    slack: float = 0.005
    beyond: float = 0.001
    least_area: float = 0.25
    rounds: int = 4


def ring_edges(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A box's sides as array<struct<ax, ay, bx, by>>; the same corner twice gives a point."""
    side = lambda a, b, c, d: F.struct(a.alias("ax"), b.alias("ay"), c.alias("bx"), d.alias("by"))
    return F.array(side(x0, y0, x1, y0), side(x1, y0, x1, y1), side(x1, y1, x0, y1), side(x0, y1, x0, y0))


def met(objects: DataFrame, axes: DataFrame, reach: Column, widest: float, size: float = J.CELL) -> DataFrame:
    """(id, extra, axis, seg, half, cx, cy, dx, dy, ax, ay, bx, by): objects' edges with the path segments (axis, seg, ax, ay, bx, by, half)
    whose band, ``widest`` at most, may lie within ``reach`` of the object (edges, extra)."""
    low = lambda c: F.least(F.array_min(F.transform("edges", lambda e: e[f"a{c}"])), F.array_min(F.transform("edges", lambda e: e[f"b{c}"])))
    high = lambda c: F.greatest(F.array_max(F.transform("edges", lambda e: e[f"a{c}"])), F.array_max(F.transform("edges", lambda e: e[f"b{c}"])))
    boxes = objects.select("id", (low("x") - reach).alias("x0"), (low("y") - reach).alias("y0"), (high("x") + reach).alias("x1"), (high("y") + reach).alias("y1"))
    cells = J.box_cells(boxes, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size)
    near = (F.least("ax", "bx") - F.col("half") <= F.col("x1")) & (F.greatest("ax", "bx") + F.col("half") >= F.col("x0"))
    near = near & (F.least("ay", "by") - F.col("half") <= F.col("y1")) & (F.greatest("ay", "by") + F.col("half") >= F.col("y0"))
    pairs = J._reached(axes, widest, size).join(cells, ["__gx", "__gy"]).where(near)
    pairs = pairs.select("id", "axis", "seg", "half", *(F.col(a).alias(b) for a, b in (("ax", "cx"), ("ay", "cy"), ("bx", "dx"), ("by", "dy")))).distinct()
    return pairs.join(objects.select("id", "extra", F.explode("edges").alias("e")), "id").select(*pairs.columns, "extra", "e.*")


def approach(near: DataFrame, shifts: DataFrame) -> DataFrame:
    """(id, choice, axis, half, extra, d, vx, vy, ux, uy): how near each shifted object (id, choice, tx, ty) is to each of its axes, the vector from
    the axis to the object there, and the direction of the segment. An object that a segment crosses, or lies in, is at distance 0."""
    j = near.join(shifts, "id")
    c = F.col
    ends = ((c("ax") + c("tx"), c("ay") + c("ty")), (c("bx") + c("tx"), c("by") + c("ty")))
    tips = ((c("cx"), c("cy")), (c("dx"), c("dy")))

    def foot(p, a, b):
        """The point of segment ab next to p."""
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = F.coalesce(((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return a[0] + t * dx, a[1] + t * dy

    def vector(o, s):
        x, y = o[0] - s[0], o[1] - s[1]
        return F.struct((x * x + y * y).alias("d2"), x.alias("vx"), y.alias("vy"))

    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    cross = (side(*ends, tips[0]) * side(*ends, tips[1]) < 0) & (side(*tips, ends[0]) * side(*tips, ends[1]) < 0)
    zero = F.struct(F.lit(0.0).alias("d2"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"))
    options = [vector(p, foot(p, *tips)) for p in ends] + [vector(foot(q, *ends), q) for q in tips]
    (px, py), (qx, qy), (sx, sy) = *ends, tips[0]
    passes = ((py > sy) != (qy > sy)) & (sx < (qx - px) * (sy - py) / F.nullif(qy - py, F.lit(0.0)) + px)
    j = j.select("id", "choice", "axis", "seg", "half", "extra", (c("dx") - c("cx")).alias("ux"), (c("dy") - c("cy")).alias("uy"), F.when(cross, zero).otherwise(F.least(*options)).alias("v"), F.coalesce(passes, F.lit(False)).cast("int").alias("odd"))
    keys = ["id", "choice", "axis", "half", "extra"]
    each = j.groupBy(*keys, "seg", "ux", "uy").agg(F.min("v").alias("v"), (F.sum("odd") % 2).alias("odd"))
    best = F.struct(F.when(c("odd") == 1, zero).otherwise(c("v")).alias("v"), "seg", "ux", "uy")
    return each.groupBy(*keys).agg(F.min(best).alias("b")).select(*keys, F.sqrt("b.v.d2").alias("d"), "b.v.vx", "b.v.vy", "b.ux", "b.uy")


def pushed(near: DataFrame, objects: DataFrame, before: DataFrame, widest: float, most: float, slack: float, beyond: float, rounds: int) -> DataFrame:
    """(id, tx, ty): shifts that clear objects of the axes near them. Each round moves an object off the axis whose band it is deepest in (of equals the
    least). No shift for objects on an axis, for shifts over ``most``, nor where an object would end nearer to a path than it was and than it should be."""
    crossed = before.where(F.col("d") <= slack).select("id").distinct()
    around = before.where(F.col("d") <= widest + F.col("extra")).select("id", "axis").distinct()
    pushing = written(near.join(around, ["id", "axis"], "left_semi").join(crossed, "id", "left_anti"))
    state = written(objects.select("id", F.lit(0).alias("choice"), F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty")).join(pushing.select("id").distinct(), "id", "left_semi"))
    for _ in range(rounds):
        lack = F.col("half") + F.col("extra") - F.col("d")
        deep = approach(pushing, state).withColumn("lack", lack).where((F.col("lack") > slack) & (F.col("d") > slack * 1e-6))
        worst = deep.groupBy("id").agg(F.min(F.struct((-F.col("lack")).alias("o"), "axis", "d", "vx", "vy")).alias("w"))
        by = (F.lit(beyond) - F.col("w.o")) / F.col("w.d")
        worst = worst.select("id", (F.col("w.vx") * by).alias("mx"), (F.col("w.vy") * by).alias("my"))
        if (worst := written(worst)).isEmpty():
            break
        state = written(state.join(worst, "id", "left").select("id", "choice", (F.col("tx") + F.coalesce("mx", F.lit(0.0))).alias("tx"), (F.col("ty") + F.coalesce("my", F.lit(0.0))).alias("ty")))
    moved = state.where((F.hypot("tx", "ty") > 0) & (F.hypot("tx", "ty") <= most))
    after = approach(near, moved).join(before.select("id", "axis", F.col("d").alias("was")), ["id", "axis"], "left")
    worse = after.where(F.col("d") + slack < F.least(F.coalesce("was", F.lit(float("inf"))), F.col("half") + F.col("extra"))).select("id").distinct()
    return moved.join(worse, "id", "left_anti").select("id", "tx", "ty")


def stepped_off(near: DataFrame, before: DataFrame, most: float, slack: float, beyond: float) -> DataFrame:
    """(id, tx, ty): points on an axis or in its band that go to its nearer side where they are clear of all paths, at right angles, ``most`` at most."""
    hit = before.where(F.col("d") < F.col("half") + F.col("extra") - slack)
    first = hit.groupBy("id").agg(F.min(F.struct("d", "axis", "vx", "vy", "ux", "uy", "half", "extra")).alias("h")).select("id", "h.*")
    on = F.col("d") < beyond
    run = F.nullif(F.hypot("ux", "uy"), F.lit(0.0))
    nx, ny = F.when(on, -F.col("uy") / run).otherwise(F.col("vx") / F.col("d")), F.when(on, F.col("ux") / run).otherwise(F.col("vy") / F.col("d"))
    need, d = F.col("half") + F.col("extra") + beyond, F.when(on, 0.0).otherwise(F.col("d"))
    sides = F.array(F.struct(F.lit(0).alias("choice"), (need - d).alias("by")), F.struct(F.lit(1).alias("choice"), (-need - d).alias("by")))
    tried = first.select("id", nx.alias("nx"), ny.alias("ny"), F.explode(sides).alias("s")).select("id", "s.choice", F.abs("s.by").alias("far"), (F.col("nx") * F.col("s.by")).alias("tx"), (F.col("ny") * F.col("s.by")).alias("ty"))
    tried = written(tried.where((F.col("far") <= most) & F.col("tx").isNotNull()))
    blocked = approach(near, tried).where(F.col("d") < F.col("half") + F.col("extra") - slack).select("id", "choice").distinct()
    free = tried.join(blocked, ["id", "choice"], "left_anti")
    return free.groupBy("id").agg(F.min(F.struct("far", "choice", "tx", "ty")).alias("b")).select("id", "b.tx", "b.ty")


def clipped(boxes: DataFrame, axes: DataFrame, widest: float, least_area: float, size: float) -> DataFrame:
    """(id, pieces, left_area): what the paths' bands leave of boxes (id, x0, y0, x1, y1, extra), in cells; pieces (4-connected) under the least area go."""
    own = cellsets.box_cells(boxes, size, "id", "extra")
    x, y = (F.col("cc") + 0.5) * size, (F.col("rr") + 0.5) * size
    at = own.select("id", "rr", "cc", "extra", x.alias("x"), y.alias("y"))
    reach = boxes.agg(F.coalesce(F.max("extra"), F.lit(0.0)).alias("e")).first()["e"] + widest
    need = F.col("half") + F.col("extra")
    d2 = J.segment_distance2(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    gone = J.beside_segments(at, axes, reach, d2 <= need * need).select("id", "rr", "cc")
    left = written(own.select("id", "rr", "cc").join(gone, ["id", "rr", "cc"], "left_anti").withColumn("cell", F.xxhash64("id", "rr", "cc")))
    links = focal.shifted(left.select("rr", "cc", F.col("id").alias("id"), F.col("cell").alias("a")), [(0, 1), (1, 0)]).drop("dy", "dx").join(left.withColumnRenamed("cell", "b"), ["id", "rr", "cc"]).select("a", "b")
    label = graph.labelled(left.select(F.col("cell").alias("id")), links).withColumnRenamed("id", "cell")
    pieces = left.join(label, "cell").groupBy("id", "component").agg((F.count("*") * size * size).alias("area")).where(F.col("area") >= least_area)
    return pieces.groupBy("id").agg(F.count("*").alias("pieces"), F.sum("area").alias("left_area"))


def displaced(objects: DataFrame, axes: DataFrame, scale: int, widest: float, rules: Rules = Rules(), size: float = 0.5) -> DataFrame:
    """(id, status, tx, ty, pieces, left_area) of every object (id, x0, y0, x1, y1; a point's corners are one).

    An object keeps a gap on paper from the bands (``half`` metres on both sides, ``widest`` at most) of the axes' segments (axis, seg, ax, ay, bx, by).
    It is ``clear``, or ``moved``; a point that no push clears goes to the axis' other side if need be (``stepped``) or stays (``kept``); an area that
    cannot move is ``clipped`` by the bands or, if too little is left, ``dropped``. Rows without a corner are left out; ids have to be unique.

    Objects of equal corners share their fate, and of axes with equal segments the least decides, so each goes through the rounds once.
    """
    rows = written(objects.where("x0 + y0 + x1 + y1 is not null").select("id", *J.BOX))
    axes = axes.withColumn("half", F.when(F.col("half") > widest, F.raise_error(F.lit("a path is wider than the widest"))).otherwise(F.col("half")))
    least = sequence.line_shapes(axes, "axis", "seg", "half").where("axis = shape").select("axis")
    fates = _displaced(rows.groupBy(*J.BOX).agg(F.min("id").alias("id")), written(axes.join(least, "axis", "left_semi")), scale, widest, rules, size)
    return rows.join(fates, list(J.BOX)).select("id", "status", "tx", "ty", "pieces", "left_area")


def _displaced(objects: DataFrame, axes: DataFrame, scale: int, widest: float, rules: Rules, size: float) -> DataFrame:
    """The same by corners, for objects and axes without copies."""
    m = scale / 1000.0
    point = (F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1"))
    o = objects.select("id", "x0", "y0", "x1", "y1", point.alias("point"), F.when(point, (rules.point_radius + rules.gap) * m).otherwise(rules.gap * m).alias("extra"))
    o = written(o.withColumn("edges", F.when(F.col("point"), F.slice(ring_edges(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))), 1, 1)).otherwise(ring_edges(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))))))
    reach = F.col("extra") + F.when(F.col("point"), max(rules.most, rules.point_most) * m).otherwise(rules.most * m) + widest
    near = written(met(o, axes, reach, widest))
    still = o.select("id", F.lit(0).alias("choice"), F.lit(0.0).alias("tx"), F.lit(0.0).alias("ty"))
    before = written(approach(near, still).drop("choice"))
    slack, beyond = rules.slack * m, rules.beyond * m
    touched = before.where(F.col("half") + F.col("extra") - F.col("d") > slack).select("id").distinct()
    moves = written(pushed(near, o, before, widest, rules.most * m, slack, beyond, rules.rounds).withColumn("status", F.lit("moved")))
    stuck = written(o.join(touched, "id", "left_semi").join(moves, "id", "left_anti").select("id", "x0", "y0", "x1", "y1", "extra", "point"))
    points = stuck.where("point").select("id")
    steps = stepped_off(near.join(points, "id", "left_semi"), before.join(points, "id", "left_semi"), max(rules.most, rules.point_most) * m, slack, beyond).withColumn("status", F.lit("stepped"))
    cut = clipped(stuck.where("not point").drop("point"), axes, widest, rules.least_area * m * m, size)
    out = o.select("id", *J.BOX).join(moves.unionByName(steps), "id", "left").join(stuck.select("id", "point"), "id", "left").join(cut, "id", "left")
    fate = F.when(F.col("status").isNotNull(), F.col("status")).when(F.col("point").isNull(), "clear").when(F.col("point"), "kept").when(F.col("pieces").isNull(), "dropped").otherwise("clipped")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return out.select(*J.BOX, fate.alias("status"), zero("tx"), zero("ty"), F.coalesce("pieces", F.lit(0)).alias("pieces"), zero("left_area"))
