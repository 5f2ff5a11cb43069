"""Free ends of drawn roads: led on to the next road, and stubs that lead nowhere.

Every step is a join on cells with an exact predicate: ends against lines, the
short paths that lead on from them against roads and blocking areas.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators import lines as L
from geoloom.operators import sequence
from geoloom.operators import spatial_join as J
from geoloom.sources.store import written


@dataclass(frozen=True)
class Rules:
    """Metres, and millimetres on paper (``_mm``). The values are fixed by the results that are asked for."""

    extend_mm: float = 1.5
    stub_mm: float = 1.5
    touch: float = 0.5
    support: float = 1.5
    inner: float = 3.0
    target: float = 1.0
    least_angle: float = 30.0
    shrink: float = 0.3


def measured(vertices: DataFrame) -> DataFrame:
    """Segments of lines (line_id, pos, x, y) that have a length, with the measure at their start and the line's length."""
    seg = sequence.segments(vertices).where("len > 0")
    return seg.withColumn("total", F.sum("len").over(Window.partitionBy("line_id")))


def ends(vertices: DataFrame, inner: float) -> DataFrame:
    """(line_id, e, x, y, ix, iy): both ends of every open line (e: 0 start, 1 end), and the point ``inner`` metres in (half the line at the start of a short one, its start at the end)."""
    seg = measured(vertices)
    at = F.col("total") - inner
    pick = lambda m: F.struct(*((F.col(a) + (m - F.col("m0")) / F.col("len") * (F.col(b) - F.col(a))).alias(n) for n, a, b in (("x", "ax", "bx"), ("y", "ay", "by"))))
    first, last = F.least(F.lit(inner), F.col("total") / 2), F.greatest(F.lit(0.0), at)
    holds = lambda m: (F.col("m0") <= m) & (m < F.col("m0") + F.col("len"))
    tip = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    line = seg.groupBy("line_id").agg(
        F.min_by(tip("ax", "ay"), "pos").alias("a"), F.max_by(tip("bx", "by"), "pos").alias("b"),
        F.max(F.when(holds(first), pick(first))).alias("ia"), F.max(F.when(holds(last), pick(last))).alias("ib"),
    ).where("a <> b")
    both = F.array(F.struct(F.lit(0).alias("e"), F.col("a").alias("p"), F.col("ia").alias("i")), F.struct(F.lit(1).alias("e"), F.col("b").alias("p"), F.col("ib").alias("i")))
    return line.select("line_id", F.explode(both).alias("s")).select("line_id", "s.e", "s.p.x", "s.p.y", F.col("s.i.x").alias("ix"), F.col("s.i.y").alias("iy"))


def free_ends(tips: DataFrame, kinds: DataFrame, segments: DataFrame, widest: float, touch: float, bounds: tuple[float, float, float, float] | None) -> DataFrame:
    """Ends (``ends`` with kinds) that meet no other line: a road's end meets an axis; a path's end, or a black road's at a filled road, also what is drawn
    around it. Ends on the map's bounds are not free."""
    others = segments.join(kinds.select("line_id", "half", (F.col("road") & F.col("filled")).alias("wide")), "line_id").select(F.col("line_id").alias("other"), "ax", "ay", "bx", "by", "wide", F.col("half").alias("other_half"))
    t = tips.join(kinds, "line_id")
    drawn = (~F.col("road")) | (~F.col("filled") & F.col("wide"))
    room = F.lit(touch) + F.when(drawn, F.col("other_half")).otherwise(0.0)
    d2 = J.segment_distance2(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    held = J.beside_segments(t, others, widest + touch, (F.col("line_id") != F.col("other")) & (d2 <= room * room)).select("line_id", "e")
    if bounds is not None:
        x0, y0, x1, y1 = (float(v) for v in bounds)
        t = t.where(F.least(F.abs(F.col("x") - x0), F.abs(F.col("x") - x1), F.abs(F.col("y") - y0), F.abs(F.col("y") - y1)) > touch)
    return t.join(held, ["line_id", "e"], "left_anti")


def onward(free: DataFrame, supports: DataFrame, reach: float, rules: Rules) -> DataFrame:
    """(line_id, e, axis, away, k, p0, ax, ay, bx, by, plen): the paths on which an end may go on, piece by piece in order of ``p0``: along each mapped
    line beside it, away from the end's own line; straight on (axis null) where no mapped line is beside it."""
    seg = measured(supports).select(F.col("line_id").alias("axis"), "ax", "ay", "bx", "by", "m0", "len")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("by") - F.col("ay"))) / (F.col("len") * F.col("len"))))
    at = F.col("m0") + t * F.col("len")
    beside = J.near_segments(free.select("line_id", "e", "x", "y"), seg, rules.support).groupBy("line_id", "e", "axis").agg(F.min(F.struct("d2", at.alias("s"))).alias("b")).select("line_id", "e", "axis", F.sqrt("b.d2").alias("away"), F.col("b.s").alias("s0"))
    beside = written(beside)
    within = J.near_segments(free.select("line_id", "e", F.col("ix").alias("x"), F.col("iy").alias("y")), seg, rules.support + rules.inner).groupBy("line_id", "e", "axis").agg(F.min(F.struct("d2", at.alias("s"))).alias("b")).select("line_id", "e", "axis", F.col("b.s").alias("s1"))
    led = beside.join(within, ["line_id", "e", "axis"]).where(F.abs(F.col("s1") - F.col("s0")) >= 0.5)
    forth = F.col("s1") < F.col("s0")
    low, high = F.greatest("m0", F.when(forth, F.col("s0")).otherwise(F.col("s0") - reach)), F.least(F.col("m0") + F.col("len"), F.when(forth, F.col("s0") + reach).otherwise(F.col("s0")))
    on = lambda m, a, b: F.col(a) + (m - F.col("m0")) / F.col("len") * (F.col(b) - F.col(a))
    cut = led.join(seg, "axis").where(low < high)
    m0, m1 = F.when(forth, low).otherwise(high), F.when(forth, high).otherwise(low)
    along = cut.select("line_id", "e", "axis", "away", F.abs(m0 - F.col("s0")).alias("p0"), on(m0, "ax", "bx").alias("ax_"), on(m0, "ay", "by").alias("ay_"), on(m1, "ax", "bx").alias("bx_"), on(m1, "ay", "by").alias("by_"), (high - low).alias("plen"))
    d = F.hypot(F.col("x") - F.col("ix"), F.col("y") - F.col("iy"))
    alone = free.join(beside.select("line_id", "e").distinct(), ["line_id", "e"], "left_anti").where(d >= 0.01)
    ray = alone.select("line_id", "e", F.lit(None).cast(seg.schema["axis"].dataType).alias("axis"), F.lit(0.0).alias("away"), F.lit(0.0).alias("p0"), F.col("x").alias("ax_"), F.col("y").alias("ay_"), (F.col("x") + (F.col("x") - F.col("ix")) / d * reach).alias("bx_"), (F.col("y") + (F.col("y") - F.col("iy")) / d * reach).alias("by_"), F.lit(float(reach)).alias("plen"))
    return along.unionByName(ray).withColumnsRenamed({"ax_": "ax", "ay_": "ay", "bx_": "bx", "by_": "by"})


def band_entry(half: Column) -> Column:
    """Where a path piece (ax, ay, bx, by) first comes within ``half`` of a segment (cx, cy, dx, dy): a parameter from 0 to 1, or null."""
    c = F.col
    vx, vy = c("bx") - c("ax"), c("by") - c("ay")
    vv = F.nullif(vx * vx + vy * vy, F.lit(0.0))

    def disc(x: str, y: str) -> Column:
        fx, fy = c("ax") - c(x), c("ay") - c(y)
        b, out = fx * vx + fy * vy, fx * fx + fy * fy - half * half
        root = b * b - vv * out
        t = (-b - F.sqrt(root)) / vv
        return F.when(out <= 0, 0.0).when((root >= 0) & (t >= 0) & (t <= 1), t)

    ux, uy = c("dx") - c("cx"), c("dy") - c("cy")
    n = F.nullif(F.hypot(ux, uy), F.lit(0.0))
    low, high = [F.lit(0.0)], [F.lit(1.0)]
    for p, v, a, b in (
        (((c("ax") - c("cx")) * ux + (c("ay") - c("cy")) * uy) / n, (vx * ux + vy * uy) / n, F.lit(0.0), n),
        (((c("ay") - c("cy")) * ux - (c("ax") - c("cx")) * uy) / n, (vy * ux - vx * uy) / n, -half, half),
    ):
        along = F.nullif(v, F.lit(0.0))
        out = (p < a) | (p > b)
        low.append(F.when(v == 0, F.when(out, 2.0).otherwise(0.0)).otherwise(F.least((a - p) / along, (b - p) / along)))
        high.append(F.when(v == 0, F.lit(1.0)).otherwise(F.greatest((a - p) / along, (b - p) / along)))
    slab = F.when(F.greatest(*low) <= F.least(*high), F.greatest(*low))
    return F.least(disc("cx", "cy"), disc("dx", "dy"), slab)


def _meeting(paths: DataFrame, roads: DataFrame) -> DataFrame:
    """Path pieces beside road segments (target, cx, cy, dx, dy, ...) of other lines, at least once where their boxes touch."""
    grown = lambda a, b, s: (F.least(a, b) if s < 0 else F.greatest(a, b)) + s * F.col("margin")
    p = J.box_cells(paths, F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by"))
    r = J.box_cells(roads, grown("cx", "dx", -1), grown("cy", "dy", -1), grown("cx", "dx", 1), grown("cy", "dy", 1))
    return p.join(r, ["__gx", "__gy"]).where("line_id <> target").drop("__gx", "__gy")


def extensions(free: DataFrame, kinds: DataFrame, segments: DataFrame, supports: DataFrame, blockers: DataFrame, widest: float, extend: float, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """The ends that reach another road, (line_id, e, target, stop), and their ways there, (line_id, e, p, x, y) in order of ``p``.

    The first road on the way counts; its drawing has to begin within ``extend``. A black road ends where the filled road's drawing begins, others on the axis.
    Straight on, the angle has to be 30 degrees at least. A way through a blocking box, less 0.3 m all round, doesn't count; of several ways the nearest mapped line's does.
    Roads that run along the way itself are not met.
    """
    paths = written(onward(free, supports, extend + widest, rules))
    c = F.col
    roads = kinds.where("road").select(c("line_id").alias("target"), "half", "filled")
    road = segments.select(c("line_id").alias("target"), c("ax").alias("cx"), c("ay").alias("cy"), c("bx").alias("dx"), c("by").alias("dy")).join(roads, "target")
    vx, vy, ux, uy = c("bx") - c("ax"), c("by") - c("ay"), c("dx") - c("cx"), c("dy") - c("cy")
    across = F.nullif(vx * uy - vy * ux, F.lit(0.0))
    t = ((c("cx") - c("ax")) * uy - (c("cy") - c("ay")) * ux) / across
    u = ((c("cx") - c("ax")) * vy - (c("cy") - c("ay")) * vx) / across
    turn = F.degrees(F.acos(F.least(F.lit(1.0), F.abs(vx * ux + vy * uy) / (F.hypot(vx, vy) * F.hypot(ux, uy)))))
    met = _meeting(paths, road.withColumn("margin", F.lit(1e-6))).withColumn("t", t).withColumn("u", u).where("t between 0 and 1 and u between 0 and 1")
    met = met.withColumn("d", c("p0") + c("t") * c("plen")).where(c("d") > rules.touch)
    key = ["line_id", "e", "axis", "away"]
    first = met.groupBy(*key).agg(F.min(F.struct("d", "target", "half", "filled", turn.alias("turn"))).alias("h")).select(*key, "h.*")
    first = written(first.where(c("axis").isNotNull() | (c("turn") >= rules.least_angle)).where(c("d") - c("half") <= extend))
    own = kinds.select("line_id", c("filled").alias("own_filled"))
    edge = c("filled") & ~c("own_filled")
    short = first.join(own, "line_id").withColumn("edge", edge)
    band = road.where("filled").withColumn("margin", c("half"))
    wanted = short.where("edge").select("line_id", "e", c("axis").alias("axis_"), c("target").alias("target_"))
    enter = _meeting(paths, band).join(wanted, ["line_id", "e"]).where(c("axis").eqNullSafe(c("axis_")) & (c("target") == c("target_")))
    enter = enter.withColumn("t", band_entry(c("half"))).where("t is not null").groupBy("line_id", "e", "axis").agg(F.min(c("p0") + c("t") * c("plen")).alias("enters"))
    enter = enter.withColumnsRenamed({"line_id": "l_", "e": "e_", "axis": "a_"})
    stop = short.join(enter, (c("line_id") == c("l_")) & (c("e") == c("e_")) & c("axis").eqNullSafe(c("a_")), "left").withColumn("stop", F.when(c("edge"), F.coalesce(F.least("enters", "d"), c("d") - c("half"))).otherwise(c("d")))
    stop = written(stop.where(c("stop") > rules.touch).select(*key, "target", "stop"))
    s = stop.select("line_id", "e", c("axis").alias("axis_"), "target", "stop")
    used = paths.join(s, ["line_id", "e"]).where(c("axis").eqNullSafe(c("axis_")) & (c("p0") < c("stop"))).drop("axis_")
    part = F.least(F.lit(1.0), (c("stop") - c("p0")) / c("plen"))
    used = written(used.withColumn("part", part).withColumn("bx", c("ax") + c("part") * (c("bx") - c("ax"))).withColumn("by", c("ay") + c("part") * (c("by") - c("ay"))))
    r = rules.shrink
    inner = blockers.select(F.monotonically_increasing_id().alias("fid"), (c("x0") + r).alias("x0"), (c("y0") + r).alias("y0"), (c("x1") - r).alias("x1"), (c("y1") - r).alias("y1")).where("x0 < x1 and y0 < y1")
    barred = L.in_boxes(used.select("line_id", "e", "axis", "ax", "ay", "bx", "by"), inner).select("line_id", "e", c("axis").alias("axis_")).distinct().withColumn("barred", F.lit(True))
    open_ = stop.join(barred, (stop["line_id"] == barred["line_id"]) & (stop["e"] == barred["e"]) & stop["axis"].eqNullSafe(barred["axis_"]), "left_anti")
    best = written(open_.groupBy("line_id", "e").agg(F.min(F.struct("away", "axis", "target", "stop")).alias("b")).select("line_id", "e", "b.axis", "b.target", "b.stop"))
    way = used.drop("target", "stop").join(best.select("line_id", "e", c("axis").alias("axis_")), ["line_id", "e"]).where(c("axis").eqNullSafe(c("axis_")))
    point = F.array(F.struct(c("p0").alias("p"), c("ax").alias("x"), c("ay").alias("y")), F.struct((c("p0") + c("part") * c("plen")).alias("p"), c("bx").alias("x"), c("by").alias("y")))
    points = way.select("line_id", "e", F.explode(F.when(c("p0") == 0, point).otherwise(F.slice(point, 2, 1))).alias("v")).select("line_id", "e", "v.*")
    return best.select("line_id", "e", "target", "stop"), points


def tidied(vertices: DataFrame, kinds: DataFrame, supports: DataFrame, blockers: DataFrame, scale: int, widest: float, bounds: tuple[float, float, float, float] | None = None, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame]:
    """Lines (line_id, pos, x, y) with free road ends led on and stubs left out, and their report (line_id, length, led_start, led_end, dropped).

    ``kinds`` (line_id, road, fixed, filled, half; ``widest`` at most): roads are led on and are what ends are led to; fixed lines stay as they are; paths are only
    looked through for stubs. ``supports`` are mapped roads (line_id, pos, x, y), ``blockers`` boxes (x0, y0, x1, y1). Ends are judged by the lines as given,
    stubs by the lines led on. A line under the stub length goes if both its ends are free, or one is that has no blocking box within a metre.
    Lines of fewer than two distinct vertices are left out; vertices without a place have to be left out by the caller.
    """
    m = scale / 1000.0
    c = F.col
    kinds = kinds.withColumn("half", F.when(c("half") > widest, F.raise_error(F.lit("a line is wider than the widest"))).otherwise(c("half")))
    seg = written(measured(vertices))
    open_ = written(free_ends(ends(vertices, rules.inner), kinds, seg, widest, rules.touch, bounds).where("road and not fixed").drop("road", "fixed", "filled", "half"))
    led, ways = extensions(open_, kinds, seg, supports, blockers, widest, rules.extend_mm * m, rules)
    w = Window.partitionBy("line_id")
    flags = led.groupBy("line_id").agg(F.max(F.when(c("e") == 0, c("stop"))).alias("led_start"), F.max(F.when(c("e") == 1, c("stop"))).alias("led_end"))
    placed = vertices.join(seg.select("line_id").distinct(), "line_id", "left_semi").join(flags, "line_id", "left").withColumn("lo", F.min("pos").over(w)).withColumn("hi", F.max("pos").over(w))
    stay = placed.where(~((c("pos") == c("lo")) & c("led_start").isNotNull()) & ~((c("pos") == c("hi")) & c("led_end").isNotNull())).select("line_id", F.lit(1).alias("part"), c("pos").cast("double").alias("o"), "x", "y")
    added = ways.select("line_id", F.when(c("e") == 0, 0).otherwise(2).alias("part"), F.when(c("e") == 0, -c("p")).otherwise(c("p")).alias("o"), "x", "y")
    new = written(stay.unionByName(added).withColumn("pos", F.row_number().over(w.orderBy("part", "o"))).select("line_id", "pos", "x", "y"))
    again = written(measured(new))
    length = again.groupBy("line_id").agg(F.max("total").alias("length"))
    short = length.where(c("length") < rules.stub_mm * m).join(kinds.where("not fixed").select("line_id"), "line_id", "left_semi")
    loose = free_ends(ends(new, rules.inner).join(short, "line_id", "left_semi"), kinds, again, widest, rules.touch, bounds).select("line_id", "e", "x", "y")
    loose = written(loose)
    r = rules.target
    around = blockers.select(*((c(n) + s * r).alias(n) for n, s in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))))
    off = lambda v, a, b: F.greatest(c(a) + r - c(v), c(v) - c(b) + r, F.lit(0.0))
    near = J.points_in_boxes(loose, around).where(F.hypot(off("x", "x0", "x1"), off("y", "y0", "y1")) <= r).select("line_id", "e").distinct().withColumn("near", F.lit(True))
    judged = loose.join(near, ["line_id", "e"], "left").groupBy("line_id").agg(F.count("*").alias("n"), F.sum(c("near").isNull().cast("int")).alias("lost"))
    stubs = written(judged.where("n = 2 or lost > 0").select("line_id"))
    report = length.join(flags, "line_id", "left").join(stubs.withColumn("dropped", F.lit(True)), "line_id", "left").select("line_id", "length", "led_start", "led_end", F.coalesce("dropped", F.lit(False)).alias("dropped"))
    return new.join(stubs, "line_id", "left_anti"), report
