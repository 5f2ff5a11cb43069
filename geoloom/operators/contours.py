"""Contours end to end: terrain smoothed where it is flat, level segments linked to ordered lines, helper lines and slope ticks.

Segments come from triangles, so an end of one lies on a grid edge that two triangles share. The edge and the level name it; a
node has one segment in and one out, since each runs with the higher ground on its left. Lines are then linked lists, open or
closed: pointer jumping ranks their nodes, in rounds that grow with the logarithm of the longest line, wherever its nodes lie.
No line is gathered, and no tile knows of another.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators import focal
from geoloom.operators import spatial_join as J
from geoloom.sources.store import written


@dataclass(frozen=True)
class Smoothing:
    """Metres on the ground, millimetres on paper. The values are fixed by the results that are asked for: forest maps."""

    strong: float = 7.0
    flat_mm: tuple[float, float] = (2.0, 5.0)
    slope: float = 10.0
    zone: float = 20.0
    detail: tuple[float, float] = (0.5, 1.2)
    cap: float = 0.3
    urban_mm: tuple[float, float] = (1.0, 2.0)
    urban: float = 8.0
    urban_strong: float = 12.0
    urban_detail: float = 1.0
    keep_green: bool = False


#: The same for town maps.
TOWN = Smoothing(strong=3.0, flat_mm=(1.0, 2.0), slope=4.0, zone=8.0, detail=(0.4, 0.9), urban_mm=(0.6, 1.0), urban=4.0, urban_strong=6.0, urban_detail=0.5, keep_green=True)
#: Weights below this are none; a Gaussian reaches this many sigmas.
LEAST_WEIGHT, REACH = 0.02, 4.0


def smoothstep(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / F.greatest(high - low, F.lit(1e-9))))
    return t * t * (3 - 2 * t)


def adaptive_surface(cells: DataFrame, size: float, interval: float, scale: int, rules: Smoothing = Smoothing()) -> DataFrame:
    """(rr, cc, z, w): terrain moved towards its Gaussian mean by the weight w, at most ``cap`` of the interval.

    ``cells``: a dense grid of rr, cc, z (null: no data) and, where known, the flags urban, green, protect. The weight is large where
    contours lie far apart on paper (by the mean slope around) and in towns, falls off smoothly around such zones, and is nothing
    on steep ground, on shapes that the smoothing would change much, and on protected ground. Cells without data stay null, and
    the outside of the grid counts for nothing.
    """
    valid = F.col("z").isNotNull()
    flag = lambda c: F.when(valid, F.coalesce(F.col(c), F.lit(False)).cast("double") if c in cells.columns else F.lit(0.0))
    near = lambda d, metres, value, out: focal.gauss(d, metres / size, value, out, REACH)
    base = written(cells.select("rr", "cc", F.col("z").cast("double").alias("z"), *(flag(c).alias(c) for c in ("urban", "green", "protect"))))
    slope = focal.gradient(base, size, "z").withColumn("grad", F.when(valid, F.hypot("gx", "gy")))
    d = near(near(slope, rules.strong, "z", "strong"), rules.slope, "grad", "mean")
    for value, metres, out in (("z", rules.urban_strong, "town"), ("urban", rules.urban, "near_town"), ("green", rules.urban, "near_green"), ("protect", rules.urban / 2, "near_protect")):
        d = near(d, metres, value, out)
    spacing = F.lit(interval) / F.greatest(F.coalesce("mean", F.lit(0.0)), F.lit(1e-6)) / scale * 1000
    twice = lambda c: F.least(F.col(c) * 2, F.lit(1.0))
    d = d.withColumn("u", twice("near_town") * smoothstep(spacing, *rules.urban_mm)).withColumn("flat", F.when(valid, F.greatest(smoothstep(spacing, *rules.flat_mm), F.col("u"))))
    d = written(d.withColumn("delta", (F.col("strong") - F.col("z")) * (1 - F.col("u")) + (F.col("town") - F.col("z")) * F.col("u")))
    zone = near(d, rules.zone, "flat", "around").withColumn("w", F.least(F.col("around") * F.col("flat"), F.lit(1.0)))
    cut = lambda c: F.when(c < LEAST_WEIGHT, 0.0).otherwise(c)
    zone = zone.withColumn("w", cut(F.col("w")))
    if rules.keep_green:
        zone = zone.withColumn("w", cut(F.col("w") * (1 - twice("near_green"))))
    low, high = (F.lit(v) + F.col("u") * rules.urban_detail for v in rules.detail)
    w = cut(F.col("w") * (1 - smoothstep(F.abs("delta"), low, high)) * (1 - twice("near_protect")))
    most = rules.cap * interval
    moved = F.col("z") + F.col("w") * F.greatest(F.lit(-most), F.least(F.lit(most), F.col("delta")))
    return zone.withColumn("w", w).select("rr", "cc", F.when(F.col("w") > 0, moved).otherwise(F.col("z")).alias("z"), F.when(valid, F.coalesce("w", F.lit(0.0))).alias("w"))


_TRIANGLES = (("a", "b", "c"), ("b", "d", "c"))
_CORNERS = {"a": (0, 0), "b": (0, 1), "c": (1, 0), "d": (1, 1)}


def level_links(cells: DataFrame, interval: float, offset: float = 0.0, value: str = "z") -> DataFrame:
    """(id, next, level, k, x, y): for every node of a level's lines the node after it; k counts intervals from the offset.

    Coordinates are cells, from centre to centre. Higher ground, or ground at the level, is on the left. ``next`` may be a node that is no id: the end of an open line.
    """
    base = cells.where(F.col(value).isNotNull()).select("rr", "cc", F.col(value).cast("double").alias("v"))
    square = focal.shifted(base, [(-dy, -dx) for dy, dx in _CORNERS.values()]).groupBy("rr", "cc").agg(*(F.max(F.when((F.col("dy") == -dy) & (F.col("dx") == -dx), F.col("v"))).alias(n) for n, (dy, dx) in _CORNERS.items()), F.count("*").alias("n")).where("n = 4")
    corner = lambda n: F.struct(F.col(n).alias("v"), (F.col("rr") + _CORNERS[n][0]).alias("r"), (F.col("cc") + _CORNERS[n][1]).alias("c"))
    tri = square.select(F.explode(F.array(*(F.struct(*(corner(n).alias(s) for n, s in zip(t, "pqs"))) for t in _TRIANGLES))).alias("t")).select("t.*")
    low, high = F.least("p.v", "q.v", "s.v"), F.greatest("p.v", "q.v", "s.v")
    # a corner at the level is high: a level cuts where one corner is below it and another is not
    first, last = F.floor((low - offset) / interval) + 1, F.floor((high - offset) / interval)
    cut = tri.withColumn("k", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))).withColumn("level", F.col("k") * interval + offset)
    # turning with x to the right and y up, a, b, c and b, d, c go round to the left: a line leaves where a side goes from low to high
    up = {n: F.col(f"{n}.v") >= F.col("level") for n in "pqs"}

    def at(m: str, n: str) -> Column:
        """The crossing of a side, seen from its lesser corner whichever triangle asks, and its name."""
        one, two = F.struct(f"{m}.r", f"{m}.c", f"{m}.v"), F.struct(f"{n}.r", f"{n}.c", f"{n}.v")
        a, b = F.least(one, two), F.greatest(one, two)
        t = F.try_divide(F.col("level") - a["v"], b["v"] - a["v"])
        return F.struct(F.struct(F.col("k").alias("k"), a["r"].alias("r"), a["c"].alias("c"), b["r"].alias("r2"), b["c"].alias("c2")).alias("id"), (a["c"] + t * (b["c"] - a["c"])).alias("x"), (a["r"] + t * (b["r"] - a["r"])).alias("y"))

    sides = (("p", "q"), ("q", "s"), ("s", "p"))
    pick = lambda want: F.coalesce(*(F.when((~up[m] if want else up[m]) & (up[n] if want else ~up[n]), at(m, n)) for m, n in sides))
    ends = cut.select("level", "k", pick(False).alias("a"), pick(True).alias("b"))
    return ends.select(F.col("a.id").alias("id"), F.col("b.id").alias("next"), "level", "k", F.col("a.x").alias("x"), F.col("a.y").alias("y"), F.col("b.x").alias("next_x"), F.col("b.y").alias("next_y"))


def ordered(links: DataFrame) -> DataFrame:
    """(id, path, place, closed) of linked lists (id, next: null at an end), each id with one before and one after it at most.

    Rings are found first: where nothing ends and no lesser id turns up any more, pointers go round. A ring is cut before its least id;
    then steps to the end are counted by doubling. A path is named by its last id. Rounds: twice the logarithm of the longest.
    """
    start = written(links.select("id", "next"))
    state = start.withColumn("low", F.col("id"))
    while True:
        ahead = state.select(F.col("id").alias("next"), F.col("next").alias("then"), F.col("low").alias("lower"), F.lit(True).alias("there"))
        state = written(state.join(ahead, "next", "left").select("id", F.col("then").alias("next"), F.least("low", "lower").alias("low"), ((F.col("there") & F.col("then").isNull()) | (F.col("lower") < F.col("low"))).alias("moved")))
        if state.where("moved").isEmpty():
            break
    rings = state.where("next is not null").select("id", "low")
    first = start.join(rings, "id", "left").withColumn("closed", F.col("low").isNotNull())
    cut = first.select("id", F.when(F.col("low").isNull() | (F.col("next") != F.col("low")), F.col("next")).alias("next"), "closed")
    state = written(cut.select("id", "next", "closed", F.col("next").isNotNull().cast("long").alias("steps"), F.coalesce("next", "id").alias("path")))
    while not state.where("next is not null").isEmpty():
        ahead = state.select(F.col("id").alias("next"), F.col("next").alias("then"), F.col("steps").alias("more"), F.col("path").alias("further"))
        state = written(state.join(ahead, "next", "left").select("id", F.col("then").alias("next"), "closed", (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("further", "path").alias("path")))
    longest = state.groupBy("path").agg(F.max("steps").alias("most"))
    return state.join(longest, "path").select("id", "path", (F.col("most") - F.col("steps")).alias("place"), "closed")


def contour_lines(cells: DataFrame, interval: float, offset: float = 0.0, value: str = "z") -> DataFrame:
    """(line_id, pos, level, k, closed, x, y): vertices of all level lines in order; a ring repeats its first vertex at its end."""
    links = written(level_links(cells, interval, offset, value))
    ends = links.join(links.select(F.col("id").alias("next")), "next", "left_anti").select(F.col("next").alias("id"), F.lit(None).cast(links.schema["id"].dataType).alias("next"), "level", "k", F.col("next_x").alias("x"), F.col("next_y").alias("y"))
    nodes = links.select("id", "next", "level", "k", "x", "y").unionByName(ends)
    placed = written(ordered(nodes).join(nodes.drop("next"), "id"))
    again = placed.where("closed and place = 0").join(placed.where("closed").groupBy("path").agg(F.max("place").alias("last")), "path").withColumn("place", F.col("last") + 1).drop("last")
    return placed.unionByName(again).select(F.col("path").alias("line_id"), F.col("place").alias("pos"), "level", "k", "closed", "x", "y")


def line_facts(vertices: DataFrame) -> DataFrame:
    """(line_id, level, k, closed, vertices, length, area): the area of a ring is positive around higher ground, negative around lower."""
    w = Window.partitionBy("line_id").orderBy("pos")
    step = vertices.withColumn("bx", F.lead("x").over(w)).withColumn("by", F.lead("y").over(w))
    return step.groupBy("line_id", "level", "k", "closed").agg(F.count("*").alias("vertices"), F.coalesce(F.sum(F.hypot(F.col("bx") - F.col("x"), F.col("by") - F.col("y"))), F.lit(0.0)).alias("length"), F.when(F.first("closed"), F.sum(F.col("x") * F.col("by") - F.col("bx") * F.col("y")) / 2).alias("area"))


def helper_runs(vertices: DataFrame, main: DataFrame, gap: float, least: float) -> DataFrame:
    """(line_id, run, level, first, last, vertices, length): stretches of helper lines whose vertices keep ``gap`` from all segments of ``main``, no shorter than ``least``."""
    w = Window.partitionBy("line_id").orderBy("pos")
    segments = main.withColumn("bx", F.lead("x").over(w)).withColumn("by", F.lead("y").over(w)).where("bx is not null").select(F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by")
    close = J.beside_segments(vertices.select("line_id", "pos", "x", "y"), segments, gap).select("line_id", "pos", F.lit(True).alias("close"))
    free = vertices.join(close, ["line_id", "pos"], "left").where("close is null")
    run = free.withColumn("run", F.col("pos") - F.row_number().over(w)).withColumn("bx", F.lead("x").over(Window.partitionBy("line_id", "run").orderBy("pos"))).withColumn("by", F.lead("y").over(Window.partitionBy("line_id", "run").orderBy("pos")))
    out = run.groupBy("line_id", "run", "level").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("vertices"), F.coalesce(F.sum(F.hypot(F.col("bx") - F.col("x"), F.col("by") - F.col("y"))), F.lit(0.0)).alias("length"))
    return out.where(F.col("length") >= least)


def slope_ticks(facts: DataFrame, least: float, each: float, most: int) -> Column:
    """Ticks on a ring around lower ground: one from a perimeter of ``least`` on, one more for every ``each``, ``most`` at the most."""
    down = F.col("closed") & (F.col("area") < 0) & (F.col("length") >= least)
    return F.when(down, F.least(F.lit(most), 1 + F.floor(F.col("length") / each))).otherwise(0).cast("long")
