"""Cliffs from short ticks: ticks chained to ordered lines, shapes judged, dense fields made rock areas.

A tick has two ends. An end looks for the nearest end that goes on in its direction; pairs are picked nearest first, each end once, in
rounds of mutual choices. Leaving a tick by one end is an element of a linked list, the next being to leave the tick that was met by
its other end; pointer jumping orders both ways through every chain, and one of them is kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators import contours, focal, graph, sequence
from geoloom.operators import lines as L
from geoloom.operators import spatial_join as J
from geoloom.sources.store import written


@dataclass(frozen=True)
class Rules:
    """Metres, degrees and square metres. The values are fixed by the results that are asked for."""

    gap: float = 6.0
    least: float = 0.15
    angle: float = 40.0
    along: float = 0.35
    simplify: float = 0.55
    shape: float = 3.5
    sinuosity: float = 1.45
    turn: float = 95.0
    buffer: float = 2.6
    close: float = 2.0
    open: float = 3.2
    shrink: float = 1.5
    smooth: float = 1.0
    aspect: float = 5.0
    aspect_width: float = 9.0
    halo: float = 3.5


def distinct_ticks(ticks: DataFrame) -> DataFrame:
    """Ticks (id, ax, ay, bx, by) less those within about a metre and an eighth of a radian of a lesser one; ticks without length go."""
    angle = F.pmod(F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")), F.lit(math.pi))
    key = [F.round((F.col("ax") + F.col("bx")) / 2), F.round((F.col("ay") + F.col("by")) / 2), F.pmod(F.round(angle * 8).cast("long"), F.lit(25))]
    return ticks.where("ax <> bx or ay <> by").withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).where("__n = 1").drop("__n")


def _middles(ticks: DataFrame) -> DataFrame:
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    n = F.hypot(dx, dy)
    return ticks.select("id", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"), (dx / n).alias("tx"), (dy / n).alias("ty"), "ax", "ay", "bx", "by")


def tick_links(ticks: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(a, b, cost): ends that are joined, twice the tick's id plus one for its end b; the cost is the squared distance of the middles."""
    m = _middles(ticks).drop("ax", "ay", "bx", "by")
    o = m.select(F.col("id").alias("other"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("tx").alias("ux"), F.col("ty").alias("uy"))
    dx, dy = F.col("rx") - F.col("x"), F.col("ry") - F.col("y")
    ahead, back = F.col("tx") * dx + F.col("ty") * dy, F.col("ux") * dx + F.col("uy") * dy
    like = F.abs(F.col("tx") * F.col("ux") + F.col("ty") * F.col("uy")) >= math.cos(math.radians(rules.angle))
    on = rules.along * F.sqrt("d2")
    near = J.within(m, o, rules.gap).where((F.col("id") < F.col("other")) & (F.col("d2") >= rules.least**2) & like & (F.abs(ahead) >= on) & (F.abs(back) >= on))
    end = lambda who, forward: F.col(who) * 2 + forward.cast("long")
    return graph.matched(near.select(end("id", ahead > 0).alias("a"), end("other", back < 0).alias("b"), F.col("d2").alias("cost")))


def chained_ticks(ticks: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(line_id, pos, x, y, closed, ticks): lines through the middles of chained ticks, from the outer end of the first to that of the last.

    A chain runs from its lesser end tick to the other; a ring repeats its first middle. A tick alone is a line of its own.
    """
    links = written(tick_links(ticks, rules))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = ticks.select(F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("id"))
    steps = ends.join(both.toDF("id", "met"), "id", "left").select("id", F.col("met").bitwiseXOR(F.lit(1)).alias("next"))
    way = written(contours.ordered(steps).withColumn("tick", F.shiftright("id", 1)))
    ways = way.groupBy("path", "closed").agg(F.min_by("id", "place").alias("first"), F.max_by("id", "place").alias("last"), F.min("tick").alias("least"), F.countDistinct("tick").alias("ticks"))
    odd = way.where("id % 2 = 1").select("path", F.col("tick").alias("least")).withColumn("odd", F.lit(True))
    a, b = F.shiftright("first", 1), F.shiftright("last", 1)
    keep = F.when(F.col("closed"), F.coalesce("odd", F.lit(False))).otherwise((a < b) | ((a == b) & (F.col("first") % 2 == 1)))
    kept = ways.join(odd, ["path", "least"], "left").where(keep).select("path", "ticks")
    rows = written(way.join(kept, "path").where(F.col("place") < F.col("ticks")).join(_middles(ticks).withColumnRenamed("id", "tick"), "tick"))
    p = lambda pos, x, y: F.struct(pos.cast("long").alias("pos"), x.alias("x"), y.alias("y"))
    leaves_by_b = F.col("id") % 2 == 1
    start, end = (F.when(leaves_by_b, F.col("ax")).otherwise(F.col("bx")), F.when(leaves_by_b, F.col("ay")).otherwise(F.col("by"))), (F.when(leaves_by_b, F.col("bx")).otherwise(F.col("ax")), F.when(leaves_by_b, F.col("by")).otherwise(F.col("ay")))
    alone = F.col("ticks") == 1
    points = F.array(
        F.when(~F.col("closed") & (F.col("place") == 0), p(F.lit(0), *start)),
        F.when(~alone | F.col("closed"), p(F.col("place") + 1, F.col("x"), F.col("y"))),
        F.when(F.col("closed") & (F.col("place") == 0), p(F.col("ticks") + 1, F.col("x"), F.col("y"))),
        F.when(~F.col("closed") & (F.col("place") == F.col("ticks") - 1), p(F.col("ticks") + 1, *end)),
    )
    return rows.select(F.col("path").alias("line_id"), "closed", "ticks", F.explode(F.array_compact(points)).alias("p")).select("line_id", "p.pos", "p.x", "p.y", "closed", "ticks")


def _measured(vertices: DataFrame, prefix: str) -> DataFrame:
    """(line_id, n, length, chord, turning) of each line, with a prefix."""
    w = Window.partitionBy("line_id").orderBy("pos")
    ahead = F.atan2(F.lead("y").over(w) - F.col("y"), F.lead("x").over(w) - F.col("x"))
    v = vertices.select("line_id", "pos", "x", "y", F.hypot(F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")).alias("len"), ahead.alias("ahead"))
    turn = F.abs(F.pmod(F.col("ahead") - F.lag("ahead").over(w) + math.pi, F.lit(2 * math.pi)) - math.pi)
    at = lambda f: f(F.struct("x", "y"), F.col("pos"))
    got = v.withColumn("turn", F.degrees(turn)).groupBy("line_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0.0)).alias("length"), at(F.min_by).alias("p"), at(F.max_by).alias("q"), F.coalesce(F.sum("turn"), F.lit(0.0)).alias("turning"))
    return got.select("line_id", F.col("n").alias(f"{prefix}n"), F.col("length").alias(f"{prefix}length"), F.hypot(F.col("p.x") - F.col("q.x"), F.col("p.y") - F.col("q.y")).alias(f"{prefix}chord"), F.col("turning").alias(f"{prefix}turning"))


def judged(vertices: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(line_id, length, chord, sinuosity, turning, crosses, simple): whether a line, roughly simplified, is straight enough to be drawn as a bank."""
    v = written(vertices.select("line_id", F.col("pos").cast("long").alias("pos"), "x", "y"))
    whole = _measured(v, "")
    rough = _measured(v.join(L.simplified(v, rules.shape), ["line_id", "pos"], "left_semi"), "s_")
    seg = sequence.segments(v)
    a = seg.select(F.col("line_id").alias("a_id"), F.col("pos").alias("a_seg"), "ax", "ay", "bx", "by")
    b = seg.select(F.col("line_id").alias("b_id"), F.col("pos").alias("b_seg"), F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("bx").alias("dx"), F.col("by").alias("dy"))
    crosses = J.crossings(a, b, 16.0).where("a_id = b_id and a_seg < b_seg").select(F.col("a_id").alias("line_id")).distinct().withColumn("crosses", F.lit(True))
    both = whole.join(rough, "line_id").join(crosses, "line_id", "left").withColumn("crosses", F.coalesce("crosses", F.lit(False))).withColumn("sinuosity", F.try_divide("s_length", "s_chord"))
    loop = (F.col("chord") < 1e-3) | ((F.col("chord") < 0.25 * F.col("length")) & (F.col("chord") < 8))
    zigzag = (F.col("s_n") >= 8) & (F.col("s_length") > 0.85 * F.col("length")) & (F.col("s_turning") > 0.7 * rules.turn)
    fine = ~loop & ~F.col("crosses") & ~zigzag & (F.col("s_chord") >= 1e-3) & (F.col("sinuosity") <= rules.sinuosity) & (F.col("s_turning") <= rules.turn)
    return both.select("line_id", "length", "chord", "sinuosity", F.col("s_turning").alias("turning"), "crosses", F.coalesce(fine, F.lit(False)).alias("simple"))


def banks(ticks: DataFrame, least: float, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame]:
    """Vertices (line_id, pos, x, y) of the lines through chained ticks that are simple and at least ``least`` long; and all lines with their measures."""
    chains = written(chained_ticks(distinct_ticks(ticks), rules))
    thin = written(chains.join(L.simplified(chains, rules.simplify), ["line_id", "pos"], "left_semi"))
    facts = written(judged(thin, rules).join(chains.select("line_id", "closed", "ticks").distinct(), "line_id"))
    good = facts.where(F.col("simple") & (F.col("length") >= least)).select("line_id")
    return thin.join(good, "line_id", "left_semi").select("line_id", "pos", "x", "y"), facts


def _grown(cells: DataFrame, radius: float) -> DataFrame:
    return focal.disk_dilate(cells, radius).select("rr", "cc")


def _shrunk(cells: DataFrame, radius: float) -> DataFrame:
    element = focal.disk(radius)
    return focal.shifted(cells.select("rr", "cc"), element).groupBy("rr", "cc").agg(F.count("*").alias("n")).where(F.col("n") == len(element)).select("rr", "cc")


def rock_cells(ticks: DataFrame, size: float = 1.0, rules: Rules = Rules()) -> DataFrame:
    """Cells of dense ticks: bands around the ticks, closed, opened (thin walls go), shrunk and smoothed with disks."""
    band = written(L.band_cells(ticks, rules.buffer, size).distinct())
    closed = _shrunk(_grown(band, rules.close / size), rules.close / size)
    opened = written(_grown(_shrunk(written(closed), rules.open / size), rules.open / size))
    slim = _shrunk(opened, rules.shrink / size)
    return written(_shrunk(_grown(slim, rules.smooth / size), rules.smooth / size))


def _linked(cells: DataFrame) -> DataFrame:
    """(rr, cc, area): cells with the number of the region that they are connected to by sides."""
    own = written(cells.withColumn("id", F.monotonically_increasing_id()))
    links = focal.shifted(own.withColumnRenamed("id", "a"), [(0, 1), (1, 0)]).drop("dy", "dx").join(own.withColumnRenamed("id", "b"), ["rr", "cc"]).select("a", "b")
    return own.join(graph.labelled(own, links), "id").select("rr", "cc", F.col("component").alias("area"))


def extents(cells: DataFrame, by: str, size: float, step: int = 5) -> DataFrame:
    """(by, cells, width, length): sides of the smallest of the rectangles around a region's cells in directions ``step`` degrees apart."""
    turns = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(math.cos(math.radians(d))).alias("c"), F.lit(math.sin(math.radians(d))).alias("s")) for d in range(0, 90, step)))).alias("t")
    x, y = (F.col("cc") + 0.5) * size, (F.col("rr") + 0.5) * size
    u, v = x * F.col("t.c") + y * F.col("t.s"), y * F.col("t.c") - x * F.col("t.s")
    span = lambda c: F.max(c) - F.min(c) + size
    each = cells.select(by, "rr", "cc", turns).groupBy(by, "t.d").agg(span(u).alias("a"), span(v).alias("b"), F.count("*").alias("n"))
    best = each.groupBy(by).agg(F.min(F.struct((F.round(F.col("a") * F.col("b"), 6)).alias("area"), "d", "a", "b", "n")).alias("m"))
    return best.select(by, F.col("m.n").alias("cells"), F.least("m.a", "m.b").alias("width"), F.greatest("m.a", "m.b").alias("length"))


def rock_areas(ticks: DataFrame, size: float = 1.0, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rr, cc, area) of rock areas, (area, cells, width, length), and the ticks (id, ax, ay, bx, by) whose middle is not within the halo of one. Long narrow areas are walls and none."""
    named = written(_linked(rock_cells(ticks, size, rules)))
    facts = written(extents(named, "area", size).where(~((F.col("length") > rules.aspect * F.col("width")) & (F.col("width") < rules.aspect_width))))
    kept = written(named.join(facts.select("area"), "area", "left_semi"))
    near = _grown(kept, rules.halo / size)
    at = ticks.select("*", F.floor((F.col("ay") + F.col("by")) / 2 / size).alias("rr"), F.floor((F.col("ax") + F.col("bx")) / 2 / size).alias("cc"))
    return kept, facts, at.join(near, ["rr", "cc"], "left_anti").drop("rr", "cc")
