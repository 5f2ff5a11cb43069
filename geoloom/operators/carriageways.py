"""Carriageways between kerbs: from stations along an axis the first kerb on either side, smoothed, with gaps bridged.

Rays and kerbs meet on cells; each ray keeps its nearest hit. What follows are windows along an axis: medians, runs, and
interpolation between the runs that hold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators import sequence
from geoloom.operators import spatial_join as J
from geoloom.sources.store import written


@dataclass(frozen=True)
class Rules:
    """Metres and stations. The values are fixed by the results that are asked for."""

    step: float = 2.0
    reach: float = 15.0
    least_side: float = 1.0
    width: tuple[float, float] = (2.5, 30.0)
    half_window: int = 2
    least_run: int = 3
    gap: float = 30.0
    measured: float = 0.5
    junction: float = 1.0


def axis_stations(segments: DataFrame, step: float) -> DataFrame:
    """(line_id, i, m, x, y, nx, ny): stations each ``step`` along every axis and one at its end, if more than 5 cm on; n points to the left."""
    inner = sequence.stations(segments, step).select("line_id", "m", "x", "y", "tx", "ty")
    at = lambda c: F.max_by(c, "pos")
    whole = segments.where("len > 0").groupBy("line_id").agg(F.max(F.col("m0") + F.col("len")).alias("length"), at(F.struct("bx", "by", ((F.col("bx") - F.col("ax")) / F.col("len")).alias("tx"), ((F.col("by") - F.col("ay")) / F.col("len")).alias("ty"))).alias("e"))
    last = inner.groupBy("line_id").agg(F.max("m").alias("last"))
    end = whole.join(last, "line_id").where("length - last > 0.05").select("line_id", F.col("length").alias("m"), F.col("e.bx").alias("x"), F.col("e.by").alias("y"), "e.tx", "e.ty")
    i = F.row_number().over(Window.partitionBy("line_id").orderBy("m")) - 1
    return inner.unionByName(end).select("line_id", i.alias("i"), "m", "x", "y", (-F.col("ty")).alias("nx"), F.col("tx").alias("ny"))


def kerb_distances(stations: DataFrame, kerbs: DataFrame, reach: float) -> DataFrame:
    """(line_id, i, left, right): the distance from each station to the first kerb (ax, ay, bx, by) that its perpendicular crosses on either side, null for none within reach."""
    side = F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("side")
    ray = stations.select("line_id", "i", "x", "y", "nx", "ny", side).select(F.col("line_id").alias("a_id"), F.col("i").alias("a_seg"), "side", F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + F.col("side") * reach * F.col("nx")).alias("bx"), (F.col("y") + F.col("side") * reach * F.col("ny")).alias("by"))
    edge = kerbs.select("ax", "ay", "bx", "by").distinct().select(F.lit(0).alias("b_id"), F.lit(0).alias("b_seg"), *(F.col(p).alias(q) for p, q in zip(("ax", "ay", "bx", "by"), ("cx", "cy", "dx", "dy"))))
    off = lambda p, q: (F.col("dx") - F.col("cx")) * (F.col(q) - F.col("cy")) - (F.col("dy") - F.col("cy")) * (F.col(p) - F.col("cx"))
    t = F.try_divide(off("ax", "ay"), off("ax", "ay") - off("bx", "by"))
    hit = J.crossings(ray, edge, 16.0).groupBy("a_id", "a_seg").agg(*((F.min(F.when(F.col("side") == s, t)) * reach).alias(n) for n, s in (("left", 1.0), ("right", -1.0))))
    return stations.select("line_id", "i").join(hit.withColumnsRenamed({"a_id": "line_id", "a_seg": "i"}), ["line_id", "i"], "left")


def _run(held: str):
    """Number of the run of rows, in the order of i, that have a value."""
    w = Window.partitionBy("line_id").orderBy("i")
    return F.col("i") - F.sum(F.col(held).isNotNull().cast("int")).over(w)


def carriageways(segments: DataFrame, kerbs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(line_id, run, i, m, left, right, lx, ly, rx, ry): stations with the carriageway's edges; consecutive ones of a run bound its polygon.

    ``segments``: axes as line_id, pos, ax, ay, bx, by, len, m0. A station counts with kerbs on both sides at a fitting width; its sides are
    medians over the stations around. On axes that are mostly measured, gaps between runs are bridged linearly, and from the outer runs to
    an end that lies on another axis with the same width, if no longer than ``gap``. Axes shorter than ``least_run`` steps have none.
    """
    shape = sequence.line_shapes(segments)
    segments = written(segments.join(shape.where("line_id = shape").select("line_id", "copies"), "line_id"))
    st = written(axis_stations(segments, rules.step))
    total = F.col("left") + F.col("right")
    ok = (F.least("left", "right") >= rules.least_side) & total.between(*rules.width)
    seen = st.join(kerb_distances(st, kerbs, rules.reach), ["line_id", "i"]).withColumn("ok", F.coalesce(ok, F.lit(False)))
    around = Window.partitionBy("line_id").orderBy("i").rowsBetween(-rules.half_window, rules.half_window)
    line = Window.partitionBy("line_id")
    valid = seen.withColumns({c: F.when(F.col("ok"), F.col(c)) for c in ("left", "right")})
    median = lambda c: F.when(F.col("ok"), F.expr(f"percentile({c}, 0.5)").over(around))
    smooth = written(valid.select("line_id", "i", "m", "x", "y", "nx", "ny", "ok", median("left").alias("left"), median("right").alias("right")))
    share = F.avg(F.col("ok").cast("double")).over(line)
    runs = smooth.withColumn("share", share).withColumn("run", F.when(F.col("ok"), _run("left")))
    size = F.count("*").over(Window.partitionBy("line_id", "run"))
    held = F.struct("m", "left", "right")
    anchored = runs.withColumn("anchor", F.when(F.col("ok") & (size >= rules.least_run), held))
    order = Window.partitionBy("line_id").orderBy("i")
    before, after = F.last("anchor", True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.first("anchor", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    placed = anchored.withColumn("p", before).withColumn("q", after)
    p = lambda x, y, k: F.struct(F.lit(k).alias("end"), x.alias("x"), y.alias("y"))
    tips = segments.groupBy("line_id").agg(F.min_by(F.struct("ax", "ay"), "pos").alias("a"), F.max_by(F.struct("bx", "by"), "pos").alias("b")).select("line_id", F.explode(F.array(p(F.col("a.ax"), F.col("a.ay"), "start"), p(F.col("b.bx"), F.col("b.by"), "finish"))).alias("t")).select("line_id", "t.*")
    other = segments.select(F.col("line_id").alias("other"), "copies", "ax", "ay", "bx", "by")
    joined = J.beside_segments(tips, other, rules.junction, (F.col("line_id") != F.col("other")) | (F.col("copies") > 1)).groupBy("line_id").agg(F.max((F.col("end") == "start").cast("int")).alias("start"), F.max((F.col("end") == "finish").cast("int")).alias("finish"))
    d = placed.join(joined, "line_id", "left")
    gap = F.col("q.m") - F.col("p.m")
    t = F.try_divide(F.col("m") - F.col("p.m"), gap)
    good = F.col("share") >= rules.measured
    length = F.max("m").over(line)

    def filled(c: str):
        inside = F.when(F.col("anchor").isNull() & (gap <= rules.gap), F.col(f"p.{c}") + t * (F.col(f"q.{c}") - F.col(f"p.{c}")))
        first = F.when(F.col("p").isNull() & (F.col("start") == 1) & (F.col("q.m") <= rules.gap), F.col(f"q.{c}"))
        last = F.when(F.col("q").isNull() & (F.col("finish") == 1) & (length - F.col("p.m") <= rules.gap), F.col(f"p.{c}"))
        return F.coalesce(F.when(good, F.coalesce(inside, first, last)), F.col(c))

    out = d.select("line_id", "i", "m", "x", "y", "nx", "ny", length.alias("length"), filled("left").alias("left"), filled("right").alias("right")).where(F.floor(F.col("length") / rules.step) >= rules.least_run)
    out = written(out.withColumn("run", F.when(F.col("left").isNotNull(), _run("left"))).where("left is not null"))
    kept = out.groupBy("line_id", "run").agg(F.count("*").alias("k")).where(F.col("k") >= rules.least_run).select("line_id", "run")
    edge = lambda c, n, s, w: (F.col(c) + s * F.col(n) * F.col(w))
    out = out.join(kept, ["line_id", "run"], "left_semi").withColumnRenamed("line_id", "shape").join(shape, "shape")
    return out.select("line_id", "run", "i", "m", "left", "right", edge("x", "nx", 1, "left").alias("lx"), edge("y", "ny", 1, "left").alias("ly"), edge("x", "nx", -1, "right").alias("rx"), edge("y", "ny", -1, "right").alias("ry"))


def carriageway_sizes(edges: DataFrame) -> DataFrame:
    """(line_id, run, stations, first, last, width, area): each run's mean width and the area of its quadrilaterals."""
    w = Window.partitionBy("line_id", "run").orderBy("i")
    v = edges.select("*", *(F.lead(c).over(w).alias(f"n{c}") for c in ("lx", "ly", "rx", "ry")))
    ring = [("lx", "ly"), ("nlx", "nly"), ("nrx", "nry"), ("rx", "ry")]
    turn = sum((F.col(a) * F.col(d) - F.col(c) * F.col(b) for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1])), F.lit(0.0))
    return v.groupBy("line_id", "run").agg(F.count("*").alias("stations"), F.min("m").alias("first"), F.max("m").alias("last"), F.avg(F.col("left") + F.col("right")).alias("width"), F.sum(F.abs(turn) / 2).alias("area"))
