"""Areas told apart by the lines that bound them: street space split by kerbs, and sea on the right of coast lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import graph
from geoloom.operators import planar as P
from geoloom.operators import spatial_join as J
from geoloom.sources.store import written


@dataclass(frozen=True)
class Rules:
    """Metres and square metres. The values are fixed by the results that are asked for."""

    least_area: float = 0.5
    axis: float = 2.0
    unpaved_share: float = 0.5


def _located(points: DataFrame, found: P.Faces, cell: float) -> DataFrame:
    """(key, face): the face around each point (key, x, y, in grid units) that is on no edge; null outside."""
    kept = found.sides.where("hid % 2 = 0").select("eid", F.col("ox").cast("double").alias("ux"), F.col("oy").cast("double").alias("uy"), F.col("dx").cast("double").alias("vx"), F.col("dy").cast("double").alias("vy"))
    below = P._below(points.select(F.col("key").alias("ring"), "x", "y"), kept, cell / found.grid)
    return points.select("key").join(below.select(F.col("ring").alias("key"), "hid").join(found.sides.select("hid", "face"), "hid"), "key", "left").select("key", "face")


def split_streets(streets: DataFrame, kerbs: DataFrame, axes: DataFrame, rules: Rules = Rules(), grid: float = P.GRID, cell: float = P.CELL) -> DataFrame:
    """(part, x, y, area, axis, unpaved, kind): the union of streets (fid, ring) cut by kerbs (ax, ay, bx, by, unpaved).

    A part with enough road axis (ax, ay, bx, by) inside is carriageway, one mostly bounded by unpaved kerbs is green, others are
    sidewalk. Outlines and axes are lines of the arrangement too, but faces that only they divide are one part. (x, y) is its least node.
    """
    kinds = P.ring_segments(streets).select("ax", "ay", "bx", "by", F.lit("street").alias("kind")).unionByName(kerbs.select("ax", "ay", "bx", "by", F.when(F.col("unpaved"), "unpaved").otherwise("kerb").alias("kind"))).unionByName(axes.select("ax", "ay", "bx", "by", F.lit("axis").alias("kind")))
    lines = written(kinds.distinct().withColumn("sid", F.monotonically_increasing_id()))
    net = P.noded(lines, grid, cell)
    found = P.faces(net, cell)
    is_ = lambda *k: F.max(F.col("kind").isin(*k))
    edge = written(net.sources.join(lines.select("sid", "kind"), "sid").groupBy("eid").agg(is_("kerb", "unpaved").alias("kerb"), is_("unpaved").alias("unpaved"), is_("axis").alias("axis")))
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxed = streets.select("ring").distinct().select("ring", F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    inside = written(J.points_in_boxes(P.inner_points(found), boxed, cell).where(J.ring_contains(F.col("x"), F.col("y"), F.col("ring"))).select("face").distinct())
    sides = written(P.neighbours(found).join(edge, "eid"))
    own = inside.withColumn("in", F.lit(True))
    both = sides.join(own.toDF("a", "ina"), "a", "left").join(own.toDF("b", "inb"), "b", "left")
    part = written(graph.labelled(inside.select(F.col("face").alias("id")), both.where("ina and inb and not kerb").select("a", "b")).toDF("face", "part"))
    rim = sides.join(part.toDF("a", "pa"), "a", "left").join(part.toDF("b", "pb"), "b", "left").withColumn("same", F.col("pa").eqNullSafe(F.col("pb")))
    rims = rim.where("not same").select("length", "unpaved", F.explode(F.array("pa", "pb")).alias("part")).where("part is not null").groupBy("part").agg((F.sum(F.when(F.col("unpaved"), F.col("length")).otherwise(0.0)) / F.sum("length")).alias("unpaved"))
    # axes that run through a part: on edges inside it, and on pieces that end within it and bound nothing
    through = rim.where("same and axis and pa is not null").select(F.col("pa").alias("part"), "length")
    gone = net.edges.join(edge.where("axis"), "eid").join(sides.select("eid"), "eid", "left_anti").withColumn("length", F.hypot((F.col("vx") - F.col("ux")).cast("double"), (F.col("vy") - F.col("uy")).cast("double")) * grid)
    gone = written(gone.select(F.col("eid").alias("key"), ((F.col("ux") + F.col("vx")) / 2).alias("x"), ((F.col("uy") + F.col("vy")) / 2).alias("y"), "length"))
    loose = gone.join(_located(gone, found, cell), "key").join(part, "face").select("part", "length")
    axis = through.unionByName(loose).groupBy("part").agg(F.sum("length").alias("axis"))
    size = part.join(found.faces, "face").groupBy("part").agg(F.sum("area").alias("area"))
    corner = found.sides.join(part, "face").groupBy("part").agg(F.min(F.struct("ox", "oy")).alias("p"))
    zero = F.lit(0.0)
    all_ = size.where(F.col("area") >= rules.least_area).join(corner, "part").join(rims, "part", "left").join(axis, "part", "left")
    kind = F.when(F.coalesce("axis", zero) >= rules.axis, "carriageway").when(F.coalesce("unpaved", zero) > rules.unpaved_share, "green").otherwise("sidewalk")
    return all_.select("part", (F.col("p.ox") * grid).alias("x"), (F.col("p.oy") * grid).alias("y"), "area", F.coalesce("axis", zero).alias("axis"), F.coalesce("unpaved", zero).alias("unpaved"), kind.alias("kind"))


def sea_faces(coast: DataFrame, bounds: tuple[float, float, float, float], grid: float = P.GRID, cell: float = P.CELL) -> DataFrame:
    """(face, x, y, area, vote, sea): faces into which coast lines (ax, ay, bx, by; sea on the right) cut a rectangle.

    Each piece of coast votes by its length: for sea on its right, for land on its left. Without coast inside there is one face and no sea.
    """
    x0, y0, x1, y1 = bounds
    frame = [(x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)]
    corners = F.explode(F.array(*(F.struct(*(F.lit(float(v)).alias(c) for v, c in zip(s, ("ax", "ay", "bx", "by")))) for s in frame))).alias("s")
    border = coast.sparkSession.range(1).select(corners).select("s.*", F.lit(False).alias("coast"))
    from geoloom.operators.lines import clipped

    cut = clipped(coast.select("ax", "ay", "bx", "by"), *bounds).select(F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("dx").alias("bx"), F.col("dy").alias("by"), F.lit(True).alias("coast"))
    cut = cut.groupBy(*cut.columns).agg(F.count("*").alias("n"))  # copies vote each
    lines = written(cut.unionByName(border.withColumn("n", F.lit(1))).withColumn("sid", F.monotonically_increasing_id()))
    net = P.noded(lines, grid, cell)
    found = P.faces(net, cell)
    told = net.sources.join(lines.where("coast"), "sid").select("eid", "n", (F.col("bx") - F.col("ax")).alias("lx"), (F.col("by") - F.col("ay")).alias("ly"))
    along = F.signum((F.col("dx") - F.col("ox")) * F.col("lx") + (F.col("dy") - F.col("oy")) * F.col("ly"))
    length = F.hypot((F.col("dx") - F.col("ox")).cast("double"), (F.col("dy") - F.col("oy")).cast("double")) * grid
    # a side has its face on the left: one that runs with the coast has land there
    votes = found.sides.where("face is not null").join(told, "eid").groupBy("face").agg(F.sum(-along * length * F.col("n")).alias("vote"))
    corner = found.sides.where("ring = face").groupBy("face").agg(F.min(F.struct("ox", "oy")).alias("p"))
    out = found.faces.join(corner, "face").join(votes, "face", "left").withColumn("vote", F.coalesce("vote", F.lit(0.0)))
    return out.select("face", (F.col("p.ox") * grid).alias("x"), (F.col("p.oy") * grid).alias("y"), "area", "vote", (F.col("vote") > 0).alias("sea"))
