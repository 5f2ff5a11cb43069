"""Queries over planar arrangements: enclosures of a fence network, and a coverage whose areas share their edges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.operators import carriageways
from geoloom.operators import enclosures as E
from geoloom.operators import graph as G
from geoloom.operators import partitions
from geoloom.operators import planar as P
from geoloom.sources import tables as T
from geoloom.sources.store import written


def _fences(spark, d):
    """Every area's outline as a fence from its lower left corner round to some metres (0 to 3) above it: a quarter are closed."""
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    c = F.col
    line = F.array(at(c("x0"), c("y0")), at(c("x1"), c("y0")), at(c("x1"), c("y1")), at(c("x0"), c("y1")), at(c("x0"), c("y0") + c("fid") % 4))
    sides = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(k.alias("pos"), line[k]["x"].alias("ax"), line[k]["y"].alias("ay"), line[k + 1]["x"].alias("bx"), line[k + 1]["y"].alias("by")))
    return T.rects(spark, d).select(c("fid").alias("line_id"), F.explode(sides).alias("s")).select("line_id", "s.*")


def grf12_enclosures(spark, d):
    """Faces of the fence network with its gaps bridged: large enough, not mostly bridges, and wide or private (gardens)."""
    gardens = T.rects(spark, d).where("kind = 'HOUSEHOLD'").select("fid", "x0", "y0", "x1", "y1")
    found, kept = E.enclosed(_fences(spark, d), gardens)
    corner = found.sides.where("ring = face").groupBy("face").agg(F.min(F.struct("ox", "oy")).alias("p"))
    to = lambda c, n: F.round(c, n).alias(c if isinstance(c, str) else None)
    return kept.join(corner, "face").select(F.round(F.col("p.ox") * found.grid, 2).alias("x"), F.round(F.col("p.oy") * found.grid, 2).alias("y"), to("area", 3), to("perimeter", 3), "holes", to("bridge_share", 5), to("private_share", 5), "compact")


def turned_fences(spark, d):
    """The same fences with lengths and measures, half of them the other way round; private and public ground."""
    back = F.col("line_id") % 8 >= 4
    f = _fences(spark, d).select("line_id", F.when(back, 3 - F.col("pos")).otherwise(F.col("pos")).alias("pos"), *(F.when(back, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))))
    f = f.withColumn("len", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    before = Window.partitionBy("line_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    r = T.rects(spark, d)
    return f.withColumn("m0", F.coalesce(F.sum("len").over(before), F.lit(0.0))), r.where("kind = 'HOUSEHOLD'"), r.where("kind = 'MACHINERY'")


def win15_fence_ticks(spark, d):
    """Fences whose ticks would point away from private ground, or out of a ring."""
    return E.oriented(*turned_fences(spark, d))


def _coverage(spark, d):
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1"))
    rank = F.element_at(F.create_map(*(F.lit(v) for kv in RANKS.items() for v in kv)), F.col("kind"))
    return P.coverage(T.rects(spark, d).select("fid", rank.alias("rank"), ring.alias("ring")))


def set14_coverage(spark, d):
    """What each area owns of a coverage that all areas were cut into: where several lie, the one of least rank."""
    found, owner = _coverage(spark, d)
    own = owner.join(found.faces, "face").groupBy("fid").agg(F.round(F.sum("area"), 2).alias("area"))
    return own.join(T.rects(spark, d).select("fid", "kind"), "fid").select("fid", "kind", "area")


def set14_pieces(spark, d):
    """The same as pieces: faces of one owner that share an edge, with their area and the length of the edges around them."""
    found, owner = _coverage(spark, d)
    sides = P.neighbours(found)
    both = written(sides.join(owner.toDF("a", "fa"), "a", "left").join(owner.toDF("b", "fb"), "b", "left"))
    piece = written(G.labelled(owner.select(F.col("face").alias("id")), both.where("fa = fb").select("a", "b")).withColumnRenamed("id", "face"))
    size = piece.join(owner, "face").join(found.faces, "face").groupBy("component", "fid").agg(F.sum("area").alias("area"))
    rim = both.where("not (fa <=> fb)").select("length", F.explode(F.array("a", "b")).alias("face")).join(piece, "face").groupBy("component").agg(F.sum("length").alias("rim"))
    return size.join(rim, "component").select("fid", F.round("area", 2).alias("area"), F.round("rim", 2).alias("rim"))


def jon35_street_space(spark, d):
    """Street areas cut by the outlines of others (unpaved ones by turns), with road axes along the middle of every third."""
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    r = T.rects(spark, d)
    ring = F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1"))
    streets = r.where("kind = 'MACHINERY'").select("fid", ring.alias("ring"))
    kerbs = P.ring_segments(r.where("kind = 'FURNITURE'").select("fid", ring.alias("ring"))).withColumn("unpaved", F.col("fid") % 2 == 0)
    middle = ((F.col("y0") + F.col("y1")) / 2).alias("ay")
    axes = r.where("kind = 'MACHINERY' and fid % 3 = 0").select(F.col("x0").alias("ax"), middle, F.col("x1").alias("bx"), middle.alias("by"))
    found = partitions.split_streets(streets, kerbs, axes)
    return found.select(*(F.round(c, 3).alias(c) for c in ("x", "y", "area", "axis")), F.round("unpaved", 5).alias("unpaved"), "kind")


def set17_sea(spark, d):
    """Faces of the area between coast lines (outlines below ground, by turns round to the left and to the right), and which are sea."""
    r = T.rects(spark, d).where("kind = 'AUTOMOBILE' and lvl = -1")
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1"))
    coast = P.ring_segments(r.select("fid", F.when(F.col("fid") % 2 == 0, ring).otherwise(F.reverse(ring)).alias("ring")))
    found = partitions.sea_faces(coast, (0.0, 0.0, 400.0, 400.0))
    return found.select(*(F.round(c, 3).alias(c) for c in ("x", "y", "area", "vote")), "sea")


def kerbed_axes(spark, d):
    """Axes along the middle of each street area, from 10 m before it to 10 m behind it, and all areas' outlines as kerbs."""
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    r = T.rects(spark, d)
    kerbs = P.ring_segments(r.select("fid", F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1")).alias("ring")))
    middle = (F.col("y0") + F.col("y1")) / 2 + 0.013
    axes = r.where("kind = 'MACHINERY'").select(F.col("fid").alias("line_id"), F.lit(0).alias("pos"), (F.col("x0") - 10).alias("ax"), middle.alias("ay"), (F.col("x1") + 10).alias("bx"), middle.alias("by"))
    return axes.withColumn("len", F.col("bx") - F.col("ax")).withColumn("m0", F.lit(0.0)), kerbs


def jon19_carriageways(spark, d):
    """Stretches of street axes with a kerb on both sides: stations, measures, mean width and area."""
    sizes = carriageways.carriageway_sizes(carriageways.carriageways(*kerbed_axes(spark, d)))
    return sizes.select("line_id", "stations", *(F.round(c, 3).alias(c) for c in ("first", "last", "width", "area")))


#: Of areas that lie over each other.
RANKS = {"BUILDING": 0, "MACHINERY": 1, "AUTOMOBILE": 2, "HOUSEHOLD": 3, "FURNITURE": 4}

SQL = {
    # all coordinates are tenths of a metre, so squares of that size have one owner
    "set14_coverage": f"""WITH r AS (SELECT fid, kind, CASE kind {' '.join(f"WHEN '{k}' THEN {v}" for k, v in RANKS.items())} END * 100000000 + fid AS o, CAST(round(x0 * 10) AS BIGINT) AS a0, CAST(round(x1 * 10) AS BIGINT) AS a1, CAST(round(y0 * 10) AS BIGINT) AS b0, CAST(round(y1 * 10) AS BIGINT) AS b1 FROM fx_rects),
      w AS (SELECT min(o) AS o FROM (SELECT o, cx, unnest(range(b0, b1)) AS cy FROM (SELECT o, b0, b1, unnest(range(a0, a1)) AS cx FROM r)) GROUP BY cx, cy)
      SELECT r.fid, r.kind, round(count(*) / 100, 2) AS area FROM w JOIN r ON r.o = w.o GROUP BY 1, 2""",
}

QUERIES = {f.__name__: f for f in (grf12_enclosures, set14_coverage, set14_pieces, jon35_street_space, set17_sea, jon19_carriageways, win15_fence_ticks)}
