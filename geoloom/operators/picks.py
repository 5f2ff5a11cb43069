"""Picks with a spacing and a quota by zone, best first: the same set as one by one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators import graph
from geoloom.operators import spatial_join as J
from geoloom.sources.store import written


@dataclass(frozen=True)
class Rules:
    """Metres and square metres; the gap is on paper. The values are fixed by the results that are asked for."""

    small: float = 500.0
    each: float = 300.0
    gap_mm: float = 4.0
    same: float = 4.0


#: Scores of mapped points: tall ones come first, flat ones are no objects. Fixed values.
MAPPED, TALL = 5.0, 10.0


def zone_picks(points: DataFrame, zones: DataFrame, gap: float) -> DataFrame:
    """(id, zone, rank): points (id, zone, x, y, score) that stay when each zone's are taken best first (then by id), no nearer than ``gap`` to one
    taken before, and no more than the zone's quota (zones: zone, quota).

    A zone with a quota of one has its best point. For the others spacing runs in rounds over all zones at once; the quota then takes the first of what
    it left, since leaving off later ones changes no earlier pick.
    """
    order = F.struct((-F.col("score")).alias("s"), F.col("id").alias("i"))
    several = zones.where("quota > 1").select("zone", "quota")
    best = points.join(zones.where("quota = 1").select("zone"), "zone", "left_semi").groupBy("zone").agg(F.min(order).alias("o"))
    best = best.select(F.col("o.i").alias("id"), "zone", F.lit(1).alias("rank"))
    p = written(points.join(several.select("zone"), "zone", "left_semi").select("id", "zone", "x", "y", "score", order.alias("o")))
    kept = p.join(graph.spaced(p, gap, "zone", open_end=True), "id", "left_semi")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("zone").orderBy("o")))
    return best.unionByName(ranked.join(several, "zone").where("rank <= quota").select("id", "zone", "rank"))


def playground_objects(grounds: DataFrame, mapped: DataFrame, detected: DataFrame, scale: int, rules: Rules = Rules()) -> DataFrame:
    """(id, zone, rank, source): the objects drawn on each ground (zone, area, x0, y0, x1, y1).

    Mapped points (id, x, y, tall, flat) come before detected ones (id, x, y, score), of which those beside a mapped one of the ground go. A small ground
    has one object, others keep a distance on paper and have one for every 300 square metres begun. A point lies in the ground of least zone.
    """
    box = written(grounds.groupBy(*J.BOX).agg(F.min("zone").alias("zone")))  # grounds of equal corners once: the least zone has their points
    inside = lambda d: J.points_in_boxes(d, box, 8.0).groupBy("id", "x", "y", "score", "source").agg(F.min("zone").alias("zone"))
    known = inside(mapped.where("not flat").select("id", "x", "y", F.when(F.col("tall"), TALL).otherwise(MAPPED).alias("score"), F.lit("mapped").alias("source")))
    known = written(known)
    found = written(inside(detected.select("id", "x", "y", F.col("score").cast("double").alias("score"), F.lit("detected").alias("source"))))
    beside = J.beside(found, known.select(F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("zone").alias("z")), rules.same, z="zone").select("id")
    every = known.unionByName(found.join(beside.hint("merge"), "id", "left_anti").select(*known.columns))
    key = F.struct((F.col("source") != "mapped").alias("found"), "id")  # of equal scores mapped ones are first
    named = written(every.withColumn("key", key))
    quota = F.when(F.col("area") <= rules.small, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("area") / rules.each)))
    picked = zone_picks(named.select(F.col("key").alias("id"), "zone", "x", "y", "score"), grounds.select("zone", quota.alias("quota")), rules.gap_mm * scale / 1000)
    return picked.select(F.col("id.id").alias("id"), "zone", "rank", F.when(F.col("id.found"), "detected").otherwise("mapped").alias("source"))
