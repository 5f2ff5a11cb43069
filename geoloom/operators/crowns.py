"""Tables of regions' properties, and single tree crowns on paved ground found by them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import focal, graph
from geoloom.operators import spatial_join as J
from geoloom.sources.store import written


def labelled(cells: DataFrame, *keep: str) -> DataFrame:
    """Cells (rr, cc) with their 4-connected region, named by its least cell in row order: (rr, cc, keep, region: struct<rr, cc>)."""
    own = written(cells.select("rr", "cc", *keep, F.struct("rr", "cc").alias("id")))
    links = focal.shifted(own.select("rr", "cc", F.col("id").alias("a")), [(0, 1), (1, 0)]).drop("dy", "dx").join(own.select("rr", "cc", F.col("id").alias("b")), ["rr", "cc"]).select("a", "b")
    return own.join(graph.labelled(own, links), "id").select("rr", "cc", *keep, F.col("component").alias("region"))


def properties(labels: DataFrame, size: float, value: str | None = None) -> DataFrame:
    """A row a region: cells, area, box (r0, c0, r1, c1), mean place in metres (x, y), perimeter, compactness (area over the circle around the box's longer
    side) and elongation by second moments; with ``value`` its highest, mean and median (counted, so exact) value."""
    stats = labels.groupBy("region").agg(
        F.count("*").alias("cells"), F.min("rr").alias("r0"), F.min("cc").alias("c0"), F.max("rr").alias("r1"), F.max("cc").alias("c1"), F.avg("rr").alias("mr"), F.avg("cc").alias("mc"),
        F.var_pop("rr").alias("vr"), F.var_pop("cc").alias("vc"), F.covar_pop("rr", "cc").alias("vrc"), *([F.max(value).alias("highest"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median")] if value else []),
    )
    inner = focal.shifted(labels.select("rr", "cc", "region"), [(0, 1), (1, 0)]).drop("dy", "dx").join(labels.select("rr", "cc", "region"), ["rr", "cc", "region"]).groupBy("region").agg(F.count("*").alias("inner"))
    c = F.col
    longest = F.greatest(c("r1") - c("r0"), c("c1") - c("c0")) + 1
    # a cell adds a twelfth to the moments of its centre
    half, root = (c("vr") + c("vc")) / 2 + 1 / 12, F.sqrt(((c("vr") - c("vc")) / 2) ** 2 + c("vrc") ** 2)
    return stats.join(inner, "region", "left").select(
        "region", "cells", (c("cells") * size * size).alias("area"), "r0", "c0", "r1", "c1", ((c("mc") + 0.5) * size).alias("x"), ((c("mr") + 0.5) * size).alias("y"),
        ((4 * c("cells") - 2 * F.coalesce(c("inner"), F.lit(0))) * size).alias("perimeter"), (c("cells") / (math.pi / 4 * longest * longest)).alias("compact"),
        F.sqrt((half + root) / (half - root)).alias("elongation"), *(["highest", "mean", "median"] if value else []),
    )


def diamond(radius: int) -> list[tuple[int, int]]:
    """Offsets of at most ``radius`` steps over cells' sides."""
    return [(r, c) for r in range(-radius, radius + 1) for c in range(abs(r) - radius, radius - abs(r) + 1)]


def rings(labels: DataFrame, radius: int, extent: tuple[int, int, int, int]) -> DataFrame:
    """(region, rr, cc): cells 2 to ``radius`` steps from each region, within the extent (first row, first column, past the last ones). Only cells on a
    region's edge are spread: the others' surroundings lie in theirs."""
    r0, c0, r1, c1 = extent
    own = labels.select("region", "rr", "cc")
    full = focal.shifted(own, [(0, 1), (1, 0), (0, -1), (-1, 0)]).drop("dy", "dx").groupBy("region", "rr", "cc").agg(F.count("*").alias("n")).where("n = 4").drop("n")
    edge = own.join(full, ["region", "rr", "cc"], "left_anti")
    near = focal.shifted(edge, diamond(radius)).groupBy("region", "rr", "cc").agg(F.min(F.abs("dy") + F.abs("dx")).alias("steps")).where("steps >= 2")
    inside = (F.col("rr") >= r0) & (F.col("rr") < r1) & (F.col("cc") >= c0) & (F.col("cc") < c1)
    return near.where(inside).select("region", "rr", "cc").join(own, ["region", "rr", "cc"], "left_anti")


def opened(cells: DataFrame, radius: float) -> DataFrame:
    """Cells of a set that a whole disk within the set covers."""
    disk = focal.disk(radius)
    core = focal.shifted(cells.select("rr", "cc"), disk).groupBy("rr", "cc").agg(F.count("*").alias("n")).where(F.col("n") == len(disk)).select("rr", "cc")
    return focal.disk_dilate(core, radius).select("rr", "cc")


@dataclass(frozen=True)
class Rules:
    """Metres, square metres and shares. The values are fixed by the results that are asked for."""

    tall: float = 3.0
    top: float = 5.0
    least: float = 12.0
    most: float = 250.0
    compact: float = 0.45
    around: float = 10.0
    around_share: float = 0.10
    other: float = 2.0
    green_reach: float = 2.0
    mass: float = 2.0
    crown_green: float = 0.30
    ground_green: float = 0.25
    existing: float = 8.0


def steps(metres: float, size: float) -> int:
    return max(1, round(metres / size))


def paved_trees(cells: DataFrame, existing: DataFrame, size: float, extent: tuple[int, int, int, int], rules: Rules = Rules()) -> DataFrame:
    """(x, y, area, highest, compact, others, crown_green, ground_green): single crowns on paved ground.

    ``cells`` (rr, cc, h, green, building, water) are unique; a cell that isn't given is flat, not green and free. Null counts as flat, not green, free.
    Height counts as a crown near green ground only. A crown has the right size, top and shape, little else that is tall around it, no tree (x, y) of
    ``existing`` within reach, green in its middle and grey ground around it, buildings and water aside.
    """
    no = F.lit(False)
    c = written(cells.select("rr", "cc", F.coalesce("h", F.lit(0.0)).alias("h"), *(F.coalesce(n, no).alias(n) for n in ("green", "building", "water"))))
    near = focal.disk_dilate(c.where("green"), steps(rules.green_reach, size)).select("rr", "cc").withColumn("near", F.lit(True))
    high = written(c.where((F.col("h") > rules.other) & ~F.col("building")).join(near, ["rr", "cc"], "left").select("rr", "cc", "h", F.coalesce("near", no).alias("near")))
    mass = opened(high.where("not near"), steps(rules.mass, size)).withColumn("mass", F.lit(True))
    other = written(high.join(mass, ["rr", "cc"], "left").where("near or mass").select("rr", "cc", F.lit(1).alias("other")))
    label = written(labelled(high.where(F.col("near") & (F.col("h") > rules.tall)), "h"))
    table = properties(label, size, "h").where(F.col("area").between(rules.least, rules.most) & (F.col("highest") >= rules.top) & (F.col("compact") >= rules.compact))
    table = written(table.select("region", "x", "y", "area", "highest", "compact"))
    ring = rings(label.join(table.select("region"), "region", "left_semi"), steps(rules.around, size), extent)
    share = ring.join(other, ["rr", "cc"], "left").groupBy("region").agg((F.count("other") / F.count("*")).alias("others"))
    lone = table.join(share, "region", "left").where(F.coalesce("others", F.lit(0.0)) <= rules.around_share)
    taken = J.within(table.select("region", "x", "y"), existing.select(F.col("x").alias("rx"), F.col("y").alias("ry")), rules.existing).select("region").distinct()
    lone = written(lone.join(taken, "region", "left_anti").select("region", "x", "y", "area", "highest", "compact", F.coalesce("others", F.lit(0.0)).alias("others")))
    r0, c0, r1, c1 = extent
    rad = F.sqrt(F.col("area") / math.pi)
    span = lambda v, a, b: F.sequence(F.greatest(F.floor((F.col(v) - 3 * rad) / size), F.lit(a)), F.least(F.floor((F.col(v) + 3 * rad) / size), F.lit(b - 1)))
    disk = lone.withColumn("rad", rad).withColumn("rr", F.explode(span("y", r0, r1))).withColumn("cc", F.explode(span("x", c0, c1)))
    d = F.hypot((F.col("cc") + 0.5) * size - F.col("x"), (F.col("rr") + 0.5) * size - F.col("y"))
    seen = disk.select("region", "rr", "cc", (d / F.col("rad")).alias("q")).where("q <= 0.7 or (q > 1.6 and q <= 3)").join(c.select("rr", "cc", "green", "building", "water"), ["rr", "cc"], "left")
    crown, ground = F.col("q") <= 0.7, (F.col("q") > 1.6) & ~F.coalesce(F.col("building") | F.col("water"), no)
    green = F.coalesce("green", no).cast("double")
    colour = seen.groupBy("region").agg(F.avg(F.when(crown, green)).alias("crown_green"), F.avg(F.when(ground, green)).alias("ground_green"))
    return lone.join(colour, "region").where((F.col("crown_green") >= rules.crown_green) & (F.col("ground_green") < rules.ground_green)).drop("region")
