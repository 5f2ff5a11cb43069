"""Focal operators on dense cell tables (rr, cc, value), as separable windows.

A window function needs all cells of a row or column of a tile in one partition.
Rows of a raster are cut into tiles first (with a halo of the window's radius),
so that no partition holds a whole raster's row however wide it is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 512


def _tiled(cells: DataFrame, along: str, radius: int) -> DataFrame:
    """Cells with the tile along one axis; cells near an edge also go to the next tile, marked as halo."""
    at = F.col(along)
    own = F.floor(at / TILE)
    reach = F.sequence(F.floor((at - radius) / TILE), F.floor((at + radius) / TILE))
    return cells.withColumn("__t", F.explode(reach)).withColumn("__own", F.col("__t") == own)


def _pass(cells: DataFrame, along: str, across: str, radius: int, make) -> DataFrame:
    w = Window.partitionBy("__t", across).orderBy(along).rangeBetween(-radius, radius)
    return make(_tiled(cells, along, radius), w).where("__own").drop("__t", "__own")


def box(cells: DataFrame, radius: int, how: str = "sum", value: str = "v", out: str = "s") -> DataFrame:
    """Sum, min or max over (2 radius + 1) squared cells; null values are skipped and the grid's edge cuts the window."""
    f = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    rows = _pass(cells, "cc", "rr", radius, lambda d, w: d.withColumn("__h", f(value).over(w)))
    return _pass(rows, "rr", "cc", radius, lambda d, w: d.withColumn(out, f("__h").over(w))).drop("__h")


def box_mean(cells: DataFrame, radius: int, value: str = "v", out: str = "mean") -> DataFrame:
    """Mean over the window's valid cells."""
    once = cells.withColumn("__one", F.col(value).isNotNull().cast("long")).withColumn("__val", F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    summed = box(box(once, radius, "sum", "__val", "__s"), radius, "sum", "__one", "__n")
    return summed.withColumn(out, F.col("__s") / F.nullif("__n", F.lit(0))).drop("__one", "__val", "__s", "__n")


def box_std(cells: DataFrame, radius: int, value: str = "v", out: str = "std") -> DataFrame:
    """Standard deviation over the window: root of mean square less squared mean."""
    sq = box_mean(box_mean(cells.withColumn("__sq", F.col(value) * F.col(value)), radius, value, "__m"), radius, "__sq", "__m2")
    return sq.withColumn(out, F.sqrt(F.greatest(F.col("__m2") - F.col("__m") * F.col("__m"), F.lit(0.0)))).drop("__sq", "__m", "__m2")


def majority(cells: DataFrame, radius: int, mask: str = "v", out: str = "maj") -> DataFrame:
    return box_mean(cells.withColumn("__b", F.col(mask).cast("int")), radius, "__b", "__f").withColumn(out, F.col("__f") > 0.5).drop("__b", "__f")


def dilate(cells: DataFrame, radius: int, mask: str = "v", out: str = "v") -> DataFrame:
    """Square dilation."""
    return box(cells.withColumn("__b", F.col(mask).cast("int")), radius, "max", "__b", "__d").withColumn(out, F.col("__d") == 1).drop("__b", "__d")


def erode(cells: DataFrame, radius: int, mask: str = "v", out: str = "v") -> DataFrame:
    """Square erosion; outside the grid counts as set."""
    return box(cells.withColumn("__b", F.col(mask).cast("int")), radius, "min", "__b", "__d").withColumn(out, F.col("__d") == 1).drop("__b", "__d")


def opened(cells: DataFrame, radius: int, mask: str = "v", out: str = "v") -> DataFrame:
    return dilate(erode(cells, radius, mask, "__e"), radius, "__e", out).drop("__e")


def closed(cells: DataFrame, radius: int, mask: str = "v", out: str = "v") -> DataFrame:
    return erode(dilate(cells, radius, mask, "__e"), radius, "__e", out).drop("__e")


def disk(radius: float) -> list[tuple[int, int]]:
    r = math.floor(radius)
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= radius * radius]


def shifted(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each row once for every offset, moved by it; the offsets are literals, so no join is needed."""
    o = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets))).alias("o")
    rest = [c for c in cells.columns if c not in ("rr", "cc")]
    return cells.select("rr", "cc", *rest, o).select((F.col("rr") + F.col("o.dy")).alias("rr"), (F.col("cc") + F.col("o.dx")).alias("cc"), *rest, "o.dy", "o.dx")


def disk_dilate(cells: DataFrame, radius: float) -> DataFrame:
    """Cells (rr, cc) within a disk of the given cells; counts are combined before the shuffle."""
    return shifted(cells.select("rr", "cc"), disk(radius)).groupBy("rr", "cc").agg(F.count("*").alias("hits"))


def disk_sum(cells: DataFrame, radius: float, value: str = "v") -> DataFrame:
    return shifted(cells.select("rr", "cc", value), disk(radius)).groupBy("rr", "cc").agg(F.sum(value).alias("s"), F.count(value).alias("n"))


def gauss(cells: DataFrame, sigma: float, value: str = "v", out: str = "g", truncate: float = 2.0) -> DataFrame:
    """Masked Gaussian: weights of valid cells only, normalised; two one-dimensional passes."""
    radius = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]

    def one_axis(d: DataFrame, along: str, num: str, den: str) -> DataFrame:
        other = "rr" if along == "cc" else "cc"
        o = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in zip(range(-radius, radius + 1), weights)))).alias("o")
        moved = d.select(other, along, num, den, o).select(other, (F.col(along) + F.col("o.k")).alias(along), (F.col(num) * F.col("o.w")).alias(num), (F.col(den) * F.col("o.w")).alias(den))
        return moved.groupBy("rr", "cc").agg(F.sum(num).alias(num), F.sum(den).alias(den))

    base = cells.where(F.col(value).isNotNull()).select("rr", "cc", F.col(value).cast("double").alias("__a"), F.lit(1.0).alias("__b"))
    both = one_axis(one_axis(base, "cc", "__a", "__b"), "rr", "__a", "__b")
    return cells.join(both, ["rr", "cc"], "left").withColumn(out, F.col("__a") / F.col("__b")).drop("__a", "__b")


def gradient(cells: DataFrame, size: float, value: str = "v") -> DataFrame:
    """gx, gy: central differences inside, one-sided at the grid's edges."""

    def axis(d: DataFrame, along: str, across: str, out: str) -> DataFrame:
        def make(t: DataFrame, _) -> DataFrame:
            w = Window.partitionBy("__t", across).orderBy(along)
            a, b = F.lag(value).over(w), F.lead(value).over(w)
            a1, b1 = F.lag(along).over(w), F.lead(along).over(w)
            return t.withColumn(out, (F.when(b1.isNotNull(), b).otherwise(F.col(value)) - F.when(a1.isNotNull(), a).otherwise(F.col(value))) / ((F.coalesce(b1, F.col(along)) - F.coalesce(a1, F.col(along))) * size))

        return _pass(d, along, across, 1, make)

    return axis(axis(cells, "cc", "rr", "gx"), "rr", "cc", "gy")


def slope_degrees() -> Column:
    return F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))))


def hillshade(azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    """Lambert shading, 0 to 255."""
    az, alt = math.radians(360.0 - azimuth + 90.0), math.radians(altitude)
    slope = F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    aspect = F.atan2(F.col("gy"), -F.col("gx"))
    lit = F.lit(math.sin(alt)) * F.cos(slope) + F.lit(math.cos(alt)) * F.sin(slope) * F.cos(F.lit(az) - aspect)
    return F.greatest(F.lit(0.0), lit) * 255.0
