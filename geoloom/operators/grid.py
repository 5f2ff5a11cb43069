"""Gridding: points to cells, block statistics, regridding and zonal figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Heights and classes of the gridding rules.
GROUND, VEGETATION = 2, (3, 5)
CHM_STEPS = (1.0, 2.0, 4.0, 6.0)
GREEN_ZONES = ((1.0, 2.65, 1.0, None), (2.65, 3.4, 0.1, None), (3.4, 5.5, 0.2, 8.0))
SHADE_STEPS = (0.2, 0.35, 0.5, 0.7, 1.3, 2.6, 4.0)
MID_GREEN, DARK_GREEN = 4, 7


def cell(c: Column | str, size: float) -> Column:
    """Number of the cell that a coordinate lies in."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / F.lit(float(size))).cast("long")


def with_cell(df: DataFrame, size: float, row: str = "rr", col: str = "cc") -> DataFrame:
    return df.withColumn(row, cell("y", size)).withColumn(col, cell("x", size))


def surfaces(points: DataFrame, size: float) -> DataFrame:
    """Cells with count, ground hits, surface (highest vegetation), terrain (lowest point) and height range."""
    keyed = points.select(cell("y", size).alias("rr"), cell("x", size).alias("cc"), "z", "cls")
    return keyed.groupBy("rr", "cc").agg(
        F.count("*").alias("n"),
        F.sum((F.col("cls") == GROUND).cast("int")).alias("ground_hits"),
        F.max(F.when(F.col("cls").isin(*VEGETATION), F.col("z"))).alias("dsm"),
        F.min("z").alias("dem"),
        (F.max("z") - F.min("z")).alias("chm"),
    )


def terrain_surface(points: DataFrame, size: float) -> DataFrame:
    """Mean ground height and highest object height a cell."""
    keyed = points.select(cell("y", size).alias("rr"), cell("x", size).alias("cc"), "z", "cls")
    return keyed.groupBy("rr", "cc").agg(F.avg(F.when(F.col("cls") == GROUND, F.col("z"))).alias("terrain"), F.max(F.when(F.col("cls") != GROUND, F.col("z"))).alias("surface"))


def grid_dimension(spark, rows: int, cols: int) -> DataFrame:
    """All cells of a grid, made on the executors."""
    return spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("long").alias("rr"), (F.col("id") % cols).alias("cc"))


def densify(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """Every cell of the grid, with ``valid`` false where there was none."""
    return grid_dimension(cells.sparkSession, rows, cols).join(cells.withColumn("valid", F.lit(True)), ["rr", "cc"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def blocks(cells: DataFrame, k: int, *aggregates: Column) -> DataFrame:
    """Statistics of blocks of k x k cells."""
    return cells.groupBy(F.floor(F.col("rr") / k).cast("long").alias("br"), F.floor(F.col("cc") / k).cast("long").alias("bc")).agg(*aggregates)


def ladder(value: Column, steps=CHM_STEPS) -> Column:
    """1, 2, ... below the rising steps, 0 above them all."""
    out = F.when(value < steps[0], 1)
    for i, s in enumerate(steps[1:], 2):
        out = out.when(value < s, i)
    return out.otherwise(0)


def canopy_height(surface: Column, terrain: Column) -> Column:
    return F.greatest(F.coalesce(surface, terrain) - terrain, F.lit(0.0))


def green_blocks(points: DataFrame, size: float = 2.0) -> DataFrame:
    """Green value of blocks by hits in height zones, with zone weights that look at the block's roof.

    The block's top is joined back to the points on the block key, so both
    aggregates share one partitioning.
    """
    keyed = points.select(cell("y", size).alias("br"), cell("x", size).alias("bc"), "hag", "rn", "nr")
    tops = keyed.groupBy("br", "bc").agg(F.max("hag").alias("top"))
    weight = F.lit(None).cast("double")
    for low, high, w, roof in reversed(GREEN_ZONES):
        inside = (F.col("hag") >= low) & (F.col("hag") < high)
        weight = F.when(inside if roof is None else inside & (F.col("top") < roof), F.lit(w)).otherwise(weight)
    last = (F.col("rn") == F.col("nr")).cast("double")
    hits = keyed.join(tops, ["br", "bc"]).groupBy("br", "bc").agg(
        F.max("top").alias("top"),
        F.sum(F.when(F.col("hag") < 1.0, 1).otherwise(0)).alias("low"),
        F.sum(F.when(F.col("rn") == 1, 1).otherwise(0)).alias("first"),
        F.sum(F.coalesce(weight, F.lit(0.0)) * last).alias("green"),
        F.sum(F.when(F.col("hag") >= 5.5, 1).otherwise(0)).alias("high"),
    )
    g = F.col("green") / (F.col("green") + F.col("low") + 1)
    hi = F.lit(0.2) + F.lit(0.8) * F.col("high") / (F.col("low") + F.col("green") + F.col("high") + 1)
    return hits.withColumn("value", g * hi)


def shade(value: Column, limit: float = 0.05) -> Column:
    """How many shade steps a green value passes."""
    return F.size(F.filter(F.array(*(F.lit(float(s)) for s in SHADE_STEPS)), lambda s: value > s * limit))


def shade_class(step: Column) -> Column:
    return F.when(step >= DARK_GREEN, 3).when(step >= MID_GREEN, 2).when(step >= 1, 1).otherwise(0)


def shares(cells: DataFrame, by: str, *more: Column) -> DataFrame:
    """Count and share of each class; the total is one row."""
    counts = cells.groupBy(by).agg(F.count("*").alias("n_cells"), *more)
    total = counts.agg(F.sum("n_cells").alias("total"))
    return counts.join(F.broadcast(total), F.lit(True)).withColumn("share", F.col("n_cells") / F.col("total")).drop("total")


def confusion(pairs: DataFrame, ref: str, ours: str, values: list) -> DataFrame:
    return pairs.groupBy(ref).pivot(ours, values).count().na.fill(0)


def match_scores(pairs: DataFrame, ref: Column, ours: Column) -> DataFrame:
    """Precision, recall and F1 of a mask against a reference mask."""
    hit, said, true = (F.sum(c.cast("long")) for c in (ref & ours, ours, ref))
    return pairs.agg(hit.alias("tp"), said.alias("positives"), true.alias("truth")).select(
        "tp", "positives", "truth",
        (F.col("tp") / F.nullif("positives", F.lit(0))).alias("precision"),
        (F.col("tp") / F.nullif("truth", F.lit(0))).alias("recall"),
        (2 * F.col("tp") / F.nullif(F.col("positives") + F.col("truth"), F.lit(0))).alias("f1"),
    )
