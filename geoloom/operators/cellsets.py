"""Areas as sets of cells: rasterising, set algebra, ownership, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators import focal


def box_cells(boxes: DataFrame, size: float, *keep: str) -> DataFrame:
    """Cells whose centre lies in a box (x0, y0, x1, y1); lower edges belong to it."""
    first = lambda c: F.ceil(F.col(c) / size - 0.5).cast("long")
    last = lambda c: (F.ceil(F.col(c) / size - 0.5) - 1).cast("long")
    span = lambda a, b: F.when(last(b) >= first(a), F.sequence(first(a), last(b))).otherwise(F.array().cast("array<bigint>"))
    return boxes.withColumn("rr", F.explode(span("y0", "y1"))).withColumn("cc", F.explode(span("x0", "x1"))).select("rr", "cc", *keep)


def ring_cells(rings: DataFrame, size: float, *keep: str) -> DataFrame:
    """Cells whose centre lies in a ring array<struct<x, y>>, row by row: crossings of the row's middle, in pairs."""
    ys = F.transform("ring", lambda p: p["y"])
    rows = F.sequence(F.ceil(F.array_min(ys) / size - 0.5).cast("long"), F.floor(F.array_max(ys) / size - 0.5).cast("long"))
    spread = rings.where(F.array_max(ys) - F.array_min(ys) > 0).withColumn("rr", F.explode(F.when(F.floor(F.array_max(ys) / size - 0.5) >= F.ceil(F.array_min(ys) / size - 0.5), rows).otherwise(F.array().cast("array<bigint>"))))
    y = (F.col("rr") + 0.5) * size
    moved = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    edges = F.zip_with("ring", moved, lambda a, b: F.when((a["y"] > y) != (b["y"] > y), a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"])))
    xs = F.array_sort(F.array_compact(edges))
    pairs = F.filter(F.transform(xs, lambda x, i: F.struct(i.alias("i"), x.alias("a"), F.try_element_at(xs, i + 2).alias("b"))), lambda s: s["i"] % 2 == 0)
    flat = spread.select("rr", *keep, F.explode(pairs).alias("p"))
    first, last = F.ceil(F.col("p.a") / size - 0.5).cast("long"), F.ceil(F.col("p.b") / size - 0.5).cast("long") - 1
    return flat.select("rr", *keep, F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))).alias("cc")).select("rr", "cc", *keep)


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("rr", "cc")
    for p in parts[1:]:
        out = out.unionByName(p.select("rr", "cc"))
    return out.distinct()


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("rr", "cc").distinct(), ["rr", "cc"], "left_anti")


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("rr", "cc").distinct(), ["rr", "cc"], "left_semi")


def owned(cells: DataFrame, rank: Column, owner: str) -> DataFrame:
    """One owner a cell: the one of least rank, then of least name."""
    return cells.groupBy("rr", "cc").agg(F.min(F.struct(rank.alias("r"), F.col(owner).alias("o"))).alias("w")).select("rr", "cc", F.col("w.o").alias(owner))


def highest(cells: DataFrame, level: str, ident: str) -> DataFrame:
    """Level cut: in each cell the rows of the highest level stay."""
    top = cells.groupBy("rr", "cc").agg(F.max(level).alias("__top"))
    return cells.join(top, ["rr", "cc"]).where(F.col(level) == F.col("__top")).drop("__top")


def edges(cells: DataFrame, cls: str) -> DataFrame:
    """Cell edges where the class differs from the neighbour's, with both classes (null: none)."""
    pairs = focal.shifted(cells.select("rr", "cc", F.col(cls).alias("other")), [(0, 1), (1, 0), (0, -1), (-1, 0)])
    return cells.select("rr", "cc", cls).join(pairs, ["rr", "cc"]).where(F.col(cls) != F.col("other"))


def perimeter(cells: DataFrame, by: str) -> DataFrame:
    """Number of cell edges around each area: four a cell less two for each pair of neighbours.

    Neighbours meet in one grouping by edge: a join would be planned by the size of the areas' table, which doesn't tell how many cells they have.
    """
    own = cells.select(by, F.explode(F.array(*(F.struct(F.lit(d).alias("axis"), (F.col("rr") + y).alias("ey"), (F.col("cc") + x).alias("ex"), F.lit(far).alias("far")) for d, y, x, far in ((0, 0, 0, 0), (0, 1, 0, 1), (1, 0, 0, 0), (1, 0, 1, 1))))).alias("e")).select(by, "e.*")
    sides = own.groupBy(by, "axis", "ey", "ex").agg((F.count("*") - 2 * F.sum(F.col("far")) * F.sum(1 - F.col("far"))).alias("sides"))
    return sides.groupBy(by).agg(F.sum("sides").alias("perimeter"))
