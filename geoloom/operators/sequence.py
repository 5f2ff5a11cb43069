"""Operators along lines and time: measures, stations, runs, latest rows, rolling counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import times
from geoloom.sources.store import written


def segments(vertices: DataFrame, line: str = "line_id", pos: str = "pos") -> DataFrame:
    """Consecutive vertices as segments with their length and the measure at their start."""
    w = Window.partitionBy(line).orderBy(pos)
    seg = vertices.select(line, pos, "x", "y", *[c for c in ("cls", "source") if c in vertices.columns], F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by")).where("bx is not null")
    dx, dy = F.col("bx") - F.col("x"), F.col("by") - F.col("y")
    seg = seg.withColumn("len", F.sqrt(dx * dx + dy * dy))  # to the last bit what SQL's square root gives, which hypot isn't
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return seg.withColumn("m0", F.coalesce(F.sum("len").over(before), F.lit(0.0))).withColumnRenamed("x", "ax").withColumnRenamed("y", "ay")


def line_shapes(seg: DataFrame, line: str = "line_id", *also: str) -> DataFrame:
    """(line_id, shape, copies): lines of equal segments (and equal ``also``; by 128 bits of hash) share a shape, named by its least line, and the number of its lines."""
    of = [c for c in ("pos", "ax", "ay", "bx", "by", "len", "m0") if c in seg.columns] + list(also)
    bits = [F.sum(F.xxhash64(F.lit(k), *of).cast("decimal(38,0)")).alias(f"__{k}") for k in (1, 2)]
    names = written(seg.groupBy(line).agg(F.count("*").alias("__0"), *bits))
    key = ["__0", "__1", "__2"]
    return written(names.join(names.groupBy(*key).agg(F.min(line).alias("shape"), F.count("*").alias("copies")), key).select(line, "shape", "copies"))


def stations(seg: DataFrame, step: float, line: str = "line_id") -> DataFrame:
    """Points each ``step`` along every line, made segment by segment: whole multiples of the step from the line's start."""
    first, last = F.ceil(F.col("m0") / step), F.ceil((F.col("m0") + F.col("len")) / step) - 1
    spread = seg.where("len > 0").withColumn("k", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    t = (F.col("k") * step - F.col("m0")) / F.col("len")
    return spread.select(line, "k", (F.col("k") * step).alias("m"), (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"), ((F.col("bx") - F.col("ax")) / F.col("len")).alias("tx"), ((F.col("by") - F.col("ay")) / F.col("len")).alias("ty"))


def substring(seg: DataFrame, s0: float, s1: float, line: str = "line_id") -> DataFrame:
    """The part of each line between two measures, as clipped segments."""
    a, b = F.greatest("m0", F.lit(s0)), F.least(F.col("m0") + F.col("len"), F.lit(s1))
    at = lambda m, p, q: F.col(p) + (m - F.col("m0")) / F.col("len") * (F.col(q) - F.col(p))
    return seg.where((a < b) & (F.col("len") > 0)).select(line, a.alias("s0"), b.alias("s1"), at(a, "ax", "bx").alias("x0"), at(a, "ay", "by").alias("y0"), at(b, "ax", "bx").alias("x1"), at(b, "ay", "by").alias("y1"))


def runs(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Maximal runs of one value in order: first and last order key and count (gaps and islands)."""
    w = Window.partitionBy(*key).orderBy(*order)
    change = df.withColumn("__new", (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int"))
    numbered = change.withColumn("run", F.sum("__new").over(w))
    return numbered.groupBy(*key, "run", value).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"))


def closed_runs(df: DataFrame, key: list[str], order: str, flag: str, gap: float, least: float) -> DataFrame:
    """Runs of set flags; runs with at most ``gap`` between are one; those shorter than ``least`` go."""
    w = Window.partitionBy(*key).orderBy(order)
    on = df.where(F.col(flag)).withColumn("__new", (F.coalesce(F.col(order) - F.lag(order).over(w), F.lit(float("inf"))) > gap).cast("int"))
    grouped = on.withColumn("run", F.sum("__new").over(w)).groupBy(*key, "run").agg(F.min(order).alias("s0"), F.max(order).alias("s1"), F.count("*").alias("n"))
    return grouped.where(F.col("s1") - F.col("s0") >= least)


def moving(df: DataFrame, key: list[str], order: list[str], value: str, radius: int) -> DataFrame:
    """Moving mean and median of 2 radius + 1 rows."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-radius, radius)
    return df.withColumn("moving_mean", F.avg(value).over(w)).withColumn("moving_median", F.expr(f"percentile({value}, 0.5)").over(w))


def filled(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Unknown values take the last known one before, else the first after."""
    w = Window.partitionBy(*key).orderBy(*order)
    back = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("filled", F.coalesce(back, ahead))


def hysteresis(df: DataFrame, key: list[str], order: list[str], value: str, low: float, high: float) -> DataFrame:
    """On from ``high`` until below ``low``; off before the first decision."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    decided = F.when(F.col(value) >= high, True).when(F.col(value) < low, False)
    return df.withColumn("on", F.coalesce(F.last(decided, True).over(w), F.lit(False)))


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rank = 1").drop("__rank")


def rolling_count(df: DataFrame, key: list[str], ts: str, seconds: int) -> DataFrame:
    """Earlier rows of the key in the time before each row (its own second excluded)."""
    w = Window.partitionBy(*key).orderBy(times.seconds(ts)).rangeBetween(-seconds, -1)
    return df.withColumn("earlier", F.count("*").over(w))


def drift(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Change of a figure against the run before."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("before", F.lag(value).over(w)).withColumn("change", F.col(value) - F.col("before"))
