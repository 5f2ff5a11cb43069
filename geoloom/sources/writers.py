"""Writers: partitioned tables, features as JSON text, review layers, metric history, keyed caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_layers(df: DataFrame, path: str, by: str, rows: int = 1_000_000) -> None:
    """One folder a layer, with files of at most so many rows; every task writes what it has, so no layer is gathered."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).partitionBy(by).parquet(path)


def write_tiles(cells: DataFrame, path: str, tile: int) -> None:
    """A raster's cells (rr, cc) in folders of tiles, of which a window reads few."""
    keyed = cells.withColumn("tile_y", F.floor(F.col("rr") / tile)).withColumn("tile_x", F.floor(F.col("cc") / tile))
    keyed.repartition("tile_y", "tile_x").write.mode("overwrite").partitionBy("tile_y", "tile_x").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrites only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def feature_lines(df: DataFrame, geometry: Column, *properties: str) -> DataFrame:
    """Features as one JSON text a line."""
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("value"))


def reviewed(used: DataFrame, dropped: DataFrame, reason: str = "reason") -> DataFrame:
    """Used and dropped rows as one table with status and reason."""
    return used.withColumn("status", F.lit("used")).withColumn(reason, F.lit(None).cast("string")).unionByName(dropped.withColumn("status", F.lit("dropped")), allowMissingColumns=True)


def append_history(metrics: DataFrame, path: str, run: str) -> None:
    metrics.withColumn("run", F.lit(run)).write.mode("append").parquet(path)


def cache_key(*parts: object) -> str:
    """A folder name for derived tables of the same inputs."""
    import hashlib

    return hashlib.sha256("|".join(f"{p:.3f}" if isinstance(p, float) else str(p) for p in parts).encode()).hexdigest()[:32]


def cached(spark: SparkSession, root: str, key: str, make) -> DataFrame:
    """The table under a key, made and written where it isn't there yet."""
    path = f"{root}/{key}"
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def registry_text(sources: DataFrame) -> DataFrame:
    """A document line per country: its sources in order."""
    return sources.groupBy("country").agg(F.array_sort(F.collect_set("source")).alias("s")).select("country", F.concat_ws(", ", "s").alias("text"))
