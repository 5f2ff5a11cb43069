"""Streaming twins of the operational queries."""

from __future__ import annotations

import uuid

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from geoloom.operators import grid
from geoloom.sources.store import shared_dir
from geoloom.sources.tables import probe_columns


def events_stream(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """New Parquet files of a folder as a stream, times in UTC."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def probe_stream(spark: SparkSession, path: str) -> DataFrame:
    return probe_columns(events_stream(spark, path))


def outage_events(probes: DataFrame) -> DataFrame:
    """down for each failing probe, up on recovery only; the state of a source is its last answer and since when it is down."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ok, since = state.get if state.exists else (True, None)
        out = []
        for f in frames:
            for row in f.sort_values(["ts", "event_id"]).itertuples():
                if not row.ok:
                    since = row.ts if ok or since is None else since
                    out.append((key[0], row.event_id, "down", since))
                elif not ok:
                    out.append((key[0], row.event_id, "up", since))
                    since = None
                ok = bool(row.ok)
        state.update((ok, since))
        yield pd.DataFrame(out, columns=["source_key", "event_id", "event", "down_since"])

    return probes.groupBy("source_key").applyInPandasWithState(step, "source_key long, event_id long, event string, down_since timestamp", "ok boolean, since timestamp", "append", GroupStateTimeout.NoTimeout)


def alerts(probes: DataFrame, after_seconds: int) -> DataFrame:
    """One alert for an outage that lasts longer than the limit, one recovery if there was an alert."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, told = state.get if state.exists else (None, False)
        out = []
        for f in frames:
            for row in f.sort_values(["ts", "event_id"]).itertuples():
                if row.ok:
                    if told:
                        out.append((key[0], row.ts, "recovered"))
                    since, told = None, False
                else:
                    since = since or row.ts
                    if not told and (row.ts - since).total_seconds() >= after_seconds:
                        out.append((key[0], row.ts, "alert"))
                        told = True
        state.update((since, told))
        yield pd.DataFrame(out, columns=["source_key", "ts", "kind"])

    return probes.groupBy("source_key").applyInPandasWithState(step, "source_key long, ts timestamp, kind string", "since timestamp, told boolean", "append", GroupStateTimeout.NoTimeout)


def digest(events: DataFrame, hours: int = 24, late: str = "1 day") -> DataFrame:
    """Counts of a span of hours and kind, once the span is over."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{hours} hours"), "event_type").agg(F.count("*").alias("n"))


def sliding(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events of the last 24 hours per tag, each hour."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "24 hours", "1 hour"), (F.col("user_id") % 10).alias("tag")).agg(F.count("*").alias("n"))


def counted_once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Totals where an event told again within the watermark counts once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def gridded(points: DataFrame, size: float) -> DataFrame:
    """Points by and by into the same raster as in one pass: counts, sums and maxima add up."""
    keyed = points.select(grid.cell("y", size).alias("rr"), grid.cell("x", size).alias("cc"), "z", "cls")
    return keyed.groupBy("rr", "cc").agg(F.count("*").alias("n"), F.sum(F.when(F.col("cls") == grid.GROUND, 1).otherwise(0)).alias("ground_hits"), F.max("z").alias("top"))


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and gives the result as a table in the shared folder; nothing passes the driver.

    A later run goes on with the same checkpoint and ``path``, and adds what has come since.
    """
    path = path or f"{shared_dir(stream.sparkSession)}/geoloom-{name}-{uuid.uuid4().hex}"
    out = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        out = out.format("parquet").option("path", path)
    else:  # files take no updates: each batch has the whole result, and replaces the one before
        out = out.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path))
    out.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
