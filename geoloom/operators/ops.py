"""Operational analytics: usage, calibration, outages, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.times import seconds

# Fixed values of the duration calibration.
CALIBRATION_JOBS, CALIBRATION_LEAST, CALIBRATION_QUANTILE, CALIBRATION_CLAMP = 200, 20, 0.7, (0.5, 3.0)


def calibration(jobs: DataFrame, key: str, n: int = CALIBRATION_JOBS, least: int = CALIBRATION_LEAST, q: float = CALIBRATION_QUANTILE) -> DataFrame:
    """Quantile of actual over estimated minutes of each key's last n finished jobs, clamped; 1 for keys with too few."""
    done = jobs.where(F.col("status").isin("done", "done_with_errors"))
    last = done.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("job_id")))).where(F.col("__r") <= n)
    ratio = F.col("build_seconds") / 60 / (F.col("est_prep_min") + F.col("est_maps_min"))
    return last.groupBy(key).agg(F.count("*").alias("jobs"), F.expr(f"percentile(build_seconds / 60 / (est_prep_min + est_maps_min), {q})").alias("raw"), F.avg(ratio).alias("mean_ratio")).withColumn(
        "factor", F.when(F.col("jobs") >= least, F.greatest(F.lit(CALIBRATION_CLAMP[0]), F.least(F.lit(CALIBRATION_CLAMP[1]), F.col("raw")))).otherwise(1.0)
    )


def usage(jobs: DataFrame, since: Column) -> DataFrame:
    """Figures of jobs since a time."""
    done = F.col("status").isin("done", "done_with_errors")
    return jobs.where(F.col("created_at") >= since).agg(
        F.count("*").alias("jobs"), F.sum(done.cast("long")).alias("done"), F.avg(F.when(done, F.col("build_seconds"))).alias("avg_seconds"),
        F.countDistinct("ip_tag").alias("users"), F.min("created_at").alias("first_at"),
    )


def tag_windows(jobs: DataFrame, now: Column, tag: str, n: int) -> DataFrame:
    """Top tags by jobs of 24 hours, 30 days and in all, with distinct networks."""
    age = seconds(now) - seconds("created_at")
    return jobs.groupBy(tag).agg(
        F.sum((age <= 86400).cast("long")).alias("day"), F.sum((age <= 30 * 86400).cast("long")).alias("month"), F.count("*").alias("every"), F.countDistinct("ip_net_tag").alias("nets"),
    ).orderBy(F.desc("every"), tag).limit(n)


def daily_report(jobs: DataFrame) -> DataFrame:
    """Jobs by day and status with subtotals; other cuts are in the report groups."""
    return jobs.withColumn("day", F.to_date("created_at")).rollup("day", "status").agg(F.count("*").alias("jobs"), F.countDistinct("ip_tag").alias("ips"), F.countDistinct("ip_net_tag").alias("nets"))


def outages(probes: DataFrame) -> DataFrame:
    """Down and up events per source: down for every failing probe, up on recovery only."""
    w = Window.partitionBy("source_key").orderBy("ts", "event_id")
    before = F.lag("ok").over(w)
    return probes.withColumn("before", before).withColumn("event", F.when(~F.col("ok"), "down").when(~F.coalesce(F.col("before"), F.lit(True)), "up")).where("event is not null").drop("before")


def outage_spans(probes: DataFrame) -> DataFrame:
    """Each outage: first and last failing probe, their number, and the recovery's time (null while the source is down).

    ``last_seen`` is the last probe known to follow one of its failures: the recovery, or, of an open outage, its last failure if it has several.
    """
    w = Window.partitionBy("source_key").orderBy("ts", "event_id")
    begins = (~F.col("ok") & F.coalesce(F.lag("ok").over(w), F.lit(True))).cast("int")
    numbered = probes.withColumn("recovers", F.lead("ts").over(w)).withColumn("outage", F.sum(begins).over(w)).where(~F.col("ok"))
    return numbered.groupBy("source_key", "outage").agg(F.min("ts").alias("down_since"), F.max("ts").alias("last_down"), F.count("*").alias("failures"), F.max_by("recovers", F.struct("ts", "event_id")).alias("up_at"), F.max_by("recovers", F.when(F.col("recovers").isNotNull(), F.struct("ts", "event_id"))).alias("last_seen"))


def outage_summary(probes: DataFrame, now: Column) -> DataFrame:
    """First, last and number of failures, the last code and the state, worst first by rank."""
    last = probes.groupBy("source_key").agg(
        F.sum((~F.col("ok")).cast("long")).alias("failures"), F.count("*").alias("probes"), F.min(F.when(~F.col("ok"), F.col("ts"))).alias("first_down"),
        F.max(F.when(~F.col("ok"), F.col("ts"))).alias("last_down"), F.max_by("ok", F.struct("ts", "event_id")).alias("ok_now"), F.max_by("code", F.struct("ts", "event_id")).alias("last_code"),
    )
    state = F.when(~F.col("ok_now"), "down").when(F.col("failures") == 0, "fine").when(F.col("last_down") >= now - F.expr("INTERVAL 1 DAY"), "shaky").otherwise("recovered")
    rank = F.when(F.col("state") == "down", 0).when(F.col("state") == "shaky", 1).when(F.col("state") == "recovered", 2).otherwise(3)
    return last.withColumn("state", state).withColumn("severity", rank)


def scaling_exponent(runs: DataFrame, size: str, seconds: str) -> DataFrame:
    """Slope of log time over log size."""
    return runs.where((F.col(size) > 0) & (F.col(seconds) > 0)).agg(F.regr_slope(F.ln(seconds), F.ln(size)).alias("exponent"), F.count("*").alias("runs"))


def completeness(areas: DataFrame, references: DataFrame, unit: str, least: int = 50, share: float = 0.5) -> DataFrame:
    """Units with enough reference points where areas are fewer than a share of them."""
    a = areas.groupBy(unit).agg(F.count("*").alias("areas"))
    r = references.groupBy(unit).agg(F.count("*").alias("refs"))
    both = r.join(a, unit, "left").withColumn("ratio", F.coalesce("areas", F.lit(0)) / F.col("refs"))
    return both.select(unit, "refs", F.coalesce("areas", F.lit(0)).alias("areas"), "ratio", ((F.col("refs") >= least) & (F.col("ratio") < share)).alias("incomplete"))


def as_of(left: DataFrame, right: DataFrame, key: list[str], ts: str, order: str, values: list[str], part: str = "day") -> DataFrame:
    """For each left row the last right row of its key before it: one union and windows over (key, day), no range join.

    What holds at a part's start comes from the last row of each earlier part, so a key's history is spread over its days.
    """
    l = left.select("*", F.lit(0).alias("__side"), *(F.lit(None).cast(right.schema[v].dataType).alias(f"__{v}") for v in values))  # noqa: E741
    r = right.select(*key, ts, order, F.lit(1).alias("__side"), *(F.col(v).alias(f"__{v}") for v in values))
    w = Window.partitionBy(*key, "__part").orderBy(ts, order, "__side").rowsBetween(Window.unboundedPreceding, -1)
    at = F.when(F.col("__side") == 1, F.struct(*(F.col(f"__{v}").alias(v) for v in values)))
    every = l.unionByName(r, allowMissingColumns=True).withColumn("__part", F.date_trunc(part, ts)).withColumn("__at", at)
    ends = every.groupBy(*key, "__part").agg(F.max_by("__at", F.when(F.col("__side") == 1, F.struct(ts, order))).alias("__end"))
    earlier = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*(F.col(k).alias(f"__k_{k}") for k in key), F.col("__part").alias("__k_part"), F.last("__end", True).over(earlier).alias("__carried"))
    same = F.col("__part").eqNullSafe(F.col("__k_part"))
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    found = every.withColumn("__last", F.last("__at", True).over(w)).where("__side = 0").join(carried, same)
    return found.select(*left.columns, *(F.coalesce(F.col("__last"), F.col("__carried"))[v].alias(f"last_{v}") for v in values))


def blocked(requests: DataFrame, probes: DataFrame, key: list[str], ts: str, order: str) -> DataFrame:
    """``requests`` with blocked: whether the last probe of their source before them failed; no probe before them blocks none."""
    return as_of(requests, probes, key, ts, order, ["ok"]).withColumn("blocked", ~F.coalesce(F.col("last_ok"), F.lit(True))).drop("last_ok")


def fair_order(jobs: DataFrame, user: str, queue: str, window_s: int = 86400) -> DataFrame:
    """(job_id, queue, recent, active, place): jobs of users with few jobs in the ``window_s`` seconds before come first, then those with few
    jobs still running, then by time and job_id. Jobs of one second follow their job_id; a job runs for build_seconds, null for none."""
    t = seconds("created_at")
    j = jobs.select("job_id", user, queue, "created_at", t.alias("t"), F.ceil(F.coalesce(F.col("build_seconds"), F.lit(0.0))).cast("long").alias("runs"))
    same = F.row_number().over(Window.partitionBy(user, "t").orderBy("job_id")) - 1
    counted = j.withColumn("recent", F.count("*").over(Window.partitionBy(user).orderBy("t").rangeBetween(-(window_s - 1), -1)) + same)
    # a running sum over starts and ends; a job that ends at this second is over
    begins = counted.select("*", F.lit(1).alias("step"), F.col("t").alias("at"))
    ends = counted.select("*", F.lit(-1).alias("step"), (F.col("t") + F.col("runs")).alias("at")).where("runs > 0")
    begins = begins.withColumn("step", F.when(F.col("runs") > 0, 1).otherwise(0))
    order = Window.partitionBy(user).orderBy("at", F.col("step") >= 0, "job_id").rowsBetween(Window.unboundedPreceding, -1)
    running = begins.unionByName(ends).withColumn("active", F.coalesce(F.sum("step").over(order), F.lit(0)).cast("long")).where("step >= 0")
    place = F.row_number().over(Window.partitionBy(queue).orderBy("recent", "active", "created_at", "job_id"))
    return running.select("job_id", queue, "recent", "active", place.alias("place"))
