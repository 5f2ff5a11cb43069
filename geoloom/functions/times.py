"""Time figures that do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), F.col(ts) if isinstance(ts, str) else ts)


def age_days(ts: Column, now: Column) -> Column:
    return F.datediff(now, ts)


def slot(ts: Column, start: str, days: int) -> Column:
    """Number of the span of some days that a time lies in."""
    return F.floor(F.datediff(ts, F.lit(start)) / days)


def duration_text(secs: Column) -> Column:
    """'1 h 05 min', '12 min', '40 s'."""
    h, m = F.floor(secs / 3600), F.floor(secs % 3600 / 60)
    return F.when(h > 0, F.format_string("%d h %02d min", h, m)).when(m > 0, F.format_string("%d min", m)).otherwise(F.format_string("%d s", F.floor(secs)))
