import shutil

import pytest
from pyspark.sql import functions as F

from geoloom.operators import ops
from geoloom.sources import tables as T
from geoloom.streaming import streams as S


@pytest.fixture
def events(sf, tmp_path):
    """The events as a landing folder."""
    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf}/events.parquet", tmp_path / "in" / "part-0.parquet")
    return str(tmp_path / "in")


def test_outages_stream_equals_batch(spark, sf, events, tmp_path):
    got = S.run_to_table(S.outage_events(S.probe_stream(spark, events)), "outs", str(tmp_path / "a"))
    batch = ops.outages(T.probes(spark, sf))
    assert sorted((r.event_id, r.event) for r in got.collect()) == sorted((r.event_id, r.event) for r in batch.collect())


def test_alerts_come_once(spark, sf, events, tmp_path):
    got = S.run_to_table(S.alerts(S.probe_stream(spark, events), 0), "alerts", str(tmp_path / "b"))
    spans = ops.outage_spans(T.probes(spark, sf))
    assert got.where("kind = 'alert'").count() == spans.count()
    assert got.where("kind = 'recovered'").count() == spans.where("up_at is not null").count()


def test_windows_equal_batch(spark, sf, events, tmp_path):
    e = S.events_stream(spark, events)
    day = S.run_to_table(S.digest(e), "days", str(tmp_path / "c"), "complete")
    assert day.agg(F.sum("n")).first()[0] == T.table(spark, sf, "events").count()
    once = S.run_to_table(S.counted_once(e.unionByName(e)), "once", str(tmp_path / "d"), "complete")
    assert once.agg(F.sum("n")).first()[0] == T.table(spark, sf, "events").count()
    slide = S.run_to_table(S.sliding(e), "slide", str(tmp_path / "e"), "complete")
    assert slide.agg(F.sum("n")).first()[0] == 24 * T.table(spark, sf, "events").count()
