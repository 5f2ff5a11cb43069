"""Copies of lines and areas meet once in arrangements, votes and overlaps; what a shape is given, its rows have."""

import duckdb
import pytest
from geoloom.operators import planar, sequence
from geoloom.operators import spatial_join as J
from geoloom.plans import faces, spatial
from geoloom.sources import tables as T
from pyspark.sql import functions as F
from tests.oracle import assert_same


@pytest.fixture(scope="module")
def copied(tmp_path_factory, sf):
    """Three copies of every area: keys shifted so that shapes stay."""
    out = str(tmp_path_factory.mktemp("copied"))
    c = duckdb.connect()
    c.sql(f"COPY (SELECT t.* REPLACE (c_custkey + i * 36000000 AS c_custkey) FROM '{sf}/customer.parquet' t, range(0, 3) r(i)) TO '{out}/customer.parquet' (FORMAT parquet)")
    c.sql(f"CREATE VIEW customer AS SELECT * FROM '{out}/customer.parquet'")
    return out, c


def test_line_shapes_name_copies(spark):
    rows = [(1, 0, 0.0, 1.0), (1, 1, 1.0, 2.0), (2, 1, 1.0, 2.0), (2, 0, 0.0, 1.0), (3, 0, 0.0, 1.0), (4, 0, 1.0, 2.0), (4, 1, 0.0, 1.0)]
    seg = spark.createDataFrame([(i, p, a, 0.0, b, 0.0) for i, p, a, b in rows], "line_id long, pos int, ax double, ay double, bx double, by double")
    assert sorted(map(tuple, sequence.line_shapes(seg).collect())) == [(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 1)]


def test_overlap_area_meets_shapes(spark, copied, monkeypatch):
    out, c = copied
    met, whole = [], J.overlaps
    monkeypatch.setattr(J, "overlaps", lambda a, b, *more: met.append((a.count(), b.count())) or whole(a, b, *more))
    assert_same(spatial.QUERIES["jon09_overlap_area"](spark, out), c.sql(T.with_tables(spatial.SQL["jon09_overlap_area"])))
    r = T.rects(spark, out)
    assert met == [tuple(r.where(F.col("kind") == k).select(*J.BOX).distinct().count() for k in ("BUILDING", "MACHINERY"))]


def test_fence_ticks_probe_shapes_and_tell_copies(spark, sf, copied, monkeypatch):
    once = {r.line_id: tuple(r)[1:] for r in faces.QUERIES["win15_fence_ticks"](spark, sf).collect()}
    seen, whole = [], sequence.stations
    monkeypatch.setattr(sequence, "stations", lambda s, *more: seen.append(s.select("line_id").distinct().count()) or whole(s, *more))
    got = {r.line_id: tuple(r)[1:] for r in faces.QUERIES["win15_fence_ticks"](spark, copied[0]).collect()}
    assert got == {k + i * 36000000: v for k, v in once.items() for i in range(3)} and seen[0] <= len(once)


def test_carriageways_measure_an_axis_once(spark, sf, copied, monkeypatch):
    from geoloom.operators import carriageways

    seen, whole = [], carriageways.axis_stations
    monkeypatch.setattr(carriageways, "axis_stations", lambda s, *more: seen.append(s.count()) or whole(s, *more))
    rows = faces.QUERIES["jon19_carriageways"](spark, copied[0]).collect()
    own = sorted(tuple(r)[1:] for r in rows if r.line_id < 36000000)
    assert own and all(sorted(tuple(r)[1:] for r in rows if r.line_id // 36000000 == i) == own for i in (1, 2))
    assert seen[0] <= T.rects(spark, sf).where("kind = 'MACHINERY'").count()


def test_coverage_cuts_a_ring_once(spark, copied, monkeypatch):
    cut, whole = [], planar.noded
    monkeypatch.setattr(planar, "noded", lambda s, *more: cut.append(s.count()) or whole(s, *more))
    out, c = copied
    assert_same(faces.QUERIES["set14_coverage"](spark, out), c.sql(T.with_tables(faces.SQL["set14_coverage"])))
    assert cut == [4 * T.rects(spark, out).select(*J.BOX).distinct().count()]
