"""Copies of areas and points meet once: work follows the shapes, not their copies."""

import pytest
import duckdb
from geoloom.operators import spatial_join as J
from geoloom.plans import metrics, network, shapes, spatial
from geoloom.sources import tables as T
from tests.oracle import assert_same

QUERIES = {n: (m.QUERIES[n], m.SQL[n]) for m, ns in (
    (spatial, ("jon01_points_in_areas", "jon01_points_in_rings", "jon02_centroid_anti", "jon08_overlap_share", "jon45_largest_share")),
    (metrics, ("jon10_absorbed",)), (network, ("jon36_gardens", "jon37_private_playgrounds")), (shapes, ("jon12_town_sidewalks", "jon09_kept_parking", "set18_assembled_areas")),
) for n in ns}


@pytest.fixture(scope="module")
def copied(tmp_path_factory, sf):
    """Three copies of every row: keys shifted so that places and shapes stay."""
    out = str(tmp_path_factory.mktemp("copied"))
    c = duckdb.connect()
    for table, keys in {"customer": ("c_custkey",), "orders": ("o_orderkey", "o_custkey"), "lineitem": ("l_orderkey", "l_partkey", "l_suppkey")}.items():
        moved = ", ".join(f"{k} + i * 36000000 AS {k}" for k in keys)
        c.sql(f"COPY (SELECT t.* REPLACE ({moved}) FROM '{sf}/{table}.parquet' t, range(0, 3) r(i)) TO '{out}/{table}.parquet' (FORMAT parquet)")
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{out}/{table}.parquet'")
    return out, c


@pytest.mark.parametrize("name", QUERIES)
def test_copies_meet_once(spark, copied, monkeypatch, name):
    out, c = copied
    pairs, points = J.overlaps, J.points_in_boxes

    def unique(df, *keys):
        assert df.count() == df.select(*keys).distinct().count()
        return df

    monkeypatch.setattr(J, "overlaps", lambda a, b, *more: pairs(unique(a, *J.BOX), b if "lvl" in str(b.schema["fid"].dataType) else unique(b, *J.BOX), *more))
    monkeypatch.setattr(J, "points_in_boxes", lambda p, b, *more: points(unique(p, "x", "y"), unique(b, *J.BOX), *more))
    query, sql = QUERIES[name]
    assert_same(query(spark, out), c.sql(T.with_tables(sql)))
