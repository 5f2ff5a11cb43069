"""Record streams and height sources: queries against SQL, streams against batch."""

import pytest
from pyspark.sql import functions as F

from geoloom.plans import catalog
from geoloom.sources import providers as P
from geoloom.sources import readers as R
from geoloom.streaming import streams as S
from tests.oracle import assert_same


@pytest.mark.parametrize("name", ["str10_record_stream", "udf04_providers"])
def test_queries(spark, duck, sf, name):
    got = catalog.queries()[name](spark, sf)
    assert_same(got, duck.sql(catalog.oracle_sql()[name]))
    assert got.count() > 2


def test_stream_equals_batch_and_goes_on(spark, tmp_path):
    folder, state = tmp_path / "in", tmp_path / "state"
    folder.mkdir()
    record = lambda k, kind, more: f'<ns:obj xmlns:ns="u" type="{kind}">{more}<attribute name="no">{k}</attribute></ns:obj>'
    first = [record(1, "wall", "<level>2</level><posList>1 2 3 4</posList>"), record(2, "gate", ""), record(3, "wall", "<posList></posList>")]
    (folder / "a.xml").write_text("<all>" + "".join(first) + "</all>")
    stream = lambda: R.tech_object_stream(spark, str(folder), "ns:obj", ["wall"], 1)
    table = str(tmp_path / "table")
    one = S.run_to_table(stream(), "one", str(state / "1"), path=table).collect()
    batch = R.tech_objects(spark, str(folder), "ns:obj").where("type = 'wall'").collect()
    key = lambda r: r["attrs"]["no"]
    assert sorted(one, key=key) == sorted(batch, key=key) and len(one) == 2
    # a run that goes on reads the files that came since, and no other
    (folder / "b.xml").write_text("<all>" + record(9, "wall", "<posList>5 6</posList>") + "</all>")
    later = S.run_to_table(stream(), "one", str(state / "1"), path=table)
    assert sorted(key(r) for r in later.collect()) == ["1", "3", "9"]


def test_providers(spark, tmp_path):
    (tmp_path / "h.xyz").write_text("1 1 5\n9 1 7\n")
    known = P.Providers()
    known.register("flat", lambda s: s.range(4).select(F.col("id").alias("rr"), F.col("id").alias("cc"), F.when(F.col("id") < 3, 1.0).alias("v")))
    assert known.names() == ["flat"] and known.raster(spark, "flat", (0, 0, 9, 9), 4.0).count() == 3
    assert [tuple(r) for r in known.raster(spark, f"xyz:{tmp_path}/h.xyz", (0, 0, 1, 1), 4.0).collect()] == [(0, 0, 5.0)]
    with pytest.raises(P.UnknownSource):
        known.raster(spark, "deep", (0, 0, 1, 1), 4.0)
    with pytest.raises(ValueError):
        known.register("a:b", lambda s: s.range(1))
