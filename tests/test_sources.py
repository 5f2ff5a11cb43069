import json

from pyspark.sql import functions as F

from geoloom.sources import readers as R
from geoloom.sources import writers as W


def test_elements_json_counts_ids_once(spark, tmp_path):
    way = {"type": "way", "id": 5, "tags": {"highway": "path"}, "geometry": [{"lat": 1.0, "lon": 2.0}, {"lat": 1.5, "lon": 2.5}]}
    for k in range(2):
        (tmp_path / f"t{k}.json").write_text(json.dumps({"elements": [way, {"type": "node", "id": 5 + k, "lat": 1.0, "lon": 2.0, "tags": {}}]}))
    rows = R.elements_json(spark, str(tmp_path))
    assert sorted((r.type, r.id) for r in rows.collect()) == [("node", 5), ("node", 6), ("way", 5)]


def test_ways_xml_orders_nodes(spark, tmp_path):
    (tmp_path / "m.xml").write_text("<osm><node id='1' lat='1.0' lon='2.0'/><node id='2' lat='3.0' lon='4.0'/><way id='9'><nd ref='2'/><nd ref='1'/><tag k='highway' v='track'/></way></osm>")
    r = R.ways_xml(spark, str(tmp_path / "m.xml")).first()
    assert [(p.lat, p.lon) for p in r.line] == [(3.0, 4.0), (1.0, 2.0)] and r.tags == {"highway": "track"}


def test_tech_objects(spark, tmp_path):
    (tmp_path / "t.xml").write_text("<c><obj type='wall'><level>-1</level><attribute name='a'>x</attribute><posList>1 2 3 4</posList></obj></c>")
    r = R.tech_objects(spark, str(tmp_path / "t.xml"), "obj").first()
    assert (r.type, r.level, r.attrs, [(p.x, p.y) for p in r.pts]) == ("wall", -1, {"a": "x"}, [(1.0, 2.0), (3.0, 4.0)])


def test_features_pages_overlap(spark, tmp_path):
    f = lambda i: {"type": "Feature", "id": str(i), "properties": {"k": "v"}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}}
    (tmp_path / "roads_1.json").write_text(json.dumps({"type": "FeatureCollection", "features": [f(1), f(2)]}))
    (tmp_path / "roads_2.json").write_text(json.dumps({"type": "FeatureCollection", "features": [f(2), f(3)]}))
    rows = R.features(spark, str(tmp_path)).withColumn("line", R.line_coordinates(F.col("coordinates"))).collect()
    assert sorted((r.layer, r.id, len(r.line)) for r in rows) == [("roads", "1", 2), ("roads", "2", 2), ("roads", "3", 2)]


def test_grids(spark, tmp_path):
    (tmp_path / "a.asc").write_text("ncols 2\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 5\nNODATA_value -9999\n1 2\n3 -9999\n")
    got = {(r.row, r.col): (r.x, r.y, r.v) for r in R.ascii_grid(spark, str(tmp_path / "a.asc")).collect()}
    assert got == {(0, 0): (12.5, 27.5, 1.0), (0, 1): (17.5, 27.5, 2.0), (1, 0): (12.5, 22.5, 3.0), (1, 1): (17.5, 22.5, None)}
    (tmp_path / "p.xyz").write_text("0.5 0.5 7\n1.5 0.5 8\n")
    assert sorted((r.rr, r.cc, r.v) for r in R.xyz_cells(spark, str(tmp_path / "p.xyz"), 1.0).collect()) == [(0, 0, 7.0), (0, 1, 8.0)]


def test_dxf(spark, tmp_path):
    (tmp_path / "d.dxf").write_text("0\nSECTION\n0\nLINE\n8\nL1\n10\n1.0\n20\n2.0\n11\n3.0\n21\n4.0\n0\nENDSEC\n")
    r = R.dxf_lines(spark, str(tmp_path / "d.dxf")).first()
    assert (r.layer, r.x0, r.y0, r.x1, r.y1) == ("L1", 1.0, 2.0, 3.0, 4.0)


def test_source_events_skip_broken_lines(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"ts":"2024-01-01T00:00:00Z","event":"down","key":"a","code":500}\nnot json\n{"ts":"2024-01-02T00:00:00Z","event":"up","key":"a"}\n')
    rows = R.source_events(spark, str(tmp_path / "e.jsonl"))
    assert rows.count() == 2 and R.source_events(spark, str(tmp_path / "e.jsonl"), F.lit("2024-01-01T12:00:00Z").cast("timestamp")).count() == 1


def test_tiles_and_sheets(spark):
    t = R.split_extent(spark, 0.0, 0.0, 2.5, 1.0, 1.0).collect()
    assert len(t) == 3 and max(r.east for r in t) == 2.5
    b = spark.createDataFrame([("E12_N34",), ("x",)], "n string").select(R.sheet_bounds(F.col("n")).alias("b")).collect()
    assert tuple(b[0].b) == (12000, 34000, 13000, 35000) and b[1].b is None
    nodes = spark.createDataFrame([(0, 0, 0, 0, 9), (1, 0, 0, 0, 9), (1, 1, 1, 0, 9), (3, 0, 0, 0, 9)], "d int, x int, y int, z int, count int")
    assert sorted(tuple(r)[:3] for r in R.octree_nodes(nodes, (0, 0, 0, 100), 10, (60, 60, 90, 90), 2.0).collect()) == [(0, 0, 0), (1, 1, 1)]


def test_inventory(spark):
    a = spark.createDataFrame([("s1", 1.0, 9.0), ("s2", 1.0, 9.0), ("s3", -999.0, 9.0)], "k string, lo double, hi double")
    b = spark.createDataFrame([("s1", 1.0, 9.0), ("s3", 1.0, 9.0), ("s4", 1.0, 9.0)], "k string, lo double, hi double")
    got = {r.k: r.problem for r in R.inventory(a, b, "k", "lo", "hi", (-100.0, 5000.0)).collect()}
    assert got == {"s1": None, "s2": "no surface", "s3": "odd heights", "s4": "no terrain"}


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, layer string")
    W.write_layers(df, str(tmp_path / "l"), "layer")
    W.replace_partitions(df.where("layer = 'a'").limit(1), str(tmp_path / "l"), "layer")
    assert {r.layer: r["count"] for r in spark.read.parquet(str(tmp_path / "l")).groupBy("layer").count().collect()} == {"a": 1, "b": 1}
    text = W.feature_lines(df, F.struct(F.lit("Point").alias("type"), F.array(F.lit(1.0), F.lit(2.0)).alias("coordinates")), "id").first().value
    assert json.loads(text)["properties"] == {"id": 1}
    r = W.reviewed(df.where("id = 1"), df.where("id > 1").withColumn("reason", F.lit("small")))
    assert sorted((x.id, x.status, x.reason) for x in r.collect()) == [(1, "used", None), (2, "dropped", "small"), (3, "dropped", "small")]
    made = []
    key = W.cache_key("x", 1.0)
    for _ in range(2):
        out = W.cached(spark, str(tmp_path / "c"), key, lambda: made.append(1) or df)
    assert out.count() == 3 and made == [1]
