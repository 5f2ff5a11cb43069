"""Queries that land tables as files in the shared folder, in the formats that deliveries come in, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import classify, grid
from geoloom.sources import providers as P
from geoloom.sources import readers as R
from geoloom.sources import tables as T
from geoloom.sources import writers as W
from geoloom.sources.store import shared_dir
from geoloom.streaming import streams as S


def _folder(spark, name: str) -> str:
    """A new folder in the shared one, which goes with the session."""
    path = f"{shared_dir(spark)}/geoloom-{uuid.uuid4().hex}/{name}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where.getParent())
    return path


def _text(df: DataFrame, path: str) -> str:
    df.write.text(path)
    return path


def _rings(spark, d) -> DataFrame:
    at = lambda a, b: F.array(F.col(a), F.col(b))
    return T.rects(spark, d).withColumn("ring", F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1"), at("x0", "y0")))


def _element_lines(spark, d, repeat: bool) -> DataFrame:
    """Answers with one element each; with ``repeat`` some come twice, as tiles overlap."""
    e = T.elements(spark, d)
    e = e.unionByName(e.where("eid % 4 = 0")) if repeat else e
    at = F.array(F.struct((F.col("eid") / 1000).alias("lat"), F.lit(1.5).alias("lon")))
    element = F.struct(F.lit("way").alias("type"), F.col("eid").alias("id"), F.col("tags").alias("tags"), at.alias("geometry"))
    return e.select(F.to_json(F.struct(F.array(element).alias("elements"))).alias("value"))


def src01_elements(spark, d):
    """Tagged ways from answers in JSON, repeated ids once."""
    path = _text(_element_lines(spark, d, True), _folder(spark, "elements"))
    return R.elements_lines(spark, path).select("id", F.col("tags")["highway"].alias("highway"), F.col("tags")["surface"].alias("surface"), F.size("geometry").alias("points"))


def src03_everything(spark, d):
    """The whole dump without a filter on tags: elements by type and number of tags."""
    path = _text(_element_lines(spark, d, False), _folder(spark, "everything"))
    return R.elements_lines(spark, path).groupBy("type", F.size("tags").alias("tags")).agg(F.count("*").alias("n"))


def src06_paged_layers(spark, d):
    """Layers that came in pages which overlap: object ids count once a layer."""
    r = _rings(spark, d)
    paged = r.withColumn("page", F.col("fid") % 5).unionByName(r.where("fid % 7 = 0").withColumn("page", F.lit(5).cast("long")))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates"))
    line = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("fid").cast("string").alias("id"), F.struct("lvl").alias("properties"), geometry.alias("geometry")))
    path = _folder(spark, "pages")
    paged.select("kind", "page", line.alias("value")).write.partitionBy("kind", "page").text(path)
    return R.feature_lines(spark, path).groupBy("layer").agg(F.count("*").alias("features"), F.sum(F.col("properties")["lvl"].cast("int")).alias("levels"))


def src14_points_in_window(spark, d):
    """Points of a window, classes and columns pushed to the files."""
    path = _folder(spark, "points")
    T.points(spark, d).select("x", "y", "z", "cls", "rn", "nr").write.parquet(path)
    p = R.points(spark, path, (100.0, 50.0, 300.0, 250.0), classes=(2, 5))
    return p.groupBy("cls").agg(F.count("*").alias("n"), F.max("z").alias("top"))


def src18_xyz_cells(spark, d):
    """Cells of a list of x, y and z in any order."""
    path = _text(T.points(spark, d).select(F.format_string("%.1f %.1f %.2f", "x", "y", "z").alias("value")), _folder(spark, "xyz"))
    return R.xyz_cells(spark, path, 20.0)


def src20_raster_window(spark, d):
    """Cells of a window of a raster that lies in tiles: only the tiles that meet it are read."""
    from geoloom.operators import grid

    path = _folder(spark, "tiles")
    W.write_tiles(grid.surfaces(T.points(spark, d), T.CELL_M).select("rr", "cc", "dem"), path, 25)
    return R.raster_window(spark, path, (20, 30, 60, 55), 25).select("rr", "cc", "dem")


def src26_rules_from_file(spark, d):
    """Rules from a file in their order, used as one chain."""
    path = _folder(spark, "rules")
    rules = [(1, "highway=track&tracktype=grade1", "503"), (2, "highway=track", "504"), (3, "surface=asphalt", "501"), (4, "highway!=", "506")]
    spark.createDataFrame(rules, "place int, condition string, code string").write.json(path)
    return classify.by_rules(T.elements(spark, d), R.rules(spark, path)).groupBy("code").agg(F.count("*").alias("n"))


def src28_geojson_areas(spark, d):
    """Areas as features of one file a layer, back as rings."""
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates"))
    line = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("fid").cast("string").alias("id"), F.struct("kind", "lvl").alias("properties"), geometry.alias("geometry")))
    path = _folder(spark, "areas")
    _rings(spark, d).select(F.lit("areas").alias("layer"), line.alias("value")).write.partitionBy("layer").text(path)
    ring = F.from_json("coordinates", "array<array<array<double>>>")[0]
    return R.feature_lines(spark, path).select(F.col("id").cast("long").alias("fid"), F.col("properties")["kind"].alias("kind"), F.size(ring).alias("points"), F.round(ring[2][0], 3).alias("x1"), F.round(ring[2][1], 3).alias("y1"))


def src30_event_log(spark, d):
    """An append-only log with broken lines, from a time on."""
    p = T.probes(spark, d)
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.when(F.col("ok"), "up").otherwise("down").alias("event"), F.col("source_key").cast("string").alias("key"), F.col("code").alias("code")))
    lines = p.select(F.when(F.col("event_id") % 50 == 0, F.lit('{"ts": broken')).otherwise(line).alias("value"))
    rows = R.source_events(spark, _text(lines, _folder(spark, "log")), F.lit("2024-01-10T00:00:00Z").cast("timestamp"))
    return rows.groupBy("key", "event").agg(F.count("*").alias("n"), F.max("code").alias("code"))


def snk01_feature_layer(spark, d):
    """Lines as features of a layer, and what stands in it."""
    v = T.vertices(spark, d)
    line = v.groupBy("line_id", "source").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
    out = W.feature_lines(line, F.struct(F.lit("LineString").alias("type"), "coordinates"), "line_id", "source")
    back = spark.read.text(_text(out, _folder(spark, "lines")))
    f = F.from_json("value", "struct<properties:struct<line_id:long,source:string>,geometry:struct<coordinates:array<array<double>>>>")
    return back.select(f.alias("f")).select("f.properties.line_id", "f.properties.source", F.size("f.geometry.coordinates").alias("points"), F.col("f.geometry.coordinates")[0][0].alias("x"))


def snk02_layers(spark, d):
    """Areas in a folder a kind, files of bounded size; counted as they lie there."""
    path = _folder(spark, "layers")
    W.write_layers(T.rects(spark, d), path, "kind")
    return spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("x0"), 3).alias("x0"))


def snk04_review(spark, d):
    """Used and dropped ways with the reason."""
    e = T.elements(spark, d)
    reason = F.when(F.col("surface").isNull(), "no surface").when(F.col("highway") == "steps", "steps")
    dropped = e.withColumn("reason", reason).where("reason is not null").select("eid", "highway", "reason")
    used = e.where(reason.isNull()).select("eid", "highway")
    path = _folder(spark, "review")
    W.reviewed(used, dropped).write.parquet(path)
    return spark.read.parquet(path).groupBy("status", "reason").agg(F.count("*").alias("n"))


def str10_record_stream(spark, d):
    """Areas land as files of XML records; two types of them are streamed, file by file, into a table."""
    path, c = _folder(spark, "records"), F.col
    corner = lambda *names: F.concat_ws(" ", *names)
    ring = corner("x0", "y0", "x1", "y0", "x1", "y1", "x0", "y1", "x0", "y0")
    attribute = F.array(F.struct(F.lit("fid").alias("_name"), c("fid").cast("string").alias("_VALUE")), F.struct(F.lit("kind").alias("_name"), F.lower("kind").alias("_VALUE")))
    rows = T.rects(spark, d).select(c("kind").alias("_type"), c("lvl").cast("string").alias("level"), attribute.alias("attribute"), ring.alias("posList"))
    rows.repartition(6).write.format("xml").option("rootTag", "map").option("rowTag", "record").save(path)
    stream = R.tech_object_stream(spark, path, "record", ["BUILDING", "HOUSEHOLD"], files_per_batch=2)
    seen = S.run_to_table(stream, "records", _folder(spark, "state"))
    return seen.select("type", "level", F.element_at("attrs", "kind").alias("kind"), F.element_at("attrs", "fid").cast("long").alias("fid"), F.size("pts").alias("points"), F.round(F.element_at("pts", 3)["x"], 3).alias("x1"), F.round(F.element_at("pts", 3)["y"], 3).alias("y1"))


def _providers(d) -> P.Providers:
    """Heights of points and of cells, by the name of their source; every source gives cells of 4 m."""
    known = P.Providers()
    known.register("highest", lambda spark: T.points(spark, d).groupBy(grid.cell("y", 4.0).alias("rr"), grid.cell("x", 4.0).alias("cc")).agg(F.max("z").alias("v")))
    known.register("ground", lambda spark: T.points(spark, d).where("cls = 2").groupBy(grid.cell("y", 4.0).alias("rr"), grid.cell("x", 4.0).alias("cc")).agg(F.avg("z").alias("v")))
    return known


def udf04_providers(spark, d):
    """Rasters from named sources, a file's among them, in one window; statistics of each."""
    path = _folder(spark, "list")
    T.points(spark, d).where("cls = 5").select("x", "y", "z").write.option("sep", " ").csv(path)
    known, out = _providers(d), None
    for source in ("ground", "highest", f"xyz:{path}"):
        part = known.raster(spark, source, (20, 20, 70, 80), 4.0).select(F.lit(source.split(":")[0]).alias("source"), "v")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("source").agg(F.count("*").alias("cells"), F.round(F.sum("v"), 4).alias("total"), F.max("v").alias("top"))


def snk05_technical_objects(spark, d):
    """Objects of all kinds in one normalised table; a later delivery replaces only the kinds that it has."""
    path = _folder(spark, "technical")
    r = T.rects(spark, d)
    W.replace_partitions(r.select("fid", "lvl", "kind"), path, "kind")
    W.replace_partitions(r.where("kind = 'BUILDING' and lvl >= 0").select("fid", "lvl", "kind"), path, "kind")
    return spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("n"), F.sum("fid").cast("long").alias("ids"))


def snk07_metric_history(spark, d):
    """Figures of two runs, appended, and their change."""
    path = _folder(spark, "history")
    m = T.rects(spark, d).groupBy("kind").agg(F.count("*").alias("n"))
    W.append_history(m, path, "a")
    W.append_history(m.withColumn("n", F.col("n") + F.length("kind")), path, "b")
    h = spark.read.parquet(path)
    return h.groupBy("kind").agg((F.max(F.when(F.col("run") == "b", F.col("n"))) - F.max(F.when(F.col("run") == "a", F.col("n")))).alias("change"))


def snk08_registry(spark, d):
    """The registry's lines: sources of each country in order."""
    n, s = T.table(spark, d, "nation"), T.table(spark, d, "supplier")
    both = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("country"), F.concat(F.lit("S"), F.col("s_suppkey") % 7).alias("source"))
    return W.registry_text(both)


def snk09_keyed_cache(spark, d):
    """A derived table under a key of its inputs: made once, read the second time."""
    root, key = _folder(spark, "cache"), W.cache_key("areas", 4.0)
    W.cached(spark, root, key, lambda: T.rects(spark, d).groupBy("lvl").agg(F.count("*").alias("n")))
    return W.cached(spark, root, key, lambda: T.rects(spark, d).limit(0).groupBy("lvl").agg(F.count("*").alias("n")))


SQL = {
    "src01_elements": "SELECT eid AS id, highway, surface, 1 AS points FROM fx_elements",
    "src03_everything": "SELECT 'way' AS type, 1 + CASE WHEN surface IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN lanes IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN tracktype IS NOT NULL THEN 1 ELSE 0 END AS tags, count(*) AS n FROM fx_elements GROUP BY 2",
    "src06_paged_layers": "SELECT kind AS layer, count(*) AS features, CAST(sum(lvl) AS BIGINT) AS levels FROM fx_rects GROUP BY 1",
    "src14_points_in_window": "SELECT cls, count(*) AS n, max(z) AS top FROM fx_points WHERE x >= 100 AND x < 300 AND y >= 50 AND y < 250 AND cls IN (2, 5) GROUP BY 1",
    "src18_xyz_cells": "SELECT CAST(floor(y/20) AS BIGINT) AS rr, CAST(floor(x/20) AS BIGINT) AS cc, max(z) AS v FROM fx_points GROUP BY 1, 2",
    "src20_raster_window": "SELECT rr, cc, dem FROM fx_cells WHERE rr >= 20 AND rr < 60 AND cc >= 30 AND cc < 55",
    "src26_rules_from_file": "SELECT CASE WHEN highway = 'track' AND tracktype = 'grade1' THEN '503' WHEN highway = 'track' THEN '504' WHEN surface = 'asphalt' THEN '501' ELSE '506' END AS code, count(*) AS n FROM fx_elements GROUP BY 1",
    "src28_geojson_areas": "SELECT fid, kind, 5 AS points, round(x1, 3) AS x1, round(y1, 3) AS y1 FROM fx_rects",
    "src30_event_log": "SELECT CAST(source_key AS VARCHAR) AS key, CASE WHEN ok THEN 'up' ELSE 'down' END AS event, count(*) AS n, max(code) AS code FROM fx_probes WHERE event_id % 50 <> 0 AND date_trunc('second', ts) >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1, 2",
    "snk01_feature_layer": "SELECT line_id, source, count(*) AS points, arg_min(x, pos) AS x FROM fx_vertices GROUP BY 1, 2",
    "snk02_layers": "SELECT kind, count(*) AS n, round(sum(x0), 3) AS x0 FROM fx_rects GROUP BY 1",
    "snk04_review": "WITH r AS (SELECT CASE WHEN surface IS NULL THEN 'no surface' WHEN highway = 'steps' THEN 'steps' END AS reason FROM fx_elements) SELECT CASE WHEN reason IS NULL THEN 'used' ELSE 'dropped' END AS status, reason, count(*) AS n FROM r GROUP BY 1, 2",
    "str10_record_stream": "SELECT kind AS type, lvl AS level, lower(kind) AS kind, fid, 5 AS points, round(x1, 3) AS x1, round(y1, 3) AS y1 FROM fx_rects WHERE kind IN ('BUILDING', 'HOUSEHOLD')",
    "udf04_providers": """WITH c AS (SELECT CAST(floor(y/4) AS BIGINT) AS rr, CAST(floor(x/4) AS BIGINT) AS cc, avg(z) FILTER (WHERE cls = 2) AS g, max(z) AS h, max(z) FILTER (WHERE cls = 5) AS f FROM fx_points GROUP BY 1, 2),
        a AS (SELECT rr, cc, 'ground' AS source, g AS v FROM c UNION ALL SELECT rr, cc, 'highest', h FROM c UNION ALL SELECT rr, cc, 'xyz', f FROM c)
        SELECT source, count(*) AS cells, round(sum(v), 4) AS total, max(v) AS top FROM a WHERE v IS NOT NULL AND rr >= 20 AND rr < 70 AND cc >= 20 AND cc < 80 GROUP BY 1""",
    "snk05_technical_objects": "SELECT kind, count(*) AS n, CAST(sum(fid) AS BIGINT) AS ids FROM fx_rects WHERE kind <> 'BUILDING' OR lvl >= 0 GROUP BY 1",
    "snk07_metric_history": "SELECT DISTINCT kind, length(kind) AS change FROM fx_rects",
    "snk08_registry": "WITH b AS (SELECT DISTINCT n_name AS country, 'S' || s_suppkey % 7 AS source FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT country, string_agg(source, ', ' ORDER BY source) AS text FROM b GROUP BY 1",
    "snk09_keyed_cache": "SELECT lvl, count(*) AS n FROM fx_rects GROUP BY 1",
}

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("src", "snk", "str10", "udf")) and callable(f)}
