"""Queries over tagged elements, log lines and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import classify as C
from geoloom.sources import tables as T

#: (pattern, category, advice, severity): the first that matches counts.
LINE_RULES = [("(?i)timeout|slow", "network", "retry", 1), ("(?i)\\bthe\\b.*\\band\\b", "mixed", "look", 2), ("(?i)tion", "noun", "none", 3)]
VECTOR_RULES = [(1, "highway=track&tracktype=grade1", "503"), (2, "highway=track&surface!=", "504"), (3, "highway=track", "505"), (4, "highway=steps", "532"), (5, "surface=asphalt&lanes!=", "502"), (6, "surface=asphalt", "503"), (7, "highway!=", "506")]


def prj03_refined_highway(spark, d):
    return T.elements(spark, d).select("eid", C.refined_highway().alias("draw"))


def prj05_symbol_codes(spark, d):
    codes = spark.createDataFrame([("track", "504"), ("track_fast", "503"), ("track_slow", "505"), ("path", "506"), ("path_major", "505"), ("steps", "532"), ("road_2", "503"), ("road_3", "502"), ("road_4", "502.1")], "draw string, code string")
    drawn = T.elements(spark, d).select("eid", C.refined_highway().alias("draw"))
    return drawn.join(F.broadcast(codes), "draw", "left").groupBy("draw", "code").agg(F.count("*").alias("n"))


def prj06_unknown_codes(spark, d):
    known = spark.createDataFrame([("asphalt",), ("paved",)], "surface string")
    return T.elements(spark, d).where("surface is not null").join(F.broadcast(known), "surface", "left_anti").groupBy("surface").agg(F.count("*").alias("n"))


def prj07_first_rule(spark, d):
    return C.first_match(T.elements(spark, d), VECTOR_RULES, "eid")


def prj08_skip_reasons(spark, d):
    return T.elements(spark, d).select(C.skip_reason().alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def prj10_road_rank(spark, d):
    rank = C.road_rank(C.tag("highway"), C.lanes_total(), C.is_paved(C.tag("surface")))
    return T.elements(spark, d).where(F.col("highway").isin(*C.ROADS)).select("eid", rank.alias("rank"))


def prj11_voltage(spark, d):
    raw = F.concat((F.col("p_size") * 1000).cast("string"), F.lit(";"), F.col("p_size").cast("string"), F.lit(" kV;x"))
    return T.table(spark, d, "part").select(F.col("p_partkey").alias("eid"), C.max_voltage(raw).alias("volts"))


def prj12_width_codes(spark, d):
    width = F.when(F.col("eid") % 7 != 0, (F.col("eid") % 24) / 2.0)
    draw = C.refined_highway()
    tag_code = F.when(draw.startswith("road_"), "503").otherwise("506")
    return T.elements(spark, d).select(C.width_code(draw, width, tag_code).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def prj13_slivers(spark, d):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    area, mean_width = w * h, 2 * w * h / (2 * (w + h))
    return T.rects(spark, d).select("fid", area.alias("area"), F.round(mean_width, 4).alias("mean_width"), ((area < 60) | (mean_width < 4)).alias("sliver"))


def prj15_small_as_points(spark, d):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    small = w * h < 80
    return T.rects(spark, d).select("fid", F.when(small, "point").otherwise("area").alias("geom"), F.when(small, (F.col("x0") + F.col("x1")) / 2).alias("cx"), F.when(small, (F.col("y0") + F.col("y1")) / 2).alias("cy"))


def prj17_levels(spark, d):
    return T.rects(spark, d).groupBy(F.when(F.col("lvl") < 0, "below").when(F.col("lvl") == 0, "ground").otherwise("above").alias("level")).agg(F.count("*").alias("n"))


def prj20_probe_kinds(spark, d):
    p = T.probes(spark, d).where("not ok").withColumn("code", F.when(F.col("event_id") % 3 == 0, F.col("code") - 100).otherwise(F.col("code")))
    return p.groupBy("code", C.probe_kind(F.col("code"), F.lit(None).cast("string"), F.col("event_id") % 50 == 0).alias("kind")).agg(F.count("*").alias("n"))


def prj21_line_issues(spark, d):
    return C.explain_lines(T.log_lines(spark, d), LINE_RULES).groupBy("category", "advice", "severity").agg(F.count("*").alias("n"))


def prj22_withheld(spark, d):
    patterns = spark.createDataFrame([("%src1",), ("%src2",)], "pattern string")
    names = T.table(spark, d, "documents").select("source").distinct()
    return names.join(F.broadcast(patterns), F.like(F.col("source"), F.col("pattern")), "left_anti")


def prj24_noise_filter(spark, d):
    return T.points(spark, d).where((F.col("cls") != 3) & (F.col("rn") <= F.col("nr"))).groupBy("cls").agg(F.count("*").alias("n"), F.max("z").alias("top"))


def prj25_oversized(spark, d):
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return T.rects(spark, d).groupBy("kind").agg(F.sum((area <= 300).cast("long")).alias("kept"), F.sum((area > 300).cast("long")).alias("dropped"))


def prj27_listed_layers(spark, d):
    listed = spark.createDataFrame([("BUILDING",), ("FURNITURE",), ("NOTHING",)], "kind string")
    return T.rects(spark, d).join(F.broadcast(listed), "kind", "left_semi").groupBy("kind").agg(F.count("*").alias("n"))


def prj28_registry_coverage(spark, d):
    nation, supplier = T.table(spark, d, "nation"), T.table(spark, d, "supplier")
    return nation.join(supplier, nation.n_nationkey == supplier.s_nationkey, "left_anti").select("n_nationkey", "n_name")


def fun12_word_figures(spark, d):
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return T.table(spark, d, "documents").groupBy("lang").agg(F.sum(F.size(words)).cast("long").alias("words"), F.count("*").alias("docs"))


def fun14_url_parts(spark, d):
    return T.table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"), F.size(F.split("url", "/")).alias("depth"))


def fun15_masked_names(spark, d):
    return T.table(spark, d, "customer").select("c_custkey", F.sha2(F.concat(F.lit("salt"), F.lower("c_name")), 256).alias("tag"))


def fun16_extent_keys(spark, d):
    key = F.concat_ws(",", *(F.format_string("%.1f", F.col(c)) for c in ("x0", "y0", "x1", "y1")))
    return T.rects(spark, d).select("fid", F.sha2(key, 256).alias("key"))


def fun19_json_fields(spark, d):
    return T.table(spark, d, "events").groupBy("event_type").agg(F.count(F.get_json_object("props", "$.k")).alias("with_k"), F.count("*").alias("n"))


_SPEC = "highway IN ('residential', 'service', 'secondary')"
_RANK = "least(3, CASE highway WHEN 'secondary' THEN 3 WHEN 'residential' THEN 1 ELSE 0 END + CASE WHEN CAST(coalesce(lanes, '0') AS INT) >= 2 THEN 1 WHEN surface = 'asphalt' THEN 1 WHEN highway = 'residential' THEN 1 ELSE 0 END)"
_DRAW = f"""CASE WHEN {_SPEC} THEN 'road_' || CAST({_RANK} + 1 AS VARCHAR)
  WHEN highway = 'track' THEN CASE WHEN surface = 'asphalt' AND CAST(coalesce(lanes, '0') AS INT) >= 2 THEN 'road_3' WHEN surface = 'asphalt' THEN 'road_2' WHEN tracktype = 'grade1' THEN 'track_fast' WHEN tracktype IN ('grade4', 'grade5') THEN 'track_slow' ELSE 'track' END
  WHEN highway = 'path' AND surface = 'gravel' THEN 'path_major' WHEN highway = 'footway' AND surface = 'asphalt' THEN 'sidewalk' WHEN highway = 'cycleway' AND surface = 'asphalt' THEN 'cycleway_paved' ELSE highway END"""
_CODES = "(VALUES ('track', '504'), ('track_fast', '503'), ('track_slow', '505'), ('path', '506'), ('path_major', '505'), ('steps', '532'), ('road_2', '503'), ('road_3', '502'), ('road_4', '502.1')) c(draw, code)"
_RECT = "(x1 - x0) * (y1 - y0)"

SQL = {
    "prj03_refined_highway": f"SELECT eid, {_DRAW} AS draw FROM fx_elements",
    "prj05_symbol_codes": f"WITH e AS (SELECT {_DRAW} AS draw FROM fx_elements) SELECT e.draw, c.code, count(*) AS n FROM e LEFT JOIN {_CODES} ON e.draw = c.draw GROUP BY 1, 2",
    "prj06_unknown_codes": "SELECT surface, count(*) AS n FROM fx_elements WHERE surface IS NOT NULL AND surface NOT IN ('asphalt', 'paved') GROUP BY 1",
    "prj07_first_rule": "SELECT eid, CASE WHEN highway = 'track' AND tracktype = 'grade1' THEN '503' WHEN highway = 'track' AND surface IS NOT NULL THEN '504' WHEN highway = 'track' THEN '505' WHEN highway = 'steps' THEN '532' WHEN surface = 'asphalt' AND lanes IS NOT NULL THEN '502' WHEN surface = 'asphalt' THEN '503' ELSE '506' END AS code FROM fx_elements",
    "prj08_skip_reasons": "SELECT CASE WHEN highway IN ('residential', 'service', 'secondary') THEN 'highway' END AS reason, count(*) AS n FROM fx_elements GROUP BY 1",
    "prj10_road_rank": f"SELECT eid, {_RANK} AS rank FROM fx_elements WHERE {_SPEC}",
    "prj11_voltage": "SELECT p_partkey AS eid, p_size * 1000 AS volts FROM part",
    "prj12_width_codes": f"""WITH e AS (SELECT {_DRAW} AS draw, CASE WHEN eid % 7 <> 0 THEN (eid % 24) / 2.0 END AS w FROM fx_elements), k AS (SELECT *, CASE WHEN starts_with(draw, 'road_') THEN '503' ELSE '506' END AS code FROM e)
      SELECT CASE WHEN w IS NULL THEN code WHEN starts_with(draw, 'road_') AND w >= 9 THEN '502.1' WHEN starts_with(draw, 'road_') AND w >= 5 THEN '502' WHEN draw IN ('sidewalk', 'footway', 'path', 'pedestrian', 'cycleway', 'cycleway_paved') AND w >= 2.5 THEN '505' ELSE code END AS code, count(*) AS n FROM k GROUP BY 1""",
    "prj13_slivers": f"SELECT fid, {_RECT} AS area, round(2 * {_RECT} / (2 * ((x1 - x0) + (y1 - y0))), 4) AS mean_width, {_RECT} < 60 OR 2 * {_RECT} / (2 * ((x1 - x0) + (y1 - y0))) < 4 AS sliver FROM fx_rects",
    "prj15_small_as_points": f"SELECT fid, CASE WHEN {_RECT} < 80 THEN 'point' ELSE 'area' END AS geom, CASE WHEN {_RECT} < 80 THEN (x0 + x1) / 2 END AS cx, CASE WHEN {_RECT} < 80 THEN (y0 + y1) / 2 END AS cy FROM fx_rects",
    "prj17_levels": "SELECT CASE WHEN lvl < 0 THEN 'below' WHEN lvl = 0 THEN 'ground' ELSE 'above' END AS level, count(*) AS n FROM fx_rects GROUP BY 1",
    "prj20_probe_kinds": "WITH p AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN code - 100 ELSE code END AS code FROM fx_probes WHERE NOT ok) SELECT code, CASE WHEN event_id % 50 = 0 THEN 'planned' WHEN code BETWEEN 400 AND 499 AND code NOT IN (408, 425, 429) THEN 'persistent' ELSE 'transient' END AS kind, count(*) AS n FROM p GROUP BY 1, 2",
    "prj21_line_issues": "SELECT " + ", ".join(f"CASE {' '.join('WHEN regexp_matches(line, ' + chr(39) + r[0] + chr(39) + ') THEN ' + (repr(r[i]) if isinstance(r[i], str) else str(r[i])) for r in LINE_RULES)} END AS {n}" for i, n in ((1, "category"), (2, "advice"), (3, "severity"))) + ", count(*) AS n FROM fx_loglines GROUP BY 1, 2, 3",
    "prj22_withheld": "SELECT DISTINCT source FROM documents WHERE source NOT LIKE '%src1' AND source NOT LIKE '%src2'",
    "prj24_noise_filter": "SELECT cls, count(*) AS n, max(z) AS top FROM fx_points WHERE cls <> 3 AND rn <= nr GROUP BY 1",
    "prj25_oversized": f"SELECT kind, sum(CASE WHEN {_RECT} <= 300 THEN 1 ELSE 0 END) AS kept, sum(CASE WHEN {_RECT} > 300 THEN 1 ELSE 0 END) AS dropped FROM fx_rects GROUP BY 1",
    "prj27_listed_layers": "SELECT kind, count(*) AS n FROM fx_rects WHERE kind IN ('BUILDING', 'FURNITURE', 'NOTHING') GROUP BY 1",
    "prj28_registry_coverage": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)",
    "fun12_word_figures": "SELECT lang, CAST(sum(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS words, count(*) AS docs FROM documents GROUP BY 1",
    "fun14_url_parts": "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, len(string_split(url, '/')) AS depth FROM pages",
    "fun15_masked_names": "SELECT c_custkey, sha256('salt' || lower(c_name)) AS tag FROM customer",
    "fun16_extent_keys": "SELECT fid, sha256(printf('%.1f,%.1f,%.1f,%.1f', x0, y0, x1, y1)) AS key FROM fx_rects",
    "fun19_json_fields": "SELECT event_type, count(json_extract_string(props, '$.k')) AS with_k, count(*) AS n FROM events GROUP BY 1",
}

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("prj", "fun")) and callable(f)}
