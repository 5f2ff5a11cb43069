"""Tables as the operators expect them: points, cells, lines, areas, elements, events and jobs.

Each function reads only the columns it needs, so the projection reaches the
Parquet scan. ``SQL`` has the same tables as SQL text, for checks in another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL_M = 4.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LiDAR points: x, y, z, height above ground, class, return number, number of returns."""
    k, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    return table(spark, sf_dir, "lineitem").select(
        k, n, p, s,
        (((k * 37 + p * 11 + n * 101) % 4000).cast("double") / 10).alias("x"),
        (((k * 53 + s * 29 + p * 7) % 4000).cast("double") / 10).alias("y"),
        (F.col("l_quantity") / 2).alias("hag"),
        (F.lit(500) + F.col("l_quantity") / 2).alias("z"),
        F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "R", 3).otherwise(5).alias("cls"),
        (1 + n % 3).alias("rn"),
        (1 + n % 3 + s % 2).alias("nr"),
    )


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line vertices: one line a customer, in order of ``pos``."""
    from pyspark.sql import Window

    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        c.alias("line_id"),
        F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("pos"),
        (((o * 37 + c * 13) % 4000).cast("double") / 10).alias("x"),
        (((o * 91 + c * 7) % 4000).cast("double") / 10).alias("y"),
        F.col("o_orderpriority").alias("cls"),
        F.when(c % 3 == 0, "dtm").when(c % 3 == 1, "osm").otherwise("topo").alias("source"),
    )


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area features: rectangles with a kind and a level."""
    c = F.col("c_custkey")
    x0, y0 = ((c * 97) % 3600).cast("double") / 10, ((c * 193) % 3600).cast("double") / 10
    return table(spark, sf_dir, "customer").select(
        c.alias("fid"), F.col("c_mktsegment").alias("kind"), (F.col("c_nationkey") % 3 - 1).alias("lvl"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 5 + c % 20).alias("x1"), (y0 + 5 + c % 15).alias("y1"),
    )


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged ways: a map of tags beside the columns most rules use."""
    p, z = F.col("p_partkey"), F.col("p_size")
    kinds = ["track", "residential", "footway", "service", "path", "secondary", "steps", "cycleway"]
    highway = F.element_at(F.array(*(F.lit(k) for k in kinds)), (p % 8 + 1).cast("int"))
    surface = F.when(z % 3 == 0, "asphalt").when(z % 3 == 1, "gravel")
    lanes = F.when(z % 4 == 0, (1 + z % 5).cast("string"))
    tracktype = F.when(p % 5 == 0, F.concat(F.lit("grade"), (1 + z % 5).cast("string")))
    tags = F.map_filter(F.create_map(F.lit("highway"), highway, F.lit("surface"), surface, F.lit("lanes"), lanes, F.lit("tracktype"), tracktype), lambda _, v: v.isNotNull())
    return table(spark, sf_dir, "part").select(p.alias("eid"), highway.alias("highway"), surface.alias("surface"), lanes.alias("lanes"), tracktype.alias("tracktype"), F.col("p_brand").alias("name"), tags.alias("tags"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status probes of sources."""
    return probe_columns(table(spark, sf_dir, "events"))


def probe_columns(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    down = F.col("event_type") == "error"
    return events.select("event_id", "ts", (F.col("user_id") % 10).alias("source_key"), (~down).alias("ok"), F.when(down, 500 + e % 4).otherwise(200).alias("code"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "done_with_errors").otherwise("failed")
    return table(spark, sf_dir, "orders").select(
        k.alias("job_id"), F.col("o_orderdate").alias("created_at"), (c % 97).alias("ip_tag"), (c % 13).alias("ip_net_tag"), (c % 5).alias("country_no"),
        status.alias("status"), (F.col("o_totalprice") / 1000).alias("build_seconds"), (1 + k % 7).alias("est_prep_min"), (1 + k % 11).alias("est_maps_min"),
    )


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(c.alias("unit_code"), F.when(c % 4 == 0, "PART").otherwise("TOWN").alias("unit_kind"), F.col("o_orderpriority").alias("set_name"), F.col("o_orderdate").alias("released"), F.col("o_orderkey").alias("package_id"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("line_no"), F.col("role").alias("level"), F.col("text").alias("line"))


SQL = {
    "fx_points": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        CAST((l_orderkey*37 + l_partkey*11 + l_linenumber*101) % 4000 AS DOUBLE)/10 AS x,
        CAST((l_orderkey*53 + l_suppkey*29 + l_partkey*7) % 4000 AS DOUBLE)/10 AS y,
        l_quantity/2 AS hag, 500 + l_quantity/2 AS z,
        CASE l_returnflag WHEN 'A' THEN 2 WHEN 'R' THEN 3 ELSE 5 END AS cls,
        1 + l_linenumber % 3 AS rn, 1 + (l_linenumber % 3) + (l_suppkey % 2) AS nr FROM lineitem""",
    "fx_cells": """SELECT CAST(floor(y/4) AS BIGINT) AS rr, CAST(floor(x/4) AS BIGINT) AS cc, count(*) AS n,
        sum(CASE WHEN cls=2 THEN 1 ELSE 0 END) AS ground_hits, max(CASE WHEN cls IN (3,5) THEN z END) AS dsm,
        min(z) AS dem, max(z)-min(z) AS chm FROM fx_points GROUP BY 1,2""",
    "fx_dense": """SELECT g.rr, g.cc, c.n, c.ground_hits, c.dsm, c.dem, c.chm, c.n IS NOT NULL AS valid
        FROM (SELECT r.range AS rr, k.range AS cc FROM range(0, 100) r, range(0, 100) k) g LEFT JOIN fx_cells c ON g.rr = c.rr AND g.cc = c.cc""",
    "fx_vertices": """SELECT o_custkey AS line_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos,
        CAST((o_orderkey*37 + o_custkey*13) % 4000 AS DOUBLE)/10 AS x, CAST((o_orderkey*91 + o_custkey*7) % 4000 AS DOUBLE)/10 AS y,
        o_orderpriority AS cls, CASE WHEN o_custkey % 3 = 0 THEN 'dtm' WHEN o_custkey % 3 = 1 THEN 'osm' ELSE 'topo' END AS source FROM orders""",
    "fx_rects": """SELECT c_custkey AS fid, c_mktsegment AS kind, c_nationkey % 3 - 1 AS lvl,
        CAST((c_custkey*97) % 3600 AS DOUBLE)/10 AS x0, CAST((c_custkey*193) % 3600 AS DOUBLE)/10 AS y0,
        CAST((c_custkey*97) % 3600 AS DOUBLE)/10 + 5 + c_custkey % 20 AS x1, CAST((c_custkey*193) % 3600 AS DOUBLE)/10 + 5 + c_custkey % 15 AS y1 FROM customer""",
    "fx_elements": """SELECT p_partkey AS eid, CASE p_partkey % 8 WHEN 0 THEN 'track' WHEN 1 THEN 'residential' WHEN 2 THEN 'footway' WHEN 3 THEN 'service'
        WHEN 4 THEN 'path' WHEN 5 THEN 'secondary' WHEN 6 THEN 'steps' ELSE 'cycleway' END AS highway,
        CASE WHEN p_size % 3 = 0 THEN 'asphalt' WHEN p_size % 3 = 1 THEN 'gravel' END AS surface,
        CASE WHEN p_size % 4 = 0 THEN CAST(1 + p_size % 5 AS VARCHAR) END AS lanes,
        CASE WHEN p_partkey % 5 = 0 THEN 'grade' || CAST(1 + p_size % 5 AS VARCHAR) END AS tracktype, p_brand AS name FROM part""",
    "fx_probes": """SELECT event_id, ts, user_id % 10 AS source_key, event_type <> 'error' AS ok, CASE WHEN event_type='error' THEN 500 + event_id % 4 ELSE 200 END AS code FROM events""",
    "fx_jobs": """SELECT o_orderkey AS job_id, o_orderdate AS created_at, o_custkey % 97 AS ip_tag, o_custkey % 13 AS ip_net_tag, o_custkey % 5 AS country_no,
        CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'done_with_errors' ELSE 'failed' END AS status,
        o_totalprice/1000 AS build_seconds, 1 + o_orderkey % 7 AS est_prep_min, 1 + o_orderkey % 11 AS est_maps_min FROM orders""",
    "fx_packages": """SELECT o_custkey AS unit_code, CASE WHEN o_custkey % 4 = 0 THEN 'PART' ELSE 'TOWN' END AS unit_kind, o_orderpriority AS set_name, o_orderdate AS released, o_orderkey AS package_id FROM orders""",
    "fx_loglines": """SELECT conv_id AS job_id, turn AS line_no, role AS level, text AS line FROM conversations""",
}
_NEEDS = {"fx_cells": ["fx_points"], "fx_dense": ["fx_points", "fx_cells"]}


def with_tables(sql: str) -> str:
    """``sql`` after the tables above that it names, as common table expressions."""
    wanted: list[str] = []
    for name in SQL:
        if name in sql:
            wanted += [n for n in [*_NEEDS.get(name, []), name] if n not in wanted]
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in wanted)
    if not head:
        return sql
    body = sql.lstrip()
    for word in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(word):
            return f"{word}{head}, {body[len(word):]}"
    return f"WITH {head} {body}"
