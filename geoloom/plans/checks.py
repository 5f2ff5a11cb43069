"""Queries that check requests, inventories and catalogues, spread flags, and gather relief points."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.operators import classify, lines, sequence
from geoloom.operators import graph as G
from geoloom.plans.lines import SQL as LINE_SQL
from geoloom.plans.rules import _DRAW
from geoloom.plans.shapes import SQL as SHAPE_SQL
from geoloom.plans.shapes import ras28_boulder_peaks
from geoloom.plans.terrain import SQL as TERRAIN_SQL
from geoloom.plans.terrain import ras27_depressions, ras27_knolls
from geoloom.sources import readers as R
from geoloom.operators import spatial_join as J
from geoloom.sources import tables as T
from geoloom.sources.store import written


def prj01_extents(spark, d):
    """Extents from texts; those with broken, missing or turned numbers are left out."""
    x = lambda c: F.format_string("%.1f", F.col(c) / 10)
    k = F.col("fid") % 9
    raw = F.when(k == 1, F.concat_ws(",", x("x0"), x("y0"), x("x1"))).when(k == 2, F.concat_ws(",", x("x1"), x("y0"), x("x0"), x("y1"))).when(k == 3, F.concat_ws(",", x("x0"), F.lit("north"), x("x1"), x("y1"))).otherwise(F.concat_ws(" , ", x("x0"), x("y0"), x("x1"), x("y1")))
    e = T.rects(spark, d).select("fid", classify.extent(raw).alias("e")).where("e is not null")
    return e.select("fid", "e.west", "e.south", "e.east", "e.north")


def prj09_highway_refinement(spark, d):
    """Refined classes of ways with how many there are of each class and surface."""
    return T.elements(spark, d).groupBy("highway", "surface", classify.refined_highway().alias("draw")).agg(F.count("*").alias("n"))


def grf11_spread_flag(spark, d):
    """A flag that spreads over touching features unless they are buildings."""
    r = T.rects(spark, d)
    ids = r.select(F.col("fid").alias("id"))
    links = T.table(spark, d, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 1499 + 1).alias("b"))
    return G.propagated(ids, links, ids.where("id % 100 = 7"), r.where("kind = 'MACHINERY'").select(F.col("fid").alias("id")))


def _maybe_narrow(st, areas, reach, width):
    """Stations in an area, less those where one area alone is ``width`` across already. Both in whole hits with a margin, so that rounding leaves off no
    narrow one; what is left is few, and only its rays are cut by areas."""
    near = J.inside(st, areas.select(*((F.col(c) + k).alias(c) for c, k in zip(J.BOX, (-1e-6, -1e-6, 1e-6, 1e-6)))))
    # along the ray (ty, -tx): the ways to an area's edges ahead and behind, by each axis
    ways = [("x", "ty", F.col("ty")), ("y", "tx", -F.col("tx"))]
    per = near.select("*", *(F.coalesce(1 / F.nullif(F.abs(c), F.lit(0.0)), F.lit(1e18)).alias(f"__{t}") for _, t, c in ways))
    ahead, behind = ([F.when((c > 0) == F.lit(on), F.col(f"{a}1") - F.col(a)).otherwise(F.col(a) - F.col(f"{a}0")) * F.col(f"__{t}") for a, t, c in ways] for on in (True, False))
    ahead, behind = F.least(*ahead, F.lit(reach)), F.least(*behind, F.lit(reach))
    wide = (ahead > 1e-6) & (behind > 1e-6) & (ahead + behind >= width + 1e-6)
    return J.inside(per, areas, also=wide, how="left_anti").drop("__ty", "__tx")


def jon21_narrow_runs(spark, d):
    """Runs of stations where the area around a line is narrower than 8 m, two stations at least."""
    step, reach, least = 25.0, 20.0, 8.0
    areas = written(J.shapes(T.rects(spark, d).where("kind <> 'BUILDING'")).drop("n"))
    st = _maybe_narrow(sequence.stations(sequence.segments(T.vertices(spark, d)).where("source = 'dtm'"), step), areas, reach, least)
    st = written(st).withColumn("station", F.concat_ws(":", "line_id", "k"))
    ray = st.select(F.col("station").alias("line_id"), F.lit(1).alias("pos"), F.col("line_id").alias("line"), "k", (F.col("x") - reach * F.col("ty")).alias("ax"), (F.col("y") + reach * F.col("tx")).alias("ay"), (F.col("x") + reach * F.col("ty")).alias("bx"), (F.col("y") - reach * F.col("tx")).alias("by"))
    inside = lines.in_boxes(ray, areas, 16.0).select("line_id", "line", "k", (F.col("t0") * 2 * reach).alias("s0"), (F.col("t1") * 2 * reach).alias("s1"))
    width = lines.merged(inside, ["line_id"], ["line", "k"]).where(f"s0 <= {reach} and s1 >= {reach}").withColumn("narrow", F.col("s1") - F.col("s0") < least)
    near = width.where("narrow").withColumn("g", F.col("k") - F.row_number().over(Window.partitionBy("line").orderBy("k")))
    return near.groupBy(F.col("line").alias("line_id"), "g").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count("*").alias("n")).where("n >= 2").select("line_id", "first", "last", "n")


def src04_tiled_extent(spark, d):
    """An extent in tiles, with the points of each; tiles without any are there too."""
    tiles = R.split_extent(spark, 0.0, 0.0, 400.0, 400.0, 150.0)
    n = T.points(spark, d).groupBy(F.floor(F.col("x") / 150).alias("tx"), F.floor(F.col("y") / 150).alias("ty")).agg(F.count("*").alias("n"))
    return tiles.join(n, ["tx", "ty"], "left").select("tx", "ty", "west", "south", "east", "north", F.coalesce("n", F.lit(0)).alias("n"))


def src05_metric_grid(spark, d):
    """Kilometre sheets by name, their bounds, and the features of each."""
    r = T.rects(spark, d).select("fid", F.concat(F.lit("E"), F.floor(F.col("x0") / 50).cast("string"), F.lit("_N"), F.floor(F.col("y0") / 50).cast("string")).alias("sheet"))
    return r.groupBy("sheet").agg(F.count("*").alias("n")).select("sheet", R.sheet_bounds(F.col("sheet")).alias("b"), "n").select("sheet", "b.x0", "b.y0", "b.x1", "b.y1", "n")


def src22_newest_assets(spark, d):
    """The newest release of each unit at the wanted resolution."""
    p = T.packages(spark, d).groupBy("unit_code", F.year("released").alias("year")).agg(F.count("*").alias("files")).withColumn("gsd", F.when(F.col("year") % 2 == 0, 0.5).otherwise(1.0))
    return R.newest_assets(p, "unit_code", "year", "gsd", 0.5).select("unit_code", "year", "files")


def src25_inventory(spark, d):
    """Sheets of terrain and surface side by side, with what is wrong about each."""
    p = T.points(spark, d).select(F.concat_ws("-", F.floor(F.col("x") / 20), F.floor(F.col("y") / 20)).alias("sheet"), "z", "cls")
    one = lambda where: p.where(where).groupBy("sheet").agg(F.min("z").alias("low"), F.max("z").alias("high"))
    return R.inventory(one("cls = 2"), one("cls = 5 and z > 501"), "sheet", "low", "high", (500.6, 524.9)).where("problem is not null")


def src29_job_tables(spark, d):
    """Job and usage tables, as the reports read them."""
    j = T.jobs(spark, d)
    return j.groupBy("status", "country_no").agg(F.count("*").alias("jobs"), F.round(F.sum("build_seconds"), 2).alias("seconds"), F.min("job_id").alias("first_job"))


def pip07_relief_points(spark, d):
    """Knolls, depressions and boulders as one layer of points with their symbol."""
    part = lambda df, kind, code: df.select("rr", "cc", F.lit(kind).alias("kind"), F.lit(code).alias("code"))
    return part(ras27_knolls(spark, d), "knoll", "109").unionByName(part(ras27_depressions(spark, d), "depression", "111")).unionByName(part(ras28_boulder_peaks(spark, d), "boulder", "204"))


SQL = {
    "prj01_extents": "SELECT fid, round(x0/10 + 1e-9, 1) AS west, round(y0/10 + 1e-9, 1) AS south, round(x1/10 + 1e-9, 1) AS east, round(y1/10 + 1e-9, 1) AS north FROM fx_rects WHERE fid % 9 NOT IN (1, 2, 3)",
    "prj09_highway_refinement": f"SELECT highway, surface, {_DRAW} AS draw, count(*) AS n FROM fx_elements GROUP BY 1, 2, 3",
    "grf11_spread_flag": "WITH RECURSIVE o AS (SELECT fid AS id FROM fx_rects WHERE kind = 'MACHINERY' OR fid % 100 = 7), l AS (SELECT o_custkey AS a, o_orderkey % 1499 + 1 AS b FROM orders), u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), k AS (SELECT u.a, u.b FROM u JOIN o x ON x.id = u.a JOIN o y ON y.id = u.b), r(id) AS (SELECT fid FROM fx_rects WHERE fid % 100 = 7 UNION SELECT k.b FROM r JOIN k ON k.a = r.id) SELECT id FROM r",
    "jon21_narrow_runs": LINE_SQL["jon18_widths"].split("SELECT line_id, count(*) AS stations")[0] + ", w AS (SELECT line_id, k FROM m WHERE s0 <= 20 AND s1 >= 20 AND s1 - s0 < 8), z AS (SELECT *, k - row_number() OVER (PARTITION BY line_id ORDER BY k) AS g2 FROM w) SELECT line_id, min(k) AS first, max(k) AS last, count(*) AS n FROM z GROUP BY line_id, g2 HAVING count(*) >= 2",
    "src04_tiled_extent": "WITH t AS (SELECT r.range AS ty, k.range AS tx FROM range(0, 3) r, range(0, 3) k), n AS (SELECT CAST(floor(x/150) AS BIGINT) AS tx, CAST(floor(y/150) AS BIGINT) AS ty, count(*) AS n FROM fx_points GROUP BY 1, 2) SELECT t.tx, t.ty, t.tx*150.0::DOUBLE AS west, t.ty*150.0::DOUBLE AS south, least(400.0::DOUBLE, (t.tx+1)*150) AS east, least(400.0::DOUBLE, (t.ty+1)*150) AS north, coalesce(n, 0) AS n FROM t LEFT JOIN n ON n.tx = t.tx AND n.ty = t.ty",
    "src05_metric_grid": "WITH s AS (SELECT CAST(floor(x0/50) AS BIGINT) AS e, CAST(floor(y0/50) AS BIGINT) AS n, count(*) AS c FROM fx_rects GROUP BY 1, 2) SELECT 'E' || e || '_N' || n AS sheet, e*1000 AS x0, n*1000 AS y0, e*1000 + 1000 AS x1, n*1000 + 1000 AS y1, c AS n FROM s",
    "src22_newest_assets": "WITH p AS (SELECT unit_code, CAST(year(released) AS INTEGER) AS year, count(*) AS files FROM fx_packages GROUP BY 1, 2) SELECT unit_code, year, files FROM p WHERE year % 2 = 0 QUALIFY row_number() OVER (PARTITION BY unit_code ORDER BY year DESC) = 1",
    "src25_inventory": "WITH p AS (SELECT CAST(floor(x/20) AS BIGINT) || '-' || CAST(floor(y/20) AS BIGINT) AS sheet, z, cls FROM fx_points), t AS (SELECT sheet, min(z) AS lo, max(z) AS hi FROM p WHERE cls = 2 GROUP BY 1), s AS (SELECT sheet, min(z) AS lo, max(z) AS hi FROM p WHERE cls = 5 AND z > 501 GROUP BY 1), q AS (SELECT coalesce(t.sheet, s.sheet) AS sheet, CASE WHEN t.sheet IS NULL THEN 'no terrain' WHEN s.sheet IS NULL THEN 'no surface' WHEN t.lo < 500.6 OR t.hi > 524.9 OR s.lo < 500.6 OR s.hi > 524.9 THEN 'odd heights' WHEN s.hi < t.lo THEN 'surface below terrain' END AS problem FROM t FULL JOIN s ON s.sheet = t.sheet) SELECT sheet, problem FROM q WHERE problem IS NOT NULL",
    "src29_job_tables": "SELECT status, country_no, count(*) AS jobs, round(sum(build_seconds), 2) AS seconds, min(job_id) AS first_job FROM fx_jobs GROUP BY 1, 2",
    "pip07_relief_points": f"WITH kn AS ({TERRAIN_SQL['ras27_knolls']}), dp AS ({TERRAIN_SQL['ras27_depressions']}), bp AS ({SHAPE_SQL['ras28_boulder_peaks']}) SELECT rr, cc, 'knoll' AS kind, '109' AS code FROM kn UNION ALL SELECT rr, cc, 'depression', '111' FROM dp UNION ALL SELECT rr, cc, 'boulder', '204' FROM bp",
}

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("prj", "grf", "jon", "src", "pip")) and callable(f)}
