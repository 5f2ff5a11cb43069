"""Queries for line, area and issue metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import cellsets, classify, focal, grid, sequence
from geoloom.operators import spatial_join as J
from geoloom.plans.rules import LINE_RULES
from geoloom.sources import tables as T


def agg07_area_top(spark, d):
    """Highest point inside areas, by the area's cells."""
    cells = cellsets.box_cells(T.rects(spark, d).where("lvl = 1"), T.CELL_M, "fid")
    tops = grid.with_cell(T.points(spark, d), T.CELL_M).groupBy("rr", "cc").agg(F.max("z").alias("z"))
    return cells.join(tops, ["rr", "cc"]).groupBy("fid").agg(F.max("z").alias("top"), F.count("*").alias("cells"))


def agg14_match_share(spark, d):
    """Share of each class's length that runs within 5 m of another source's lines."""
    seg = sequence.segments(T.vertices(spark, d))
    own = sequence.stations(seg.where("source = 'topo'"), 25.0).join(seg.where("source = 'topo' and pos = 1").select("line_id", "cls"), "line_id")
    hit = J.beside_any(own.select("cls", "x", "y"), seg.where("source = 'osm'").select("ax", "ay", "bx", "by"), 5.0).groupBy("cls").agg(F.count("*").alias("hits"))
    every = own.groupBy("cls").agg(F.count("*").alias("stations"))
    return every.join(hit.withColumnRenamed("cls", "k"), F.col("cls").eqNullSafe(F.col("k")), "left").select("cls", "stations", F.round(F.coalesce("hits", F.lit(0)) / F.col("stations"), 5).alias("share"))


def agg33_z_scores(spark, d):
    """A figure against mean and spread of a reference class."""
    e = T.table(spark, d, "events")
    ref = e.where("event_type = 'view'").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return e.join(F.broadcast(ref), F.lit(True)).groupBy("event_type").agg(F.round(F.avg((F.col("value") - F.col("m")) / F.col("s")), 5).alias("z"))


def agg34_neighbour_mode(spark, d):
    """Commonest class of the eight cells around; the smallest on ties."""
    c = grid.surfaces(T.points(spark, d), T.CELL_M).select("rr", "cc", grid.ladder(F.col("chm"), (8.0, 16.0, 20.0, 23.0)).alias("cls"))
    around = focal.shifted(c, [o for o in focal.disk(1.5) if o != (0, 0)]).groupBy("rr", "cc", "cls").agg(F.count("*").alias("n"))
    mode = around.groupBy("rr", "cc").agg(F.min_by("cls", F.struct(-F.col("n"), F.col("cls"))).alias("mode"))
    return c.join(mode, ["rr", "cc"]).select("rr", "cc", "mode")


def agg35_scene_share(spark, d):
    e = T.table(spark, d, "events")
    return e.groupBy((F.col("user_id") % 20).alias("scene")).agg(F.round(F.avg(F.col("event_type").isin("error", "purchase").cast("int")), 5).alias("bad_share"), F.count("*").alias("n"))


def agg37_issue_summary(spark, d):
    x = classify.explain_lines(T.log_lines(spark, d), LINE_RULES).where("category is not null")
    return x.groupBy("job_id").agg(F.min("severity").alias("worst"), F.min_by("category", "severity").alias("category"), F.countDistinct("line").alias("texts"))


def jon10_absorbed(spark, d):
    r = T.rects(spark, d)
    low = r.where("lvl = -1")
    hit = J.shape_overlaps(low, r.where("lvl = 0")).groupBy(*J.BOX).agg(F.max("common").alias("common"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return low.join(hit, list(J.BOX), "left").select("fid", (F.coalesce("common", F.lit(0.0)) >= 0.5 * area).alias("absorbed"))


def jon14_points_in_buildings(spark, d):
    v = T.vertices(spark, d).where("cls = '1-URGENT'").select("line_id", "pos", "x", "y")
    inside = J.points_in_boxes(v, J.shapes(T.rects(spark, d).where("kind = 'BUILDING'")).drop("n")).select("line_id", "pos").distinct()
    return v.join(inside, ["line_id", "pos"], "left_anti").select("line_id", "pos")


def jon16_beside_road(spark, d):
    """Lines with 70 % of their stations within 8 m of a road line."""
    seg = sequence.segments(T.vertices(spark, d))
    own = sequence.stations(seg.where("source = 'topo'"), 25.0)
    hit = J.beside_segments(own, seg.where("source = 'dtm'").select("ax", "ay", "bx", "by"), 8.0).groupBy("line_id").agg(F.count("*").alias("hits"))
    return own.groupBy("line_id").agg(F.count("*").alias("n")).join(hit, "line_id", "left").select("line_id", (F.coalesce("hits", F.lit(0)) >= 0.7 * F.col("n")).alias("beside"))


def jon28_blocked(spark, d):
    """Areas with no cell in common with any blocking area."""
    mine = cellsets.box_cells(T.rects(spark, d).where("kind = 'FURNITURE'"), T.CELL_M, "fid")
    block = cellsets.box_cells(T.rects(spark, d).where("kind = 'MACHINERY'"), T.CELL_M)
    bad = cellsets.both(mine, block).select("fid").distinct()
    return mine.select("fid").distinct().join(bad, "fid", "left_anti")


_STA = """sv AS (SELECT line_id, pos, source, cls, x AS ax, y AS ay, lead(x) OVER (PARTITION BY line_id ORDER BY pos) AS bx, lead(y) OVER (PARTITION BY line_id ORDER BY pos) AS by_ FROM fx_vertices{where}),
    sl AS (SELECT *, sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)) AS len FROM sv WHERE bx IS NOT NULL),
    seg AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY line_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m0 FROM sl),
    sk AS (SELECT *, unnest(range(CAST(ceil(m0/25) AS BIGINT), CAST(ceil((m0+len)/25) AS BIGINT))) AS k FROM seg WHERE len > 0),
    sta AS (SELECT line_id, source, k, ax + (k*25-m0)/len*(bx-ax) AS x, ay + (k*25-m0)/len*(by_-ay) AS y FROM sk)"""


def _near(distance: float, other: str) -> str:
    t = "greatest(0, least(1, coalesce(((o.x-ax)*(bx-ax)+(o.y-ay)*(by_-ay))/nullif(len*len, 0), 0)))"
    return f"""o AS (SELECT * FROM sta WHERE source = 'topo'), h AS (SELECT DISTINCT o.line_id, o.k FROM o JOIN seg ON seg.source = '{other}' AND o.x BETWEEN least(ax,bx)-{distance} AND greatest(ax,bx)+{distance} AND o.y BETWEEN least(ay,by_)-{distance} AND greatest(ay,by_)+{distance}
      AND power(o.x-ax-{t}*(bx-ax), 2) + power(o.y-ay-{t}*(by_-ay), 2) <= {distance * distance})"""


_MID = "(c.cc+0.5::DOUBLE)*4 >= q.x0 AND (c.cc+0.5::DOUBLE)*4 < q.x1 AND (c.rr+0.5::DOUBLE)*4 >= q.y0 AND (c.rr+0.5::DOUBLE)*4 < q.y1"
_LADDER = "CASE WHEN chm < 8 THEN 1 WHEN chm < 16 THEN 2 WHEN chm < 20 THEN 3 WHEN chm < 23 THEN 4 ELSE 0 END"
_RULES = lambda i: f"CASE {' '.join('WHEN regexp_matches(line, ' + chr(39) + r[0] + chr(39) + ') THEN ' + (repr(r[i]) if isinstance(r[i], str) else str(r[i])) for r in LINE_RULES)} END"

SQL = {
    "agg07_area_top": f"WITH t AS (SELECT CAST(floor(y/4) AS BIGINT) AS rr, CAST(floor(x/4) AS BIGINT) AS cc, max(z) AS z FROM fx_points GROUP BY 1, 2) SELECT fid, max(z) AS top, count(*) AS cells FROM t c JOIN fx_rects q ON q.lvl = 1 AND {_MID} GROUP BY 1",
    "agg14_match_share": f"WITH {_STA.format(where='')}, {_near(5.0, 'osm')}, f AS (SELECT line_id, cls FROM fx_vertices WHERE pos = 1) SELECT f.cls, count(*) AS stations, round(count(h.k) / count(*), 5) AS share FROM o JOIN f ON o.line_id = f.line_id LEFT JOIN h ON o.line_id = h.line_id AND o.k = h.k GROUP BY 1",
    "agg33_z_scores": "WITH r AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events WHERE event_type = 'view') SELECT event_type, round(avg((value - m) / s), 5) AS z FROM events, r GROUP BY 1",
    "agg34_neighbour_mode": f"WITH c AS (SELECT rr, cc, {_LADDER} AS cls FROM fx_cells), n AS (SELECT c.rr, c.cc, m.cls, count(*) AS n FROM c JOIN c m ON m.rr BETWEEN c.rr-1 AND c.rr+1 AND m.cc BETWEEN c.cc-1 AND c.cc+1 AND NOT (m.rr = c.rr AND m.cc = c.cc) GROUP BY 1, 2, 3) SELECT rr, cc, cls AS mode FROM n QUALIFY row_number() OVER (PARTITION BY rr, cc ORDER BY n DESC, cls) = 1",
    "agg35_scene_share": "SELECT user_id % 20 AS scene, round(avg(CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END), 5) AS bad_share, count(*) AS n FROM events GROUP BY 1",
    "agg37_issue_summary": f"WITH x AS (SELECT job_id, line, {_RULES(1)} AS category, {_RULES(3)} AS severity FROM fx_loglines) SELECT job_id, min(severity) AS worst, arg_min(category, severity) AS category, count(DISTINCT line) AS texts FROM x WHERE category IS NOT NULL GROUP BY 1",
    "jon10_absorbed": "WITH p AS (SELECT a.fid, max((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) AS common FROM fx_rects a JOIN fx_rects b ON a.lvl = -1 AND b.lvl = 0 AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) GROUP BY 1) SELECT a.fid, coalesce(common, 0) >= 0.5 * (x1-x0)*(y1-y0) AS absorbed FROM fx_rects a LEFT JOIN p ON a.fid = p.fid WHERE a.lvl = -1",
    "jon14_points_in_buildings": "SELECT line_id, pos FROM fx_vertices v WHERE cls = '1-URGENT' AND NOT EXISTS (SELECT 1 FROM fx_rects q WHERE q.kind = 'BUILDING' AND v.x >= q.x0 AND v.x < q.x1 AND v.y >= q.y0 AND v.y < q.y1)",
    "jon16_beside_road": f"WITH {_STA.format(where='')}, {_near(8.0, 'dtm')} SELECT o.line_id, count(h.k) >= 0.7 * count(*) AS beside FROM o LEFT JOIN h ON o.line_id = h.line_id AND o.k = h.k GROUP BY 1",
    "jon28_blocked": f"WITH g AS (SELECT r.range AS rr, k.range AS cc FROM range(0, 120) r, range(0, 120) k), m AS (SELECT c.rr, c.cc, q.fid, q.kind FROM g c JOIN fx_rects q ON {_MID}) SELECT DISTINCT fid FROM m WHERE kind = 'FURNITURE' EXCEPT SELECT a.fid FROM m a JOIN m b ON a.kind = 'FURNITURE' AND b.kind = 'MACHINERY' AND a.rr = b.rr AND a.cc = b.cc",
}

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("agg", "jon")) and callable(f)}
