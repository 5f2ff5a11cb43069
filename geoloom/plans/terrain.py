"""Queries of terrain and vegetation detectors, and whole chains."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from geoloom.operators import cellsets, classify, focal, grid, sequence
from geoloom.operators import spatial_join as J
from geoloom.operators import terrain as R
from geoloom.sources import tables as T


def _cells(spark, d):
    return grid.surfaces(T.points(spark, d), T.CELL_M)


def _coarse(spark, d):
    """20 m cells with mean ground height, dense in every scale."""
    return grid.with_cell(T.points(spark, d), 20.0).groupBy("rr", "cc").agg(F.avg("z").alias("v"))


def ras27_knolls(spark, d):
    p = R.prominences(_cells(spark, d).withColumn("v", F.col("dem")), 2)
    return p.where("rise >= 1.5").select("rr", "cc", F.round("rise", 4).alias("rise"), F.round("clear", 4).alias("clear"))


def ras27_depressions(spark, d):
    p = R.prominences(_coarse(spark, d), 1)
    return p.where("sunk > 0").select("rr", "cc", F.round("sunk", 4).alias("sunk"))


def ras32_contours(spark, d):
    seg = R.contour_segments(_coarse(spark, d), 0.5)
    return seg.groupBy("level", "index").agg(F.count("*").alias("segments"), F.round(F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), 3).alias("length"))


def ras43_shadow(spark, d):
    """Where tall cells' shadows fall: 36 directions, 1 to 12 cells."""
    c = _cells(spark, d)
    return R.shadow_direction(c.where("dsm >= 524"), c.where("dem >= 503")).select("direction", F.round("share", 5).alias("share"), F.round("median", 5).alias("median"), "clear")


def ras44_colours(spark, d):
    """Colour classes of pixels, red, green and blue from the first three features of an image table."""
    v = lambda k: F.round(1 / (1 + F.exp(-F.col("embedding")[k].cast("double") * 12)), 6)
    return T.table(spark, d, "embeddings").groupBy(R.colour_class(v(0), v(1), v(2)).alias("colour")).agg(F.count("*").alias("n"))


def ras21_settlement(spark, d):
    """Buildings grown by 20 m and shrunk by 12 m with disks; zones of less than 3,000 m2 go."""
    cells = cellsets.box_cells(T.rects(spark, d).where("kind = 'BUILDING'"), 4.0)
    return R.settlement_zones(cells, 110, 110, 4.0).select("rr", "cc")


def ras46_veto(spark, d):
    tall = _cells(spark, d).where("chm >= 15").select("rr", "cc")
    roads = cellsets.box_cells(T.rects(spark, d).where("lvl = 0"), 4.0)
    return cellsets.minus(tall, roads).select("rr", "cc")


def ras22_merged_regions(spark, d):
    c = _cells(spark, d).withColumn("cls", grid.ladder(F.col("chm"), (8.0, 20.0)))
    return R.small_regions_merged(c, 100, "cls", 3).groupBy("cls").agg(F.count("*").alias("cells"))


def agg32_green_threshold(spark, d):
    px = T.table(spark, d, "events").select(F.when(F.col("event_type") == "view", "road").when(F.col("event_type") == "click", "grass").otherwise("other").alias("cls"), (F.col("value") / 1000).alias("exg"))
    return R.green_threshold(px, "cls", "exg").select(F.round(F.col("road") + 1e-9, 5).alias("road"), F.round(F.col("grass") + 1e-9, 5).alias("grass"), "roads", "grasses", F.round("threshold", 6).alias("threshold"))


def pip08_drawn_lines(spark, d):
    """Lines of all sources: classed, measured, those covered by a better source dropped, lengths by class and source."""
    seg = sequence.segments(T.vertices(spark, d))
    own = sequence.stations(seg.where("source <> 'dtm'"), 50.0)
    better = seg.where("source = 'dtm' and len > 0").select("ax", "ay", "bx", "by")
    hits = J.beside_segments(own, better, 4.0).groupBy("line_id").agg(F.count("*").alias("hits"))
    share = own.groupBy("line_id").agg(F.count("*").alias("stations")).join(hits, "line_id", "left").where(F.coalesce("hits", F.lit(0)) >= 0.95 * F.col("stations")).select("line_id")
    left = seg.join(share, "line_id", "left_anti")
    return left.groupBy("source", "cls").agg(F.countDistinct("line_id").alias("lines"), F.round(F.sum("len") / 1000, 2).alias("km"))


def pip03_vegetation(spark, d):
    """Points to canopy classes, small regions merged, shares of each class."""
    h = grid.canopy_height(F.col("dsm"), F.col("dem"))
    c = _cells(spark, d).withColumn("cls", grid.ladder(h, (4.0, 12.0, 20.0)))
    return grid.shares(R.small_regions_merged(c, 100, "cls", 3), "cls").withColumn("share", F.round("share", 6))


def pip09_objects(spark, d):
    """Elements through skip reasons, refinement and codes: what is drawn and what isn't."""
    e = T.elements(spark, d).select(classify.skip_reason().alias("reason"), classify.refined_highway().alias("draw"))
    return e.groupBy(F.when(F.col("reason").isNull(), "drawn").otherwise(F.col("reason")).alias("status"), "draw").agg(F.count("*").alias("n"))


_COARSE = "k AS (SELECT CAST(floor(y/20) AS BIGINT) AS rr, CAST(floor(x/20) AS BIGINT) AS cc, avg(z) AS v FROM fx_points GROUP BY 1, 2)"


def _ring(src: str, radius: float) -> str:
    offs = R.ring_offsets(radius)
    on = " OR ".join(f"(n.rr = c.rr + {dy} AND n.cc = c.cc + {dx})".replace("+ -", "- ") for dy, dx in offs)
    near = f"n.rr BETWEEN c.rr - {int(radius)} AND c.rr + {int(radius)} AND n.cc BETWEEN c.cc - {int(radius)} AND c.cc + {int(radius)}"
    return f"p AS (SELECT c.rr, c.cc, c.v - avg(n.v) AS rise, c.v - max(n.v) AS clear, min(n.v) - c.v AS sunk FROM {src} c JOIN {src} n ON {near} AND ({on}) GROUP BY c.rr, c.cc, c.v HAVING count(*) = {len(offs)})"


_TRI = """s AS (SELECT a.rr, a.cc, a.v AS a, b.v AS b, c.v AS c, d.v AS d FROM k a JOIN k b ON b.rr = a.rr AND b.cc = a.cc + 1 JOIN k c ON c.rr = a.rr + 1 AND c.cc = a.cc JOIN k d ON d.rr = a.rr + 1 AND d.cc = a.cc + 1),
    t AS (SELECT a AS pv, rr AS py, cc AS px, b AS qv, rr AS qy, cc + 1 AS qx, c AS rv, rr + 1 AS ry, cc AS rx FROM s UNION ALL SELECT b, rr, cc + 1, d, rr + 1, cc + 1, c, rr + 1, cc FROM s),
    l AS (SELECT *, unnest(range(CAST(floor(least(pv, qv, rv)/0.5) AS BIGINT) + 1, CAST(ceil(greatest(pv, qv, rv)/0.5) AS BIGINT))) AS n FROM t),
    x AS (SELECT n, n*0.5::DOUBLE AS z, * EXCLUDE (n) FROM l),
    e AS (SELECT z, n % 5 = 0 AS index, CASE WHEN (pv >= z) <> (qv >= z) THEN [px + (z-pv)/(qv-pv)*(qx-px), py + (z-pv)/(qv-pv)*(qy-py)] END AS e1, CASE WHEN (qv >= z) <> (rv >= z) THEN [qx + (z-qv)/(rv-qv)*(rx-qx), qy + (z-qv)/(rv-qv)*(ry-qy)] END AS e2, CASE WHEN (rv >= z) <> (pv >= z) THEN [rx + (z-rv)/(pv-rv)*(px-rx), ry + (z-rv)/(pv-rv)*(py-ry)] END AS e3 FROM x),
    g AS (SELECT z AS level, index, list_filter([e1, e2, e3], lambda i: i IS NOT NULL) AS e FROM e)"""

_RGB = ", ".join(f"round(1/(1+exp(-CAST(embedding[{k}] AS DOUBLE)*12)), 6) AS {c}" for k, c in ((1, "r"), (2, "g"), (3, "b")))
_MOVES = sorted({(d, k, round(-k * math.cos(math.radians(d))), round(k * math.sin(math.radians(d)))) for d in range(0, 360, 10) for k in range(1, 13)})

SQL = {
    "ras43_shadow": f"""WITH m AS (SELECT * FROM (VALUES {', '.join(map(str, _MOVES))}) v(direction, k, dy, dx)),
      s AS (SELECT direction, k, count(b.rr) / count(*) AS share FROM fx_cells a CROSS JOIN m LEFT JOIN (SELECT rr, cc FROM fx_cells WHERE dem >= 503) b ON b.rr = a.rr + dy AND b.cc = a.cc + dx WHERE a.dsm >= 524 GROUP BY 1, 2 HAVING count(*) >= 10),
      t AS (SELECT direction, max(share) AS share FROM s GROUP BY 1), e AS (SELECT arg_max(direction, (share, -direction)) AS direction, max(share) AS share, quantile_cont(share, 0.5) AS median FROM t)
      SELECT CAST(direction AS INTEGER) AS direction, round(share, 5) AS share, round(median, 5) AS median, share >= median + 0.12 AS clear FROM e""",
    "ras44_colours": f"""WITH p AS (SELECT {_RGB} FROM embeddings), q AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM p),
      h AS (SELECT v, CASE WHEN v = 0 THEN 0 ELSE d / v END AS s, CASE WHEN d = 0 THEN 0 WHEN v = r THEN 60 * (((g - b) / d) - 6 * floor((g - b) / d / 6)) WHEN v = g THEN 60 * ((b - r) / d + 2) ELSE 60 * ((r - g) / d + 4) END AS h FROM q)
      SELECT CASE WHEN v < 0.25 THEN 'black' WHEN s < 0.12 AND v > 0.85 THEN 'white' WHEN s < 0.15 THEN 'grey' WHEN h >= 40 AND h < 70 THEN 'yellow' WHEN h >= 70 AND h < 170 THEN 'green' WHEN h >= 170 AND h < 260 THEN 'blue' WHEN h >= 15 AND h < 40 THEN 'brown' ELSE 'other' END AS colour, count(*) AS n FROM h GROUP BY 1""",
    "ras27_knolls": f"WITH q AS (SELECT rr, cc, dem AS v FROM fx_cells), {_ring('q', 2)} SELECT rr, cc, round(rise, 4) AS rise, round(clear, 4) AS clear FROM p WHERE rise >= 1.5",
    "ras27_depressions": f"WITH {_COARSE}, {_ring('k', 1)} SELECT rr, cc, round(sunk, 4) AS sunk FROM p WHERE sunk > 0",
    "ras32_contours": f"WITH {_COARSE}, {_TRI} SELECT level, index, count(*) AS segments, round(sum(sqrt(power(e[1][1]-e[2][1], 2) + power(e[1][2]-e[2][2], 2))), 3) AS length FROM g WHERE len(e) = 2 GROUP BY 1, 2",
    "ras46_veto": "SELECT rr, cc FROM fx_cells c WHERE chm >= 15 AND NOT EXISTS (SELECT 1 FROM fx_rects q WHERE q.lvl = 0 AND (c.cc+0.5::DOUBLE)*4 >= q.x0 AND (c.cc+0.5::DOUBLE)*4 < q.x1 AND (c.rr+0.5::DOUBLE)*4 >= q.y0 AND (c.rr+0.5::DOUBLE)*4 < q.y1)",
    "agg32_green_threshold": "WITH p AS (SELECT CASE event_type WHEN 'view' THEN 'road' WHEN 'click' THEN 'grass' ELSE 'other' END AS cls, value/1000 AS exg FROM events), a AS (SELECT quantile_cont(exg, 0.95) FILTER (WHERE cls = 'road') AS road, quantile_cont(exg, 0.25) FILTER (WHERE cls = 'grass') AS grass, sum(CASE WHEN cls = 'road' THEN 1 ELSE 0 END) AS roads, sum(CASE WHEN cls = 'grass' THEN 1 ELSE 0 END) AS grasses FROM p) SELECT round(road + 1e-9, 5) AS road, round(grass + 1e-9, 5) AS grass, roads, grasses, round(CASE WHEN roads >= 400 AND grasses >= 400 AND road < grass THEN greatest(0.02, least(0.12, (road+grass)/2)) ELSE 0.05 END, 6) AS threshold FROM a",
}

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("ras", "agg", "pip")) and callable(f)}
