"""Queries over cell sets, components and greedy picks."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import geometry
from geoloom.operators import cellsets as S
from geoloom.operators import graph as G
from geoloom.operators import grid, sequence
from geoloom.sources import tables as T

M = 4.0


def _rect_cells(spark, d, where):
    return S.box_cells(T.rects(spark, d).where(where), M, "fid", "kind", "lvl")


def ras31_rasterise(spark, d):
    return S.box_cells(T.rects(spark, d), M, "fid").groupBy("fid").agg(F.count("*").alias("cells"), F.min("rr").alias("r0"), F.max("cc").alias("c1"))


def ras31_ring_cells(spark, d):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"))
    return S.ring_cells(T.rects(spark, d).withColumn("ring", ring), 3.7, "fid").groupBy("fid").agg(F.count("*").alias("cells"))


def set01_difference(spark, d):
    rest = S.minus(S.union(_rect_cells(spark, d, "lvl = 0")), _rect_cells(spark, d, "lvl <> 0"))
    return rest.select("rr", "cc")


def set02_union(spark, d):
    return S.union(_rect_cells(spark, d, "kind = 'BUILDING'"), _rect_cells(spark, d, "kind = 'MACHINERY'"))


def set02_common(spark, d):
    return S.both(S.union(_rect_cells(spark, d, "kind = 'BUILDING'")), _rect_cells(spark, d, "kind = 'HOUSEHOLD'"))


def set04_provenance(spark, d):
    cells = _rect_cells(spark, d, "true")
    return cells.groupBy("rr", "cc").agg(F.countDistinct("kind").alias("kinds"), F.count("*").alias("areas"))


def set10_level_cut(spark, d):
    return S.highest(_rect_cells(spark, d, "true"), "lvl", "fid").groupBy("fid").agg(F.count("*").alias("cells"))


def set14_ownership(spark, d):
    rank = F.when(F.col("kind") == "BUILDING", 0).when(F.col("kind") == "MACHINERY", 1).otherwise(2)
    return S.owned(_rect_cells(spark, d, "true"), rank, "kind").groupBy("kind").agg(F.count("*").alias("cells"))


def set15_rounded_dedupe(spark, d):
    v = T.vertices(spark, d)
    return v.groupBy((F.floor(F.col("x") / 10) * 10).cast("long").alias("gx"), (F.floor(F.col("y") / 10) * 10).cast("long").alias("gy")).agg(F.count("*").alias("n"), F.min("line_id").alias("first_line"))


def set16_tile_split(spark, d):
    """Areas cut at 64 m tiles; the parts' areas add up to the whole."""
    tiles = T.rects(spark, d).withColumn("tx", F.explode(F.sequence(F.floor(F.col("x0") / 64), F.floor(F.col("x1") / 64)))).withColumn("ty", F.explode(F.sequence(F.floor(F.col("y0") / 64), F.floor(F.col("y1") / 64))))
    w = F.least("x1", (F.col("tx") + 1) * 64) - F.greatest("x0", F.col("tx") * 64)
    h = F.least("y1", (F.col("ty") + 1) * 64) - F.greatest("y0", F.col("ty") * 64)
    return tiles.where((w > 0) & (h > 0)).groupBy("tx", "ty").agg(F.count("*").alias("parts"), F.round(F.sum(w * h), 3).alias("area"))


def set19_perimeter(spark, d):
    return S.perimeter(S.box_cells(T.rects(spark, d), M, "fid"), "fid")


def set22_yielding_rows(spark, d):
    better = S.box_cells(T.rects(spark, d).where("kind = 'BUILDING'"), M).distinct()
    other = _rect_cells(spark, d, "kind = 'AUTOMOBILE'")
    return other.join(better, ["rr", "cc"], "left_anti").groupBy("fid").agg(F.count("*").alias("cells"))


def agg29_dissolve(spark, d):
    """Touching areas of one kind as regions."""
    cells = _rect_cells(spark, d, "kind = 'FURNITURE'").select("rr", "cc").distinct()
    return G.regions(cells, 1000).groupBy("component").agg(F.count("*").alias("cells"))


def agg30_bands(spark, d):
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return T.rects(spark, d).groupBy(F.when(area < 100, "small").when(area < 300, "medium").otherwise("large").alias("band")).agg(F.count("*").alias("n"), F.round(F.sum(area), 3).alias("area"))


def grf02_regions(spark, d):
    """Regions of like canopy class, with their size."""
    c = grid.surfaces(T.points(spark, d), T.CELL_M).withColumn("cls", grid.ladder(F.col("chm"), (8.0, 16.0, 22.0)))
    return G.regions(c, 100, "cls").groupBy("component", "cls").agg(F.count("*").alias("cells"))


def grf01_snapped(spark, d):
    """Both ends of every line: id is line_id * 2, plus one for the last vertex; a line of one vertex has one end."""
    v = T.vertices(spark, d)
    last = v.groupBy("line_id").agg(F.max_by(F.struct("x", "y"), "pos").alias("p"), F.max("pos").alias("n")).where("n > 1")
    first = v.where("pos = 1").select((F.col("line_id") * 2).alias("id"), "x", "y")
    ends = first.unionByName(last.select((F.col("line_id") * 2 + 1).alias("id"), "p.x", "p.y"))
    return G.snapped(ends, 4.0).select("id", "node", "degree", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def grf03_chains(spark, d):
    return G.chained(T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 3001 + 100000).alias("b")))


def grf05_reachable(spark, d):
    ids = T.rects(spark, d).select(F.col("fid").alias("id"))
    links = T.table(spark, d, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 1499 + 1).alias("b"))
    return G.reachable(ids, links, ids.where("id % 500 = 7"))


def _arms(spark, d):
    node = (F.floor(F.col("ax") / 20) * 100 + F.floor(F.col("ay") / 20)).cast("long")
    bearing = F.round(geometry.bearing(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")), 4)
    return sequence.segments(T.vertices(spark, d)).select(node.alias("node"), "line_id", "pos", bearing.alias("bearing"))


def grf08_best_pairs(spark, d):
    """The arms of a node that continue each other best, in one round."""
    arms = _arms(spark, d).select("node", (F.col("line_id") * 1000 + F.col("pos")).alias("arm"), "bearing")
    return G.straightest(arms).select("node", "a", "b", F.round(F.col("turn") + 1e-6, 2).alias("turn"))


def _ends(spark, d):
    """Both ends of every segment as arms, with the bearing away from the node; a segment of no length has none."""
    seg = sequence.segments(T.vertices(spark, d)).withColumn("line", F.col("line_id") * 100000 + F.col("pos"))

    def end(k, x, y, to_x, to_y):
        node = (F.floor(F.col(x) / 20) * 100 + F.floor(F.col(y) / 20)).cast("long")
        bearing = F.when(F.col("len") > 0, F.round(geometry.bearing(F.col(x), F.col(y), F.col(to_x), F.col(to_y)), 4))
        return seg.select(node.alias("node"), (F.col("line") * 2 + k).alias("arm"), "line", bearing.alias("bearing"))

    return end(0, "ax", "ay", "bx", "by").unionByName(end(1, "bx", "by", "ax", "ay"))


def grf08_strokes(spark, d):
    """Strokes of all segments: straightest pairs first, each end once, two-end nodes at any angle."""
    return G.strokes(_ends(spark, d))


def top01_spaced(spark, d):
    p = T.vertices(spark, d).select((F.col("line_id") * 100000 + F.col("pos")).alias("id"), "x", "y", F.col("line_id") % 97)
    return G.spaced(p.toDF("id", "x", "y", "score"), 12.0)


def grf_list_ranks(spark, d):
    v = T.vertices(spark, d)
    from pyspark.sql import Window

    key = F.col("line_id") * 1000 + F.col("pos")
    return G.ranked(v.select(key.alias("id"), F.lead(key).over(Window.partitionBy("line_id").orderBy("pos")).alias("next")))


def snk03_area_bands(spark, d):
    return agg30_bands(spark, d).select("band", "n")


_C = "(r.range + 0.5::DOUBLE) * 4 AS y, (k.range + 0.5::DOUBLE) * 4 AS x, r.range AS rr, k.range AS cc FROM range(0, 120) r, range(0, 120) k"
_CELLS = f"g AS (SELECT {_C}), rc AS (SELECT rr, cc, fid, kind, lvl FROM g JOIN fx_rects q ON g.x >= q.x0 AND g.x < q.x1 AND g.y >= q.y0 AND g.y < q.y1)"


SQL = {
    "ras31_rasterise": f"WITH {_CELLS} SELECT fid, count(*) AS cells, min(rr) AS r0, max(cc) AS c1 FROM rc GROUP BY 1",
    "ras31_ring_cells": "WITH g AS (SELECT (r.range + 0.5::DOUBLE) * 3.7 AS y, (k.range + 0.5::DOUBLE) * 3.7 AS x FROM range(0, 120) r, range(0, 120) k) SELECT fid, count(*) AS cells FROM g JOIN fx_rects q ON g.x >= q.x0 AND g.x < q.x1 AND g.y >= q.y0 AND g.y < q.y1 GROUP BY 1",
    "set01_difference": f"WITH {_CELLS} SELECT DISTINCT rr, cc FROM rc WHERE lvl = 0 EXCEPT SELECT rr, cc FROM rc WHERE lvl <> 0",
    "set02_union": f"WITH {_CELLS} SELECT rr, cc FROM rc WHERE kind = 'BUILDING' UNION SELECT rr, cc FROM rc WHERE kind = 'MACHINERY'",
    "set02_common": f"WITH {_CELLS} SELECT rr, cc FROM rc WHERE kind = 'BUILDING' INTERSECT SELECT rr, cc FROM rc WHERE kind = 'HOUSEHOLD'",
    "set04_provenance": f"WITH {_CELLS} SELECT rr, cc, count(DISTINCT kind) AS kinds, count(*) AS areas FROM rc GROUP BY 1, 2",
    "set10_level_cut": f"WITH {_CELLS}, t AS (SELECT fid, lvl, max(lvl) OVER (PARTITION BY rr, cc) AS top FROM rc) SELECT fid, count(*) AS cells FROM t WHERE lvl = top GROUP BY 1",
    "set14_ownership": f"WITH {_CELLS}, o AS (SELECT rr, cc, kind FROM rc QUALIFY row_number() OVER (PARTITION BY rr, cc ORDER BY CASE kind WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END, kind) = 1) SELECT kind, count(*) AS cells FROM o GROUP BY 1",
    "set15_rounded_dedupe": "SELECT CAST(floor(x/10)*10 AS BIGINT) AS gx, CAST(floor(y/10)*10 AS BIGINT) AS gy, count(*) AS n, min(line_id) AS first_line FROM fx_vertices GROUP BY 1, 2",
    "set16_tile_split": "WITH t AS (SELECT r.range AS tx, k.range AS ty FROM range(0, 8) r, range(0, 8) k) SELECT tx, ty, count(*) AS parts, round(sum((least(x1, (tx+1)*64) - greatest(x0, tx*64)) * (least(y1, (ty+1)*64) - greatest(y0, ty*64))), 3) AS area FROM fx_rects JOIN t ON least(x1, (tx+1)*64) > greatest(x0, tx*64) AND least(y1, (ty+1)*64) > greatest(y0, ty*64) GROUP BY 1, 2",
    "set19_perimeter": f"WITH {_CELLS}, b AS (SELECT fid, max(rr) - min(rr) + 1 AS h, max(cc) - min(cc) + 1 AS w FROM rc GROUP BY 1) SELECT fid, 2 * (h + w) AS perimeter FROM b",
    "set22_yielding_rows": f"WITH {_CELLS}, b AS (SELECT DISTINCT rr, cc FROM rc WHERE kind = 'BUILDING') SELECT fid, count(*) AS cells FROM rc WHERE kind = 'AUTOMOBILE' AND NOT EXISTS (SELECT 1 FROM b WHERE b.rr = rc.rr AND b.cc = rc.cc) GROUP BY 1",
    "agg30_bands": "SELECT CASE WHEN (x1-x0)*(y1-y0) < 100 THEN 'small' WHEN (x1-x0)*(y1-y0) < 300 THEN 'medium' ELSE 'large' END AS band, count(*) AS n, round(sum((x1-x0)*(y1-y0)), 3) AS area FROM fx_rects GROUP BY 1",
    "grf08_best_pairs": """WITH s AS (SELECT line_id, pos, x, y, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM fx_vertices WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
      a AS (SELECT CAST(floor(x/20)*100 + floor(y/20) AS BIGINT) AS node, line_id*1000 + pos AS arm, round((degrees(atan2(bx-x, by_-y)) + 360) % 360, 4) AS bearing FROM s WHERE bx IS NOT NULL),
      p AS (SELECT a.node, a.arm AS a, b.arm AS b, abs(180 - least(abs(a.bearing-b.bearing) % 360, 360 - abs(a.bearing-b.bearing) % 360)) AS turn FROM a JOIN a b ON a.node = b.node AND a.arm < b.arm),
      q AS (SELECT * FROM p WHERE turn <= 45), e AS (SELECT node, a, b, turn, a AS arm FROM q UNION ALL SELECT node, a, b, turn, b FROM q),
      k AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY node, arm ORDER BY turn, a, b) = 1)
      SELECT node, a, b, round(turn + 1e-6, 2) AS turn FROM k GROUP BY node, a, b, k.turn HAVING count(*) = 2""",
    "grf_list_ranks": "SELECT line_id*1000 + pos AS id, count(*) OVER (PARTITION BY line_id ORDER BY pos DESC) - 1 AS rank FROM fx_vertices",
    "agg29_dissolve": f"WITH RECURSIVE {_CELLS}, c AS (SELECT DISTINCT rr, cc, rr*1000 + cc AS id FROM rc WHERE kind = 'FURNITURE'), l AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON (a.rr = b.rr AND abs(a.cc - b.cc) = 1) OR (a.cc = b.cc AND abs(a.rr - b.rr) = 1)), f(root, id) AS (SELECT id, id FROM c UNION SELECT f.root, l.b FROM f JOIN l ON f.id = l.a AND l.b > f.root), m AS (SELECT id, min(root) AS component FROM f GROUP BY 1) SELECT component, count(*) AS cells FROM m GROUP BY 1",
    "grf02_regions": """WITH RECURSIVE c AS (SELECT rr, cc, rr*100 + cc AS id, CASE WHEN chm < 8 THEN 1 WHEN chm < 16 THEN 2 WHEN chm < 22 THEN 3 ELSE 0 END AS cls FROM fx_cells),
      l AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.cls = b.cls AND (b.rr = a.rr AND abs(b.cc - a.cc) = 1 OR b.cc = a.cc AND abs(b.rr - a.rr) = 1)),
      f(root, id) AS (SELECT id, id FROM c UNION SELECT f.root, l.b FROM f JOIN l ON f.id = l.a AND l.b > f.root), m AS (SELECT id, min(root) AS component FROM f GROUP BY 1)
      SELECT component, cls, count(*) AS cells FROM m JOIN c ON c.id = m.id GROUP BY 1, 2""",
    "grf01_snapped": "WITH RECURSIVE v AS (SELECT line_id * 2 AS id, x, y FROM fx_vertices WHERE pos = 1 UNION ALL SELECT line_id * 2 + 1, x, y FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY pos DESC) AS r FROM fx_vertices) z WHERE r = 1 AND pos > 1), l AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 16), f(root, id) AS (SELECT id, id FROM v UNION SELECT f.root, l.b FROM f JOIN l ON f.id = l.a), m AS (SELECT id, min(root) AS node FROM f GROUP BY 1) SELECT m.id, node, count(*) OVER (PARTITION BY node) AS degree, round(avg(x) OVER (PARTITION BY node), 4) AS x, round(avg(y) OVER (PARTITION BY node), 4) AS y FROM m JOIN v ON m.id = v.id",
    "grf03_chains": "WITH RECURSIVE o AS (SELECT o_orderkey AS id, o_custkey AS a, o_orderkey % 3001 + 100000 AS b FROM orders), e AS (SELECT id, a AS node FROM o UNION ALL SELECT id, b FROM o), t AS (SELECT min(id) AS a, max(id) AS b FROM e GROUP BY node HAVING count(*) = 2 AND min(id) <> max(id)), l AS (SELECT a, b FROM t UNION SELECT b, a FROM t), f(root, id) AS (SELECT id, id FROM o UNION SELECT f.root, l.b FROM f JOIN l ON f.id = l.a AND l.b > f.root) SELECT id, min(root) AS chain FROM f GROUP BY 1",
    "snk03_area_bands": "SELECT CASE WHEN (x1-x0)*(y1-y0) < 100 THEN 'small' WHEN (x1-x0)*(y1-y0) < 300 THEN 'medium' ELSE 'large' END AS band, count(*) AS n FROM fx_rects GROUP BY 1",
    "grf05_reachable": "WITH RECURSIVE l AS (SELECT o_custkey AS a, o_orderkey % 1499 + 1 AS b FROM orders), u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r(id) AS (SELECT c_custkey FROM customer WHERE c_custkey % 500 = 7 UNION SELECT u.b FROM r JOIN u ON r.id = u.a) SELECT DISTINCT r.id FROM r JOIN customer ON c_custkey = r.id",
}

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("ras", "set", "agg", "grf", "top", "snk")) and callable(f) and n not in ("geometry",)}
