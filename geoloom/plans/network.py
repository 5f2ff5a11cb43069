"""Queries over line networks: graph, connectivity, junctions, free ends; points thinned and joined by rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.operators import graph as G
from geoloom.operators import grid, picks, sequence
from geoloom.operators import spatial_join as J
from geoloom.plans.spatial import _SEG
from geoloom.sources import tables as T

SNAP = 1.0


def _marked(spark, d):
    """Vertices with the node they snap to, and whether it is a node: a line's end, or shared."""
    v = T.vertices(spark, d).withColumn("node", (F.floor(F.col("y") / SNAP) * 1000 + F.floor(F.col("x") / SNAP)).cast("long"))
    line = Window.partitionBy("line_id")
    ends = v.withColumn("end", (F.col("pos") == F.min("pos").over(line)) | (F.col("pos") == F.max("pos").over(line)))
    shared = v.groupBy("node").agg(F.count("*").alias("uses"))
    return ends.join(shared, "node").withColumn("is_node", F.col("end") | (F.col("uses") >= 2))


def _edges(spark, d):
    """(line_id, edge, u, v, length): lines split at their nodes."""
    w = Window.partitionBy("line_id").orderBy("pos")
    m = _marked(spark, d).withColumn("bx", F.lead("x").over(w)).withColumn("by", F.lead("y").over(w)).withColumn("edge", F.sum(F.col("is_node").cast("int")).over(w))
    nodes = m.where("is_node").select("line_id", "edge", F.col("node").alias("u"), F.lead("node").over(w).alias("v"))
    length = m.where("bx is not null").groupBy("line_id", "edge").agg(F.sum(F.hypot(F.col("bx") - F.col("x"), F.col("by") - F.col("y"))).alias("length"))
    return nodes.where("v is not null").join(length, ["line_id", "edge"]).where("length > 0")


def grf06_road_graph(spark, d):
    return _edges(spark, d).select("line_id", "edge", "u", "v", F.round("length", 3).alias("length"))


def _arms(spark, d):
    """An arm for both ends of every edge, drawn unless its line is of a low class."""
    low = T.elements(spark, d).where("highway in ('path', 'steps')").select(F.col("eid").alias("line_id")).withColumn("low", F.lit(True))
    e = _edges(spark, d).join(low, "line_id", "left")
    return e.select("line_id", "edge", F.col("low").isNull().alias("drawn"), F.explode(F.array("u", "v")).alias("node"))


def grf07_arms(spark, d):
    """Arms of nodes with three and more: drawn ones are connected if another one is drawn, else they end on an area, at a hole, or alone (only one arm besides)."""
    a = _arms(spark, d)
    node = a.groupBy("node").agg(F.count("*").alias("degree"), F.sum(F.col("drawn").cast("long")).alias("drawn_arms"))
    at = node.where("degree >= 3").select("node", "degree", "drawn_arms", (F.col("node") % 1000 + 0.5).alias("x"), (F.floor(F.col("node") / 1000) + 0.5).alias("y"))
    on_area = J.points_in_boxes(at, T.rects(spark, d).where("lvl = 1").select("x0", "y0", "x1", "y1")).select("node").distinct().withColumn("area", F.lit(True))
    status = F.when(~F.col("drawn"), "not drawn").when(F.col("drawn_arms") >= 2, "connected").when(F.col("area"), "on area").when(F.col("degree") == 3, "lonely").otherwise("hole")
    return a.join(at.join(on_area, "node", "left"), "node").select("node", "line_id", "edge", "degree", status.alias("status"))


def agg38_connectivity(spark, d):
    """Totals of the arms' report."""
    s = grf07_arms(spark, d)
    n = lambda what: F.sum((F.col("status") == what).cast("long"))
    return s.agg(F.countDistinct("node").alias("nodes"), F.count("*").alias("arms"), F.sum((F.col("status") != "not drawn").cast("long")).alias("drawn"), n("connected").alias("connected"), n("on area").alias("on_area"), n("hole").alias("holes"), n("lonely").alias("lonely"))


def grf10_junction_clusters(spark, d):
    """Nodes of degree 3 and more within 8 m of each other, directly or in a row, with the complexity of each cluster."""
    v = T.vertices(spark, d).withColumn("node", (F.floor(F.col("y") / SNAP) * 1000 + F.floor(F.col("x") / SNAP)).cast("long"))
    line = Window.partitionBy("line_id")
    use = F.when((F.col("pos") == F.min("pos").over(line)) | (F.col("pos") == F.max("pos").over(line)), 1).otherwise(2)
    node = v.withColumn("use", use).groupBy(F.col("node").alias("id")).agg(F.sum("use").alias("degree"), F.avg("x").alias("x"), F.avg("y").alias("y")).where("degree >= 3")
    pairs = J.within(node.select("id", "x", "y"), node.select(F.col("id").alias("other"), F.col("x").alias("rx"), F.col("y").alias("ry")), 8.0).where("id < other")
    label = G.labelled(node, pairs.select(F.col("id").alias("a"), F.col("other").alias("b")))
    return label.join(node, "id").groupBy("component").agg(F.count("*").alias("nodes"), F.sum("degree").alias("arms"), (F.sum("degree") >= 8).alias("complex"))


def grf13_gap_candidates(spark, d):
    """Free ends of fences that face each other over a gap of 6 m at most (35 degrees), best for both ends."""
    seg = sequence.segments(T.vertices(spark, d)).where("len > 0")
    w = Window.partitionBy("line_id")
    k = seg.withColumn("first", F.col("pos") == F.min("pos").over(w)).withColumn("last", F.col("pos") == F.max("pos").over(w))
    end = lambda n, x, y, s: F.struct(F.lit(n).alias("e"), F.col(x).alias("x"), F.col(y).alias("y"), (s * (F.col("bx") - F.col("ax")) / F.col("len")).alias("ux"), (s * (F.col("by") - F.col("ay")) / F.col("len")).alias("uy"))
    ends = k.select("line_id", "source", F.explode(F.array(F.when(F.col("first"), end(0, "ax", "ay", -1)), F.when(F.col("last"), end(1, "bx", "by", 1)))).alias("p")).where("p is not null").select((F.col("line_id") * 2 + F.col("p.e")).alias("id"), "line_id", "source", "p.x", "p.y", "p.ux", "p.uy")
    other = ends.toDF("b", "b_line", "b_source", "rx", "ry", "vx", "vy")
    gap = F.sqrt("d2")
    dx, dy = (F.col("rx") - F.col("x")) / gap, (F.col("ry") - F.col("y")) / gap
    facing = (F.col("ux") * dx + F.col("uy") * dy >= 0.8191520) & (F.col("vx") * dx + F.col("vy") * dy <= -0.8191520)
    pairs = J.within(ends, other, 6.0).where("id < b and line_id <> b_line and source = b_source and d2 > 0.25").where(facing).select(F.col("id").alias("a"), "b", F.round(gap, 4).alias("gap"))
    best = pairs.select("a", "b", "gap", F.explode(F.array("a", "b")).alias("end")).withColumn("r", F.row_number().over(Window.partitionBy("end").orderBy("gap", "a", "b"))).where("r = 1")
    return best.groupBy("a", "b", "gap").agg(F.count("*").alias("n")).where("n = 2").select("a", "b", "gap")


def grf18_service_links(spark, d):
    """Dead ends of service roads that reach a parking area (within 2 m)."""
    m = _marked(spark, d)
    e = T.elements(spark, d).where("highway = 'service'").select(F.col("eid").alias("line_id"))
    free = m.where("end and uses = 1").join(e, "line_id", "left_semi").select("line_id", "pos", "x", "y")
    lot = T.rects(spark, d).where("kind = 'MACHINERY'").select("fid", *((F.col(c) + k).alias(c) for c, k in (("x0", -2.0), ("y0", -2.0), ("x1", 2.0), ("y1", 2.0))))
    return J.points_in_boxes(free, lot).groupBy("line_id").agg(F.min("fid").alias("parking"), F.countDistinct("fid").alias("areas"))


def jon36_gardens(spark, d):
    """Gardens with the buildings that touch them (half a metre): private where a building has 150 m2 of them at most."""
    r = T.rects(spark, d)
    g = r.where("kind = 'HOUSEHOLD'").select("fid", "x0", "y0", "x1", "y1")
    b = r.where("kind = 'BUILDING'").select("fid", *((F.col(c) + k).alias(c) for c, k in (("x0", -0.5), ("y0", -0.5), ("x1", 0.5), ("y1", 0.5))))
    n = J.shape_overlaps(g, b).groupBy(*J.BOX).agg(F.sum("n").alias("buildings"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return g.join(n, list(J.BOX), "left").select("fid", F.coalesce("buildings", F.lit(0)).alias("buildings"), F.coalesce(area / F.col("buildings") <= 150, F.lit(False)).alias("private"))


def jon37_private_playgrounds(spark, d):
    """Playgrounds are private with 80 % in one garden, or with a pool within 10 m."""
    r = T.rects(spark, d)
    box = lambda k: r.where(f"kind = '{k}'").select("fid", "x0", "y0", "x1", "y1")
    p, garden = box("MACHINERY"), box("HOUSEHOLD")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    share = J.shape_overlaps(p, garden).groupBy(*J.BOX).agg(F.max("common").alias("common"))
    grown = p.select(*((F.col(c) + k).alias(c) for c, k in (("x0", -10.0), ("y0", -10.0), ("x1", 10.0), ("y1", 10.0))))
    gap = lambda a0, a1, b0, b1: F.greatest(F.col(b0) - (F.col(a1) - 10), F.col(a0) + 10 - F.col(b1), F.lit(0.0))
    dx, dy = gap("x0", "x1", "b_x0", "b_x1"), gap("y0", "y1", "b_y0", "b_y1")
    near = J.shape_overlaps(grown, box("AUTOMOBILE").where("fid is not null")).where(dx * dx + dy * dy <= 100).select(*J.BOX).distinct()
    pool = near.select(*(F.col(c).alias(f"g_{c}") for c in J.BOX), F.lit(True).alias("pool"))
    at = (F.col("x0") - 10.0 == F.col("g_x0")) & (F.col("y0") - 10.0 == F.col("g_y0")) & (F.col("x1") + 10.0 == F.col("g_x1")) & (F.col("y1") + 10.0 == F.col("g_y1"))
    return p.join(share, list(J.BOX), "left").join(pool, at, "left").select("fid", F.coalesce(F.col("common") >= 0.8 * area, F.lit(False)).alias("in_garden"), F.col("pool").isNotNull().alias("at_pool"))


def playground_inputs(spark, d):
    """Grounds, mapped points (of one source's vertices) and detected ones (of another's) with a score."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    grounds = T.rects(spark, d).where("kind = 'MACHINERY'").select(F.col("fid").alias("zone"), area.alias("area"), "x0", "y0", "x1", "y1")
    v = T.vertices(spark, d).withColumn("id", F.col("line_id") * 100000 + F.col("pos"))
    mapped = v.where("source = 'osm'").select("id", "x", "y", (F.col("cls") == "1-URGENT").alias("tall"), (F.col("cls") == "5-LOW").alias("flat"))
    return grounds, mapped, v.where("source = 'dtm'").select("id", "x", "y", (F.col("pos") % 7).alias("score"))


def top06_playground_objects(spark, d):
    """Objects drawn on every ground at 1:1,000: mapped before detected, with a distance and a quota."""
    return picks.playground_objects(*playground_inputs(spark, d), 1000)


def jon38_points_of_both(spark, d):
    """Mapped points, and detected ones that are more than 4 m from each of them."""
    v = T.vertices(spark, d)
    mapped, found = v.where("source = 'osm' and pos = 1").select("line_id", "pos", "x", "y"), v.where("source = 'topo'").select("line_id", "pos", "x", "y")
    near = J.within(found, mapped.select(F.col("x").alias("rx"), F.col("y").alias("ry")), 4.0).select("line_id", "pos").distinct()
    return mapped.withColumn("origin", F.lit("mapped")).unionByName(found.join(near, ["line_id", "pos"], "left_anti").withColumn("origin", F.lit("detected")))


def jon25_closed_depressions(spark, d):
    """Areas whose edge lies higher than their middle by the terrain's samples: corners and sides against the centre."""
    dem = grid.surfaces(T.points(spark, d), T.CELL_M).select("rr", "cc", "dem")
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    p = lambda x, y, e: F.struct(x.alias("x"), y.alias("y"), F.lit(e).alias("edge"))
    c = F.col
    at = F.array(p(mx, my, False), p(c("x0"), c("y0"), True), p(c("x1"), c("y0"), True), p(c("x1"), c("y1"), True), p(c("x0"), c("y1"), True), p(mx, c("y0"), True), p(mx, c("y1"), True), p(c("x0"), my, True), p(c("x1"), my, True))
    s = grid.with_cell(T.rects(spark, d).select("fid", F.explode(at).alias("p")).select("fid", "p.*"), 4.0).join(dem, ["rr", "cc"])
    both = s.groupBy("fid").agg(F.avg(F.when(F.col("edge"), F.col("dem"))).alias("rim"), F.avg(F.when(~F.col("edge"), F.col("dem"))).alias("middle"))
    return both.where("rim is not null and middle is not null").select("fid", F.round(F.col("rim") - F.col("middle"), 5).alias("depth"), (F.col("rim") - F.col("middle") >= 0.5).alias("closed"))


def top02_thinned_points(spark, d):
    """Points of one class 6 m apart at least, by priority, after those inside buildings are gone."""
    v = T.vertices(spark, d).select((F.col("line_id") * 100000 + F.col("pos")).alias("id"), "x", "y", "cls", (-F.col("pos")).alias("score"))
    inside = J.points_in_boxes(v, J.shapes(T.rects(spark, d).where("kind = 'BUILDING'")).drop("n")).select("id").distinct()
    free = v.join(inside, "id", "left_anti")
    # classes lie apart, so that one greedy pass thins each by itself
    kept = G.spaced(free.withColumn("x", F.col("x") + F.substring("cls", 1, 1).cast("double") * 1e6).select("id", "x", "y", "score"), 6.0)
    return free.join(kept, "id", "left_semi").select("id", "cls")


def top03_trees_beside_kept(spark, d):
    """Trees at least 7 m from the trees already kept and, by priority, from each other."""
    v = T.vertices(spark, d)
    old = v.where("source = 'dtm' and pos = 1").select(F.col("x").alias("rx"), F.col("y").alias("ry"))
    new = v.where("source = 'osm'").select((F.col("line_id") * 100000 + F.col("pos")).alias("id"), "x", "y", (-F.col("pos")).alias("score"))
    near = J.within(new, old, 7.0).select("id").distinct()
    return G.spaced(new.join(near, "id", "left_anti"), 7.0).select("id")


def jon06_priority_lines(spark, d):
    """Lines that stay when taken best first (source, then width, then length) and one kept line covers 8 % of a line at most."""
    from geoloom.operators import lines

    seg = sequence.segments(T.vertices(spark, d)).where("len > 0")
    total = seg.groupBy("line_id", "source").agg(F.round(F.sum("len"), 3).alias("length"))
    rank = F.struct(F.when(F.col("source") == "dtm", 0).when(F.col("source") == "osm", 1).otherwise(2).alias("s"), (-F.col("length")).alias("l"), F.col("line_id").alias("id"))
    return lines.taken_lines(seg, total.select("line_id", rank.alias("o")), 25.0, 2.0, 0.08, 0.5).select(F.col("line_id").alias("id"))


_LINE_ENDS = "(pos = min(pos) OVER (PARTITION BY line_id) OR pos = max(pos) OVER (PARTITION BY line_id))"
_MARKED = f"nv AS (SELECT line_id, pos, x, y, CAST(floor(y)*1000 + floor(x) AS BIGINT) AS node, {_LINE_ENDS} AS e FROM fx_vertices), mk AS (SELECT *, count(*) OVER (PARTITION BY node) AS uses FROM nv), mv AS (SELECT *, e OR uses >= 2 AS isn FROM mk)"
_EDGES = _MARKED + """, ml AS (SELECT *, lead(x) OVER w AS bx, lead(y) OVER w AS by_, CAST(sum(CASE WHEN isn THEN 1 ELSE 0 END) OVER (PARTITION BY line_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS edge FROM mv WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
    en AS (SELECT line_id, edge, node AS u, lead(node) OVER (PARTITION BY line_id ORDER BY pos) AS v FROM ml WHERE isn), el AS (SELECT line_id, edge, sum(sqrt((bx-x)*(bx-x)+(by_-y)*(by_-y))) AS length FROM ml WHERE bx IS NOT NULL GROUP BY 1, 2),
    ed AS (SELECT en.line_id, en.edge, u, v, length FROM en JOIN el ON el.line_id = en.line_id AND el.edge = en.edge WHERE v IS NOT NULL AND length > 0)"""
_ARMS = _EDGES + """, ar AS (SELECT ed.line_id, edge, x.highway IS NULL OR x.highway NOT IN ('path', 'steps') AS drawn, unnest([u, v]) AS node FROM ed LEFT JOIN fx_elements x ON x.eid = ed.line_id),
    nd AS (SELECT node, count(*) AS degree, sum(CASE WHEN drawn THEN 1 ELSE 0 END) AS da, EXISTS (SELECT 1 FROM fx_rects r WHERE lvl = 1 AND node % 1000 + 0.5 >= x0 AND node % 1000 + 0.5 < x1 AND node // 1000 + 0.5 >= y0 AND node // 1000 + 0.5 < y1) AS area FROM ar GROUP BY 1 HAVING count(*) >= 3),
    sa AS (SELECT ar.node, ar.line_id, ar.edge, degree, CASE WHEN NOT drawn THEN 'not drawn' WHEN da >= 2 THEN 'connected' WHEN area THEN 'on area' WHEN degree = 3 THEN 'lonely' ELSE 'hole' END AS status FROM ar JOIN nd ON nd.node = ar.node)"""

SQL = {
    "grf06_road_graph": f"WITH {_EDGES} SELECT line_id, edge, u, v, round(length, 3) AS length FROM ed",
    "grf07_arms": f"WITH {_ARMS} SELECT node, line_id, edge, degree, status FROM sa",
    "agg38_connectivity": f"WITH {_ARMS} SELECT count(DISTINCT node) AS nodes, count(*) AS arms, count(*) FILTER (WHERE status <> 'not drawn') AS drawn, count(*) FILTER (WHERE status = 'connected') AS connected, count(*) FILTER (WHERE status = 'on area') AS on_area, count(*) FILTER (WHERE status = 'hole') AS holes, count(*) FILTER (WHERE status = 'lonely') AS lonely FROM sa",
    "grf10_junction_clusters": f"WITH RECURSIVE nv AS (SELECT CAST(floor(y)*1000 + floor(x) AS BIGINT) AS id, x, y, CASE WHEN {_LINE_ENDS} THEN 1 ELSE 2 END AS use FROM fx_vertices), nd AS (SELECT id, sum(use) AS degree, avg(x) AS x, avg(y) AS y FROM nv GROUP BY 1 HAVING sum(use) >= 3), l AS (SELECT a.id AS a, b.id AS b FROM nd a JOIN nd b ON a.id <> b.id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 64), f(root, id) AS (SELECT id, id FROM nd UNION SELECT f.root, l.b FROM f JOIN l ON f.id = l.a AND l.b > f.root), m AS (SELECT id, min(root) AS component FROM f GROUP BY 1) SELECT component, count(*) AS nodes, CAST(sum(degree) AS BIGINT) AS arms, sum(degree) >= 8 AS complex FROM m JOIN nd ON nd.id = m.id GROUP BY 1",
    "grf13_gap_candidates": f"""WITH {_SEG}, k AS (SELECT *, pos = min(pos) OVER (PARTITION BY line_id) AS fi, pos = max(pos) OVER (PARTITION BY line_id) AS la FROM seg WHERE len > 0),
      e AS (SELECT line_id*2 AS id, line_id, source, ax AS x, ay AS y, -(bx-ax)/len AS ux, -(by_-ay)/len AS uy FROM k WHERE fi UNION ALL SELECT line_id*2 + 1, line_id, source, bx, by_, (bx-ax)/len, (by_-ay)/len FROM k WHERE la),
      p AS (SELECT a.id AS a, b.id AS b, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS g, a.ux, a.uy, b.ux AS vx, b.uy AS vy, b.x-a.x AS dx, b.y-a.y AS dy FROM e a JOIN e b ON a.id < b.id AND a.line_id <> b.line_id AND a.source = b.source AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 36 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) > 0.25),
      q AS (SELECT a, b, round(g, 4) AS gap FROM p WHERE (ux*dx + uy*dy)/g >= 0.8191520 AND (vx*dx + vy*dy)/g <= -0.8191520), z AS (SELECT a, b, gap, a AS e FROM q UNION ALL SELECT a, b, gap, b FROM q), t AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY e ORDER BY gap, a, b) = 1) SELECT a, b, gap FROM t GROUP BY 1, 2, 3 HAVING count(*) = 2""",
    "grf18_service_links": f"WITH {_MARKED} SELECT m.line_id, min(fid) AS parking, count(DISTINCT fid) AS areas FROM mv m JOIN fx_elements x ON x.eid = m.line_id AND x.highway = 'service' JOIN fx_rects r ON r.kind = 'MACHINERY' AND m.x >= x0-2 AND m.x < x1+2 AND m.y >= y0-2 AND m.y < y1+2 WHERE e AND uses = 1 GROUP BY 1",
    "jon36_gardens": "WITH n AS (SELECT a.fid, count(*) AS b FROM fx_rects a JOIN fx_rects b ON a.kind = 'HOUSEHOLD' AND b.kind = 'BUILDING' AND least(a.x1, b.x1+0.5) > greatest(a.x0, b.x0-0.5) AND least(a.y1, b.y1+0.5) > greatest(a.y0, b.y0-0.5) GROUP BY 1) SELECT g.fid, coalesce(b, 0) AS buildings, coalesce((x1-x0)*(y1-y0)/b <= 150, false) AS private FROM fx_rects g LEFT JOIN n ON n.fid = g.fid WHERE kind = 'HOUSEHOLD'",
    "jon37_private_playgrounds": "WITH s AS (SELECT a.fid, max((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) AS c FROM fx_rects a JOIN fx_rects b ON a.kind = 'MACHINERY' AND b.kind = 'HOUSEHOLD' AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) GROUP BY 1) SELECT p.fid, coalesce(c >= 0.8 * (x1-x0)*(y1-y0), false) AS in_garden, EXISTS (SELECT 1 FROM fx_rects q WHERE q.kind = 'AUTOMOBILE' AND power(greatest(q.x0 - p.x1, p.x0 - q.x1, 0), 2) + power(greatest(q.y0 - p.y1, p.y0 - q.y1, 0), 2) <= 100) AS at_pool FROM fx_rects p LEFT JOIN s ON s.fid = p.fid WHERE p.kind = 'MACHINERY'",
    "jon38_points_of_both": "SELECT line_id, pos, x, y, 'mapped' AS origin FROM fx_vertices WHERE source = 'osm' AND pos = 1 UNION ALL SELECT line_id, pos, x, y, 'detected' FROM fx_vertices a WHERE source = 'topo' AND NOT EXISTS (SELECT 1 FROM fx_vertices b WHERE b.source = 'osm' AND b.pos = 1 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 16)",
    "jon25_closed_depressions": "WITH p AS (SELECT fid, unnest([(x0+x1)/2, x0, x1, x1, x0, (x0+x1)/2, (x0+x1)/2, x0, x1]) AS x, unnest([(y0+y1)/2, y0, y0, y1, y1, y0, y1, (y0+y1)/2, (y0+y1)/2]) AS y, unnest([false, true, true, true, true, true, true, true, true]) AS e FROM fx_rects), s AS (SELECT fid, avg(CASE WHEN e THEN dem END) AS rim, avg(CASE WHEN NOT e THEN dem END) AS mid FROM p JOIN fx_cells c ON c.rr = CAST(floor(y/4) AS BIGINT) AND c.cc = CAST(floor(x/4) AS BIGINT) GROUP BY 1) SELECT fid, round(rim - mid, 5) AS depth, rim - mid >= 0.5 AS closed FROM s WHERE rim IS NOT NULL AND mid IS NOT NULL",
}

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("grf", "agg", "jon", "top")) and callable(f)}
