"""Queries that turn cells into rings, ways into areas, and rank, count and compare shapes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.functions import geometry, times
from geoloom.operators import cellsets, focal, grid, lines, ops, sequence
from geoloom.operators import graph as G
from geoloom.operators import spatial_join as J
from geoloom.plans.lines import _CHAIKIN, _T0, _T1
from geoloom.plans.raster import SQL as RASTER_SQL
from geoloom.plans.raster import _cells, _dense, ras28_boulders
from geoloom.plans.spatial import _COMMON, _OVER, _SEG
from geoloom.plans.surfaces import _GRIDC
from geoloom.sources import tables as T


def region_rings(cells, width, cls):
    """(region, cls, ring, edges, area): the rings around every 4-connected region of one class; holes have a negative area.

    Cell edges run with the region on their left. Each has one next edge: where two regions' corners meet it turns left,
    so that cells that touch at a corner only are kept apart. Edges that follow one another are one ring.
    """
    named = G.regions(cells, width, cls).select("rr", "cc", cls, F.col("component").alias("region"))
    sides = ((0, -1, 0, 0, 0, 0, 1), (1, 0, 1, 0, 1, 1, 1), (2, 1, 0, 1, 1, 1, 0), (3, 0, -1, 1, 0, 0, 0))  # direction; neighbour; start and end corners
    around = focal.shifted(named, [(-dy, -dx) for _, dy, dx, *_ in sides]).select("rr", "cc", F.col("region").alias("near"), F.col("dy"), F.col("dx"))
    edge = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(dy).alias("ny"), F.lit(dx).alias("nx"), (F.col("rr") + y0).alias("y0"), (F.col("cc") + x0).alias("x0"), (F.col("rr") + y1).alias("y1"), (F.col("cc") + x1).alias("x1")) for d, dy, dx, y0, x0, y1, x1 in sides))).alias("e")
    every = named.select("rr", "cc", cls, "region", edge).select("rr", "cc", cls, "region", "e.*")
    inner = around.select("rr", "cc", (-F.col("dy")).alias("ny"), (-F.col("dx")).alias("nx"), F.col("near").alias("region"))
    outer = every.join(inner, ["rr", "cc", "ny", "nx", "region"], "left_anti").withColumn("id", (F.col("rr") * width + F.col("cc")) * 4 + F.col("d"))
    after = outer.select("region", F.col("y0").alias("y1"), F.col("x0").alias("x1"), F.col("d").alias("turn"), F.col("id").alias("next"))
    follows = outer.join(after, ["region", "y1", "x1"]).groupBy("id").agg(F.min_by("next", F.pmod(F.col("turn") - F.col("d") - 1, F.lit(4))).alias("next"))
    ring = G.labelled(outer, follows.select(F.col("id").alias("a"), F.col("next").alias("b")))
    twice = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    return outer.join(ring, "id").groupBy("region", cls, F.col("component").alias("ring")).agg(F.count("*").alias("edges"), (F.sum(twice) / 2).alias("area"))


def ras30_region_rings(spark, d):
    """Canopy classes as rings."""
    c = _cells(spark, d).select("rr", "cc", grid.ladder(F.col("chm"), (12.0, 20.0, 23.0)).alias("cls"))
    return region_rings(c, 1000, "cls")


def snk06_region_layer(spark, d):
    """The layer of regions: class, symbol, area in m2 and length of the outline, holes told apart."""
    rings = ras30_region_rings(spark, d)
    per = rings.groupBy("region", "cls").agg((F.sum("area") * 16).alias("area"), (F.sum("edges") * 4).alias("outline"), F.sum((F.col("area") < 0).cast("long")).alias("holes"))
    code = F.when(F.col("cls") == 1, "403").when(F.col("cls") == 2, "406").when(F.col("cls") == 3, "408").otherwise("405")
    return per.select("region", "cls", code.alias("code"), "area", "outline", "holes")


def set18_assembled_areas(spark, d):
    """Areas from open member ways (the four sides of a box, told apart): rings chained at their ends, inner ones by containment."""
    r = T.rects(spark, d)
    way = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit((k + 1) % 4).alias("n")) for k in range(4)))).alias("w")
    node = lambda c: F.col("fid") * 4 + F.col(c) + 10_000_000_000
    pieces = r.select("fid", way).select((F.col("fid") * 4 + F.col("w.k")).alias("id"), "fid", node("w.k").alias("a"), node("w.n").alias("b"))
    ring = G.chained(pieces.select("id", "a", "b")).join(pieces.select("id", "fid"), "id").groupBy("chain").agg(F.count("*").alias("ways"), F.min("fid").alias("fid"))
    box = r.select("fid", "x0", "y0", "x1", "y1")
    pairs = J.shape_overlaps(box, box).where("b_x0 > x0 and b_y0 > y0 and b_x1 < x1 and b_y1 < y1")
    inner = box.join(pairs.groupBy(*J.BOX).agg(F.sum("n").alias("inner")), list(J.BOX)).select("fid", "inner")
    return ring.join(inner, "fid", "left").select("fid", "chain", "ways", F.coalesce("inner", F.lit(0)).alias("inner"))


def set02_parts(spark, d):
    """What is left of areas after a difference, as connected parts."""
    r = T.rects(spark, d)
    left = cellsets.minus(cellsets.box_cells(r.where("kind = 'FURNITURE'"), T.CELL_M).distinct(), cellsets.box_cells(r.where("kind in ('HOUSEHOLD', 'BUILDING')"), T.CELL_M))
    return G.regions(left, 1000).groupBy("component").agg(F.count("*").alias("cells"))


def set19_outlines(spark, d):
    """Outlines of areas as lines: their sides with measure and direction."""
    side = lambda n, a, b, c, e, deg: F.struct(F.lit(n).alias("side"), F.col(a).alias("ax"), F.col(b).alias("ay"), F.col(c).alias("bx"), F.col(e).alias("by"), F.lit(float(deg)).alias("bearing"))
    sides = F.array(side(1, "x0", "y0", "x1", "y0", 90), side(2, "x1", "y0", "x1", "y1", 0), side(3, "x1", "y1", "x0", "y1", 270), side(4, "x0", "y1", "x0", "y0", 180))
    e = T.rects(spark, d).select("fid", F.explode(sides).alias("s")).select("fid", "s.*").withColumn("len", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    before = Window.partitionBy("fid").orderBy("side").rowsBetween(Window.unboundedPreceding, -1)
    return e.select("fid", "side", F.round("len", 4).alias("len"), F.round(F.coalesce(F.sum("len").over(before), F.lit(0.0)), 4).alias("m0"), F.round(geometry.bearing(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")), 4).alias("bearing"))


def grf02_cleaned_mask(spark, d):
    """Tall cells in 8-connected groups of four and more, with holes of one cell filled."""
    tall = _dense(spark, d).where("chm >= 23").select("rr", "cc")
    own = tall.withColumn("id", F.col("rr") * 1000 + F.col("cc"))
    links = focal.shifted(own, [(0, 1), (1, 0), (1, 1), (1, -1)]).select("rr", "cc", F.col("id").alias("a")).join(own.withColumnRenamed("id", "b"), ["rr", "cc"]).select("a", "b")
    named = own.join(G.labelled(own, links), "id")
    kept = named.join(named.groupBy("component").agg(F.count("*").alias("n")).where("n >= 4"), "component", "left_semi").select("rr", "cc")
    around = focal.shifted(kept, [(0, 1), (1, 0), (0, -1), (-1, 0)]).groupBy("rr", "cc").agg(F.count("*").alias("n")).where("n = 4").select("rr", "cc")
    return kept.unionByName(cellsets.minus(around, kept))


def grf04_joined_lines(spark, d):
    """Segments joined through junctions with the straightest of the same symbol."""
    from geoloom.plans.areas import _ends

    cls = sequence.segments(T.vertices(spark, d)).select((F.col("line_id") * 100000 + F.col("pos")).alias("line"), F.substring("cls", 1, 1).cast("long").alias("k"))
    arms = _ends(spark, d).join(cls, "line").select((F.col("node") * 10 + F.col("k")).alias("node"), "arm", "line", "bearing")
    return G.strokes(arms)


def agg15_line_metrics(spark, d):
    """Lines before and after their corners are cut: vertices, length, and how often lines cross themselves."""
    v = T.vertices(spark, d).where("source = 'topo'").select("line_id", F.col("pos").cast("long").alias("pos"), "x", "y")
    both = v.withColumn("variant", F.lit("old")).unionByName(lines.corners_cut(v, 1).withColumn("variant", F.lit("new")))
    w = Window.partitionBy("variant", "line_id").orderBy("pos")
    seg = both.select("variant", "line_id", "pos", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by"))
    other = seg.where("bx is not null").toDF("variant", "line_id", "other", "cx", "cy", "dx", "dy")
    side = lambda px, py, qx, qy, rx, ry: (F.col(qx) - F.col(px)) * (F.col(ry) - F.col(py)) - (F.col(qy) - F.col(py)) * (F.col(rx) - F.col(px))
    cross = (side("ax", "ay", "bx", "by", "cx", "cy") * side("ax", "ay", "bx", "by", "dx", "dy") < 0) & (side("cx", "cy", "dx", "dy", "ax", "ay") * side("cx", "cy", "dx", "dy", "bx", "by") < 0)
    hits = seg.where("bx is not null").join(other, ["variant", "line_id"]).where(F.col("pos") + 1 < F.col("other")).where(cross).groupBy("variant").agg(F.count("*").alias("crossings"))
    per = seg.groupBy("variant").agg(F.count("*").alias("vertices"), F.round(F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))), 2).alias("length"))
    return per.join(hits, "variant", "left").select("variant", "vertices", "length", F.coalesce("crossings", F.lit(0)).alias("crossings"))


def agg02_hits(spark, d):
    """Low and other hits a cell, each weighed: single returns whole, others by half."""
    weight = F.when(F.col("nr") == 1, 1.0).otherwise(0.5)
    low = F.col("hag") < 5
    return grid.with_cell(T.points(spark, d), 3.0).groupBy("rr", "cc").agg(F.sum(F.when(low, weight).otherwise(0.0)).alias("low"), F.sum(F.when(low, 0.0).otherwise(weight)).alias("other"), F.count("*").alias("n"))


def agg22_report_groups(spark, d):
    """Jobs by day, by status and by country, with users and networks; and users by how many jobs they have."""
    j = T.jobs(spark, d)
    cut = lambda what, key: j.groupBy(key.cast("string").alias("value")).agg(F.count("*").alias("jobs"), F.countDistinct("ip_tag").alias("users"), F.countDistinct("ip_net_tag").alias("nets")).withColumn("cut", F.lit(what))
    groups = cut("day", F.date_format("created_at", "yyyy-MM-dd")).unionByName(cut("status", F.col("status"))).unionByName(cut("country", F.col("country_no")))
    return groups.unionByName(cut("user", F.col("ip_tag")).where("jobs >= 150")).select("cut", "value", "jobs", "users", "nets")


def top08_fair_order(spark, d):
    """Order of waiting jobs: users with few jobs in the 24 hours before first, then those with few still running, then by time."""
    return ops.fair_order(T.jobs(spark, d), "ip_tag", "country_no")


def top10_source_order(spark, d):
    """Lines in one order by source, width class and length: places inside groups, and groups put one after the other."""
    seg = sequence.segments(T.vertices(spark, d))
    rank = F.when(F.col("source") == "dtm", 0).when(F.col("source") == "osm", 1).otherwise(2)
    line = seg.groupBy("line_id", "source").agg(F.round(F.sum("len"), 3).alias("length"), F.min(F.substring("cls", 1, 1)).alias("width")).withColumn("rank", rank)
    sizes = line.groupBy("rank", "width").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("rank", "width").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a row for each group
    place = F.row_number().over(Window.partitionBy("rank", "width").orderBy(F.desc("length"), "line_id"))
    return line.withColumn("place", place).join(F.broadcast(sizes), ["rank", "width"]).select("line_id", (F.col("before") + F.col("place")).alias("place"))


def jon09_kept_parking(spark, d):
    """Parking areas that no area of the better source overlaps by 1 m2 or more."""
    r = T.rects(spark, d)
    hit = J.shape_overlaps(r.where("kind = 'BUILDING'"), r.where("kind = 'MACHINERY' and lvl = 1")).where("common >= 1").select(*J.BOX).distinct()
    return r.where("kind = 'BUILDING'").join(hit, list(J.BOX), "left_anti").select("fid")


def jon12_town_sidewalks(spark, d):
    """Sidewalks without those half in nature or with 15 m of unpaved track inside."""
    r = T.rects(spark, d)
    walk = r.where("kind = 'FURNITURE'").select("fid", "x0", "y0", "x1", "y1")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    nature = J.shape_overlaps(walk, r.where("kind = 'HOUSEHOLD'")).groupBy(*J.BOX).agg(F.max("common").alias("common"))
    track = sequence.segments(T.vertices(spark, d)).where("source = 'topo' and cls = '5-LOW' and len > 0")
    # a track's part in a walk is the same for all copies of the walk
    inside = lines.in_boxes(track, walk.select(*J.BOX).distinct()).groupBy(*J.BOX).agg(F.sum((F.col("t1") - F.col("t0")) * F.col("len")).alias("length"))
    met = walk.join(nature, list(J.BOX), "left").join(inside, list(J.BOX), "left")
    return met.where((F.coalesce("common", F.lit(0.0)) < 0.5 * area) & (F.coalesce("length", F.lit(0.0)) < 15)).select("fid")


def jon28_bank_wins(spark, d):
    """Rocks free of blockers; those that meet an earth bank yield to it."""
    mine = cellsets.box_cells(T.rects(spark, d).where("kind = 'FURNITURE'"), T.CELL_M, "fid")
    block = cellsets.box_cells(T.rects(spark, d).where("kind = 'MACHINERY' and lvl = 0"), T.CELL_M)
    bank = lines.band_cells(sequence.segments(T.vertices(spark, d)).where("source = 'dtm' and cls = '1-URGENT'"), 2.0, T.CELL_M)
    status = lambda bad, what: cellsets.both(mine, bad).select("fid").distinct().withColumn(what, F.lit(True))
    flags = mine.select("fid").distinct().join(status(block, "blocked"), "fid", "left").join(status(bank, "bank"), "fid", "left")
    return flags.select("fid", F.when(F.col("blocked"), "blocked").when(F.col("bank"), "bank wins").otherwise("kept").alias("status"))


def jon46_extent_coverage(spark, d):
    """Share of each extent's cells that the source has data for."""
    have = _cells(spark, d).where("ground_hits > 0").select("rr", "cc", F.lit(1).alias("has"))
    ext = cellsets.box_cells(T.rects(spark, d).where("lvl = 1"), T.CELL_M, "fid")
    return ext.join(have, ["rr", "cc"], "left").groupBy("fid").agg(F.count("*").alias("cells"), F.round(F.count("has") / F.count("*"), 5).alias("share"))


def ras28_boulder_peaks(spark, d):
    """Boulder cells that are the highest of 5 x 5."""
    top = focal.box(_dense(spark, d).withColumn("v", F.col("dem")), 2, "max", "v", "top").where("dem = top").select("rr", "cc")
    return ras28_boulders(spark, d).join(top, ["rr", "cc"], "left_semi")


def ras33_regridded(spark, d):
    """Terrain on a grid of 60 x 60: the nearest cell, and the mean and the highest of the cells whose centre lies in each."""
    c = _cells(spark, d).select("rr", "cc", "dem")
    target = lambda v: F.floor((F.col(v) + 0.5) * 0.6)
    block = c.groupBy(target("rr").alias("tr"), target("cc").alias("tc")).agg(F.round(F.avg("dem"), 5).alias("mean"), F.max("dem").alias("top"))
    near = grid.grid_dimension(spark, 60, 60).select(F.col("rr").alias("tr"), F.col("cc").alias("tc"), F.floor((F.col("rr") + 0.5) / 0.6).alias("rr"), F.floor((F.col("cc") + 0.5) / 0.6).alias("cc"))
    return near.join(c.withColumnRenamed("dem", "near"), ["rr", "cc"], "left").join(block, ["tr", "tc"], "left").select("tr", "tc", "near", "mean", "top")


def _lead(src, keys):
    return f"SELECT *, lead(x) OVER (PARTITION BY {keys} ORDER BY pos) AS bx, lead(y) OVER (PARTITION BY {keys} ORDER BY pos) AS by_ FROM {src}"


SQL = {
    "set18_assembled_areas": "SELECT a.fid, a.fid*4 AS chain, 4 AS ways, (SELECT count(*) FROM fx_rects b WHERE b.fid <> a.fid AND b.x0 > a.x0 AND b.y0 > a.y0 AND b.x1 < a.x1 AND b.y1 < a.y1) AS inner FROM fx_rects a",
    "set02_parts": f"WITH RECURSIVE {_GRIDC}, c AS (SELECT rr, cc, rr*1000 + cc AS id FROM (SELECT rr, cc FROM rc WHERE kind = 'FURNITURE' EXCEPT SELECT rr, cc FROM rc WHERE kind IN ('HOUSEHOLD', 'BUILDING')) z), l AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON abs(a.rr-b.rr) + abs(a.cc-b.cc) = 1), f(root, id) AS (SELECT id, id FROM c UNION SELECT f.root, l.b FROM f JOIN l ON f.id = l.a AND l.b > f.root), m AS (SELECT id, min(root) AS component FROM f GROUP BY 1) SELECT component, count(*) AS cells FROM m GROUP BY 1",
    "set19_outlines": "SELECT fid, unnest([1, 2, 3, 4]) AS side, unnest([round(x1-x0, 4), round(y1-y0, 4), round(x1-x0, 4), round(y1-y0, 4)]) AS len, unnest([0.0::DOUBLE, round(x1-x0, 4), round(x1-x0+y1-y0, 4), round(2*(x1-x0)+y1-y0, 4)]) AS m0, unnest([90.0::DOUBLE, 0.0::DOUBLE, 270.0::DOUBLE, 180.0::DOUBLE]) AS bearing FROM fx_rects",
    "grf02_cleaned_mask": "WITH RECURSIVE c AS (SELECT rr, cc, rr*1000 + cc AS id FROM fx_dense WHERE chm >= 23), l AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.id <> b.id AND abs(a.rr-b.rr) <= 1 AND abs(a.cc-b.cc) <= 1), f(root, id) AS (SELECT id, id FROM c UNION SELECT f.root, l.b FROM f JOIN l ON f.id = l.a AND l.b > f.root), m AS (SELECT id, min(root) AS k FROM f GROUP BY 1), s AS (SELECT k FROM m GROUP BY 1 HAVING count(*) >= 4), q AS (SELECT c.rr, c.cc FROM c JOIN m ON m.id = c.id JOIN s ON s.k = m.k) SELECT rr, cc FROM q UNION SELECT g.rr, g.cc FROM (SELECT a.rr + dr AS rr, a.cc + dc AS cc FROM q a, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) o(dr, dc)) g GROUP BY 1, 2 HAVING count(*) = 4",
    "agg15_line_metrics": f"""WITH c0 AS (SELECT line_id, pos, x, y FROM fx_vertices WHERE source = 'topo'), {_CHAIKIN.format(n=1, p=0)}, b AS (SELECT 'old' AS variant, * FROM c0 UNION ALL SELECT 'new', line_id, pos, x, y FROM c1), s AS ({_lead('b', 'variant, line_id')}),
      h AS (SELECT a.variant, count(*) AS crossings FROM s a JOIN s b ON a.variant = b.variant AND a.line_id = b.line_id AND a.pos + 1 < b.pos AND a.bx IS NOT NULL AND b.bx IS NOT NULL
        AND ((a.bx-a.x)*(b.y-a.y)-(a.by_-a.y)*(b.x-a.x)) * ((a.bx-a.x)*(b.by_-a.y)-(a.by_-a.y)*(b.bx-a.x)) < 0 AND ((b.bx-b.x)*(a.y-b.y)-(b.by_-b.y)*(a.x-b.x)) * ((b.bx-b.x)*(a.by_-b.y)-(b.by_-b.y)*(a.bx-b.x)) < 0 GROUP BY 1)
      SELECT s.variant, count(*) AS vertices, round(sum(sqrt((bx-x)*(bx-x)+(by_-y)*(by_-y))), 2) AS length, coalesce(any_value(crossings), 0) AS crossings FROM s LEFT JOIN h ON h.variant = s.variant GROUP BY 1""",
    "agg02_hits": "SELECT CAST(floor(y/3) AS BIGINT) AS rr, CAST(floor(x/3) AS BIGINT) AS cc, sum(CASE WHEN hag < 5 THEN CASE WHEN nr = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END ELSE 0 END) AS low, sum(CASE WHEN hag < 5 THEN 0 ELSE CASE WHEN nr = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END END) AS other, count(*) AS n FROM fx_points GROUP BY 1, 2",
    "agg22_report_groups": "WITH g AS (SELECT unnest(['day', 'status', 'country', 'user']) AS cut, unnest([strftime(created_at, '%Y-%m-%d'), status, CAST(country_no AS VARCHAR), CAST(ip_tag AS VARCHAR)]) AS value, ip_tag, ip_net_tag FROM fx_jobs) SELECT cut, value, count(*) AS jobs, count(DISTINCT ip_tag) AS users, count(DISTINCT ip_net_tag) AS nets FROM g GROUP BY 1, 2 HAVING cut <> 'user' OR count(*) >= 150",
    "top08_fair_order": """WITH j AS (SELECT job_id, ip_tag, country_no, created_at, CAST(floor(epoch(created_at)) AS BIGINT) AS t, CAST(ceil(build_seconds) AS BIGINT) AS runs FROM fx_jobs),
      r AS (SELECT a.job_id, a.country_no, a.created_at, count(b.job_id) AS recent, count(CASE WHEN b.t + b.runs > a.t THEN 1 END) AS active FROM j a LEFT JOIN j b ON b.ip_tag = a.ip_tag AND b.t > a.t - 86400 AND (b.t < a.t OR b.t = a.t AND b.job_id < a.job_id) GROUP BY 1, 2, 3)
      SELECT job_id, country_no, recent, active, row_number() OVER (PARTITION BY country_no ORDER BY recent, active, created_at, job_id) AS place FROM r""",
    "top10_source_order": f"WITH {_SEG}, l AS (SELECT seg.line_id, seg.source, round(sum(len), 3) AS length, min(substring(cls, 1, 1)) AS width FROM seg JOIN fx_vertices v ON v.line_id = seg.line_id AND v.pos = seg.pos GROUP BY 1, 2) SELECT line_id, row_number() OVER (ORDER BY CASE source WHEN 'dtm' THEN 0 WHEN 'osm' THEN 1 ELSE 2 END, width, length DESC, line_id) AS place FROM l",
    "jon09_kept_parking": f"SELECT fid FROM fx_rects a WHERE kind = 'BUILDING' AND NOT EXISTS (SELECT 1 FROM fx_rects b WHERE b.kind = 'MACHINERY' AND b.lvl = 1 AND {_OVER} AND {_COMMON} >= 1)",
    "jon12_town_sidewalks": f"""WITH {_SEG}, tr AS (SELECT seg.* FROM seg JOIN fx_vertices v ON v.line_id = seg.line_id AND v.pos = seg.pos WHERE seg.source = 'topo' AND v.cls = '5-LOW' AND len > 0), n AS (SELECT a.fid, max({_COMMON}) AS c FROM fx_rects a JOIN fx_rects b ON a.kind = 'FURNITURE' AND b.kind = 'HOUSEHOLD' AND {_OVER} GROUP BY 1),
      i AS (SELECT fid, sum((t1-t0)*len) AS l FROM (SELECT r.fid, s.len, {_T0} AS t0, {_T1} AS t1 FROM tr s JOIN fx_rects r ON r.kind = 'FURNITURE' AND least(s.ax,s.bx) <= r.x1 AND greatest(s.ax,s.bx) >= r.x0 AND least(s.ay,s.by_) <= r.y1 AND greatest(s.ay,s.by_) >= r.y0) q WHERE t0 < t1 GROUP BY 1)
      SELECT w.fid FROM fx_rects w LEFT JOIN n ON n.fid = w.fid LEFT JOIN i ON i.fid = w.fid WHERE kind = 'FURNITURE' AND coalesce(c, 0) < 0.5*(x1-x0)*(y1-y0) AND coalesce(l, 0) < 15""",
    "jon28_bank_wins": f"""WITH {_SEG}, bk AS (SELECT seg.* FROM seg JOIN fx_vertices v ON v.line_id = seg.line_id AND v.pos = seg.pos WHERE seg.source = 'dtm' AND v.cls = '1-URGENT'), {_GRIDC}, m AS (SELECT rc.rr, rc.cc, fid, (rc.cc+0.5::DOUBLE)*4 AS x, (rc.rr+0.5::DOUBLE)*4 AS y FROM rc WHERE kind = 'FURNITURE'), b AS (SELECT DISTINCT rr, cc FROM rc WHERE kind = 'MACHINERY' AND lvl = 0),
      h AS (SELECT DISTINCT fid FROM m JOIN bk s ON m.x BETWEEN least(s.ax,s.bx)-2 AND greatest(s.ax,s.bx)+2 AND m.y BETWEEN least(s.ay,s.by_)-2 AND greatest(s.ay,s.by_)+2 AND power(m.x-s.ax-greatest(0,least(1,coalesce(((m.x-s.ax)*(s.bx-s.ax)+(m.y-s.ay)*(s.by_-s.ay))/nullif(s.len*s.len,0),0)))*(s.bx-s.ax), 2) + power(m.y-s.ay-greatest(0,least(1,coalesce(((m.x-s.ax)*(s.bx-s.ax)+(m.y-s.ay)*(s.by_-s.ay))/nullif(s.len*s.len,0),0)))*(s.by_-s.ay), 2) <= 4)
      SELECT DISTINCT m.fid, CASE WHEN m.fid IN (SELECT a.fid FROM m a JOIN b ON b.rr = a.rr AND b.cc = a.cc) THEN 'blocked' WHEN m.fid IN (SELECT fid FROM h) THEN 'bank wins' ELSE 'kept' END AS status FROM m""",
    "jon46_extent_coverage": f"WITH {_GRIDC} SELECT fid, count(*) AS cells, round(count(c.rr)/count(*), 5) AS share FROM rc LEFT JOIN fx_cells c ON c.rr = rc.rr AND c.cc = rc.cc AND c.ground_hits > 0 WHERE lvl = 1 GROUP BY 1",
    "ras28_boulder_peaks": f"WITH bo AS ({RASTER_SQL['ras28_boulders']}), tp AS (SELECT c.rr, c.cc FROM fx_dense c JOIN fx_dense n ON n.rr BETWEEN c.rr-2 AND c.rr+2 AND n.cc BETWEEN c.cc-2 AND c.cc+2 GROUP BY c.rr, c.cc, c.dem HAVING c.dem = max(n.dem)) SELECT bo.rr, bo.cc, bo.rise FROM bo JOIN tp ON tp.rr = bo.rr AND tp.cc = bo.cc",
    "ras33_regridded": "WITH b AS (SELECT CAST(floor((rr+0.5::DOUBLE)*0.6::DOUBLE) AS BIGINT) AS tr, CAST(floor((cc+0.5::DOUBLE)*0.6::DOUBLE) AS BIGINT) AS tc, round(avg(dem), 5) AS mean, max(dem) AS top FROM fx_cells GROUP BY 1, 2), t AS (SELECT r.range AS tr, k.range AS tc FROM range(0, 60) r, range(0, 60) k) SELECT t.tr, t.tc, c.dem AS near, b.mean, b.top FROM t LEFT JOIN fx_cells c ON c.rr = CAST(floor((t.tr+0.5::DOUBLE)/0.6::DOUBLE) AS BIGINT) AND c.cc = CAST(floor((t.tc+0.5::DOUBLE)/0.6::DOUBLE) AS BIGINT) LEFT JOIN b ON b.tr = t.tr AND b.tc = t.tc",
}

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("ras", "snk", "set", "grf", "agg", "top", "jon")) and callable(f) and n != "ras28_boulders"}
