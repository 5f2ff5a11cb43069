"""Queries that tidy a drawn map: road ends, objects off paths, regular bays along streets, single trees on paved ground."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.operators import cellsets, crowns, displace, road_ends, width_runs
from geoloom.sources import tables as T

SHEETS, SHEET = 16, 400


def road_inputs(spark, d):
    """A road along the lower and right side of every area, of a kind by its number; for a third a mapped road that goes on from its end; buildings; their widest half width."""
    r, c = T.rects(spark, d), F.col
    at = lambda *p: F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in p))
    spread = lambda df: df.select("line_id", F.posexplode("p").alias("pos", "v")).select("line_id", c("pos").cast("long").alias("pos"), "v.x", "v.y")
    line = spread(r.select(c("fid").alias("line_id"), at((c("x0"), c("y0")), (c("x1"), c("y0")), (c("x1"), c("y1"))).alias("p")))
    k = c("fid") % 7
    kinds = r.select(c("fid").alias("line_id"), (k != 0).alias("road"), (k == 1).alias("fixed"), k.isin(1, 2, 3).alias("filled"), F.when(k == 0, 0.3).when(k > 3, 0.5).otherwise(2.0).alias("half"))
    more = spread(r.where("fid % 3 = 0").select(c("fid").alias("line_id"), at((c("x1"), c("y0")), (c("x1"), c("y1")), (c("x1") + 3, c("y1") + 8), (c("x1") - 4, c("y1") + 25)).alias("p")))
    return line, kinds, more, r.where("kind = 'BUILDING'").select("x0", "y0", "x1", "y1"), 2.0


def grf14_road_ends(spark, d):
    """Road ends led on to the next road (7.5 m at 1:5,000) and stubs left out, line by line."""
    *tables, widest = road_inputs(spark, d)
    kept, report = road_ends.tidied(*tables, 5000, widest)
    count = kept.groupBy("line_id").agg(F.count("*").alias("vertices"))
    to = lambda n: F.round(n, 4).alias(n)
    return report.join(count, "line_id", "left").select("line_id", to("length"), to("led_start"), to("led_end"), "dropped", F.coalesce("vertices", F.lit(0)).alias("vertices"))


def moved_inputs(spark, d):
    """Paths along the lower and right sides of areas of one kind; buildings, and each line's first vertex as a point."""
    r, c = T.rects(spark, d), F.col
    sides = F.array(F.struct(F.lit(0).alias("seg"), c("x0").alias("ax"), c("y0").alias("ay"), c("x1").alias("bx"), c("y0").alias("by")), F.struct(F.lit(1).alias("seg"), c("x1").alias("ax"), c("y0").alias("ay"), c("x1").alias("bx"), c("y1").alias("by")))
    axes = r.where("kind = 'MACHINERY'").select(c("fid").alias("axis"), F.explode(sides).alias("s"), (0.5 + c("fid") % 3 * 0.5).alias("half")).select("axis", "s.*", "half")
    points = T.vertices(spark, d).where("pos = 1").select((c("line_id") * 2 + 1).alias("id"), c("x").alias("x0"), c("y").alias("y0"), c("x").alias("x1"), c("y").alias("y1"))
    return r.where("kind = 'BUILDING'").select((c("fid") * 2).alias("id"), "x0", "y0", "x1", "y1").unionByName(points), axes, 1.5


def grf21_displaced(spark, d):
    """Buildings and points kept clear of paths at 1:5,000: moved by 4.5 m (points 7.5 m) at most, or clipped by the paths' bands."""
    objects, axes, widest = moved_inputs(spark, d)
    to = lambda n: F.round(n, 6).alias(n)
    return displace.displaced(objects, axes, 5000, widest).select("id", "status", to("tx"), to("ty"), "pieces", to("left_area"))


def bay_stations(spark, d):
    """Streets along every twentieth metre of northing, with a station each two metres: how far areas reach on without a gap, 8 m at most."""
    cells = cellsets.box_cells(T.rects(spark, d), 1.0).where("cc % 2 = 0 and rr % 20 < 8").distinct()
    w = Window.partitionBy("line_id", "k").orderBy("h")
    reach = cells.select(F.expr("rr div 20").alias("line_id"), F.expr("cc div 2").alias("k"), (F.col("rr") % 20).alias("h")).withColumn("n", F.row_number().over(w) - 1)
    return reach.where("h = n").groupBy("line_id", "k").agg(F.count("*").cast("double").alias("width"))


def win12_constant_widths(spark, d):
    """Stretches of constant width (12 m long and more) of the ground beside streets."""
    return width_runs.constant_widths(bay_stations(spark, d))


def crown_inputs(spark, d):
    """A raster of 1 m on sheets of 400 m side by side: crowns at lines' first vertices (four in five with leaves), buildings, lawns and water by area; lines' last vertices as known trees."""
    c = F.col
    sheet = lambda df, key, *xs: df.select("*", *((c(x) + c(key) % SHEETS * SHEET).alias(f"{x}_")  for x in xs))
    v = T.vertices(spark, d)
    tree = sheet(v.where("pos = 1"), "line_id", "x").withColumn("rad", 2.0 + c("line_id") % 4)
    span = lambda at: F.sequence(F.ceil(c(at) - c("rad") - 0.5), F.floor(c(at) + c("rad") - 0.5))
    wide = tree.withColumn("rr", F.explode(span("y"))).withColumn("cc", F.explode(span("x_")))
    d2 = (c("cc") + 0.5 - c("x_")) ** 2 + (c("rr") + 0.5 - c("y")) ** 2
    crown = wide.where(d2 <= c("rad") * c("rad")).select("rr", "cc", ((4.0 + c("line_id") % 9) * (1 - d2 / (4 * c("rad") * c("rad")))).alias("h"), (c("line_id") % 5 != 0).alias("green"))
    r = sheet(T.rects(spark, d), "fid", "x0", "x1").select("kind", c("x0_").alias("x0"), "y0", c("x1_").alias("x1"), "y1")
    around = F.when(c("kind") == "BUILDING", 1.5).otherwise(0.0)
    ground = cellsets.box_cells(r.select("kind", (c("x0") - around).alias("x0"), (c("y0") - around).alias("y0"), (c("x1") + around).alias("x1"), (c("y1") + around).alias("y1")), 1.0, "kind")
    kinds = ground.where("kind in ('BUILDING', 'MACHINERY', 'AUTOMOBILE')").select("rr", "cc", F.lit(0.0).alias("h"), (c("kind") == "MACHINERY").alias("green"), (c("kind") == "BUILDING").alias("building"), (c("kind") == "AUTOMOBILE").alias("water"))
    both = crown.select("*", F.lit(False).alias("building"), F.lit(False).alias("water")).unionByName(kinds)
    cells = both.groupBy("rr", "cc").agg(F.max("h").alias("h"), F.bool_or("green").alias("green"), F.bool_or("building").alias("building"), F.bool_or("water").alias("water"))
    last = sheet(v.where("pos = 2"), "line_id", "x").where("line_id % 2 = 0").select(c("x_").alias("x"), "y")
    return cells, last, (0, 0, SHEET, SHEETS * SHEET)


def ras41_paved_trees(spark, d):
    """Single tree crowns on paved ground, not among the known trees."""
    cells, existing, extent = crown_inputs(spark, d)
    to = lambda n: F.round(n, 6).alias(n)
    return crowns.paved_trees(cells, existing, 1.0, extent).select(*(to(n) for n in ("x", "y", "area", "highest", "compact", "others", "crown_green", "ground_green")))


SQL = {}

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("grf", "win", "ras")) and callable(f)}
