"""Queries along and between lines: clipping, cutting by zones, simplifying, cover by other lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.operators import grid, lines, sequence
from geoloom.operators import spatial_join as J
from geoloom.operators.crossing_counts import crossing_counts
from geoloom.operators.nearest_segments import nearest_segments
from geoloom.plans.spatial import _SEG, _STA
from geoloom.sources import tables as T
from geoloom.sources.store import written

STEP = 25.0


def _seg(spark, d, where="true"):
    return sequence.segments(T.vertices(spark, d)).where(where)


def _rects(spark, d, where="true"):
    return T.rects(spark, d).where(where)


def _spans(df):
    return df.select("line_id", F.round("s0", 3).alias("s0"), F.round("s1", 3).alias("s1"))


def win05_simplified(spark, d):
    return lines.simplified(T.vertices(spark, d), 57.3)


def win06_corners_cut(spark, d):
    return lines.corners_cut(T.vertices(spark, d)).select("line_id", "pos", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def win07_smoothed_rings(spark, d):
    """Every line taken as a ring."""
    return lines.smoothed_rings(T.vertices(spark, d), 1.0, 40.0).select("line_id", "pos", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def win14_downhill(spark, d):
    """Lines turned so that the ground falls to their right: the mean drop of the samples on both sides decides."""
    dem = grid.surfaces(T.points(spark, d), T.CELL_M).select("rr", "cc", "dem")
    st = sequence.stations(_seg(spark, d, "source = 'topo'"), STEP)
    side = lambda s: [grid.cell(F.col("y") + s * 6.0 * F.col("tx"), 4).alias("rr"), grid.cell(F.col("x") - s * 6.0 * F.col("ty"), 4).alias("cc")]
    left = st.select("line_id", "k", *side(1)).join(dem, ["rr", "cc"]).select("line_id", "k", F.col("dem").alias("l"))
    right = st.select("line_id", "k", *side(-1)).join(dem, ["rr", "cc"]).select("line_id", "k", F.col("dem").alias("r"))
    drop = left.join(right, ["line_id", "k"]).groupBy("line_id").agg(F.round(F.avg(F.col("l") - F.col("r")), 6).alias("drop"))
    turned = T.vertices(spark, d).where("source = 'topo'").join(drop, "line_id", "left").withColumn("turned", F.coalesce(F.col("drop") < 0, F.lit(False)))
    n = F.count("*").over(Window.partitionBy("line_id"))
    return turned.select("line_id", F.when(F.col("turned"), n + 1 - F.col("pos")).otherwise(F.col("pos")).cast("long").alias("pos"), "x", "y", "turned")


def win18_support_positions(spark, d):
    """Places of a line's vertices that have a support within 8 m, in order."""
    support = T.rects(spark, d).select(((F.col("x0") + F.col("x1")) / 2).alias("rx"), ((F.col("y0") + F.col("y1")) / 2).alias("ry"))
    near = J.beside(T.vertices(spark, d).select("line_id", "pos", "x", "y"), support, 8.0)
    return near.groupBy("line_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("pos")), lambda p: p.cast("string")), ",").alias("places"))


def set12_clipped_lines(spark, d):
    """Line segments inside a rectangle."""
    c = lines.clipped(_seg(spark, d), 90.0, 60.0, 310.0, 255.0)
    return c.select("line_id", "pos", *(F.round(a, 4).alias(a) for a in ("cx", "cy", "dx", "dy")))


def set12_clipped_rings(spark, d):
    """Area and corners of rings cut by a rectangle."""
    from geoloom.functions.geometry import ring_area

    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    r = T.rects(spark, d).withColumn("ring", F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1")))
    cut = r.select("fid", lines.clipped_ring(F.col("ring"), 90.0, 60.0, 310.0, 255.0).alias("ring"))
    return cut.select("fid", F.round(F.coalesce(ring_area(F.col("ring")), F.lit(0.0)), 4).alias("area")).where("area > 0")


def set13_lines_outside(spark, d):
    """Lines less the buildings."""
    return _spans(lines.outside_spans(_seg(spark, d), _rects(spark, d, "kind = 'BUILDING'")))


def set13_lines_inside(spark, d):
    """Line within the buildings: measures of each part, joined over vertices."""
    return _spans(lines.joined(lines.inside_spans(_seg(spark, d), _rects(spark, d, "kind = 'BUILDING'")).select("line_id", "s0", "s1"), ["line_id"]))


def jon13_steps_outside_stairs(spark, d):
    """Steps go where mapped stairs cover them; what is left counts from 1 m on."""
    return _spans(lines.outside_spans(_seg(spark, d, "source = 'topo'"), _rects(spark, d, "kind = 'FURNITURE'"), 1.0))


def jon15_water_lines_outside(spark, d):
    """Water courses less the water areas."""
    return _spans(lines.outside_spans(_seg(spark, d, "source = 'dtm'"), _rects(spark, d, "kind = 'HOUSEHOLD'")))


def jon33_roads_off_bands(spark, d):
    """Roads of another source outside the bands (areas grown by 3 m) of the own ones, from 6 m on."""
    r = _rects(spark, d, "kind = 'MACHINERY'")
    band = r.select("fid", *((F.col(c) + k).alias(c) for c, k in (("x0", -3.0), ("y0", -3.0), ("x1", 3.0), ("y1", 3.0))))
    return _spans(lines.outside_spans(_seg(spark, d, "source = 'topo'"), band, 6.0))


def jon40_fences_outside_buildings(spark, d):
    """Fences less the buildings (with half a metre around), pieces from 1.5 m on."""
    grown = _rects(spark, d, "kind = 'BUILDING'").select("fid", *((F.col(c) + k).alias(c) for c, k in (("x0", -0.5), ("y0", -0.5), ("x1", 0.5), ("y1", 0.5))))
    pieces = lines.outside_spans(_seg(spark, d, "source = 'osm'"), grown, 1.5)
    return _spans(pieces)


def jon52_edges_outside_buildings(spark, d):
    """Edges of areas (their four sides) less the buildings on top of them."""
    p = lambda a, b, c, e, k: F.struct(F.lit(k).alias("pos"), F.col(a).alias("ax"), F.col(b).alias("ay"), F.col(c).alias("bx"), F.col(e).alias("by"))
    sides = F.array(p("x0", "y0", "x1", "y0", 1), p("x1", "y0", "x1", "y1", 2), p("x1", "y1", "x0", "y1", 3), p("x0", "y1", "x0", "y0", 4))
    edge = _rects(spark, d, "kind = 'AUTOMOBILE'").select((F.col("fid")).alias("line_id"), F.explode(sides).alias("s")).select("line_id", "s.*")
    edge = edge.withColumn("len", F.abs(F.col("bx") - F.col("ax")) + F.abs(F.col("by") - F.col("ay")))
    before = F.coalesce(F.sum("len").over(Window.partitionBy("line_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return _spans(lines.outside_spans(edge.withColumn("m0", before), _rects(spark, d, "kind = 'BUILDING'")))


def jon11_roads_in_areas(spark, d):
    """Areas become roads where enough road runs inside: 150 m, or 30 m if they are 4 m wide."""
    r = _rects(spark, d, "lvl = 0")
    inside = lines.in_boxes(_seg(spark, d, "source = 'dtm' and len > 0"), J.shapes(r))
    per = inside.groupBy(*J.BOX).agg(F.round(F.sum((F.col("t1") - F.col("t0")) * F.col("len")), 3).alias("length"))
    width = F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return r.join(per, list(J.BOX)).select("fid", "length", ((F.col("length") >= 150) | ((F.col("length") >= 30) & (width >= 4))).alias("road"))


def set20_band_cells(spark, d):
    """Cells of 4 m whose centre is within 5 m of each line."""
    return lines.band_cells(_seg(spark, d, "source = 'dtm'"), 5.0, 4.0, "line_id").distinct().groupBy("line_id").agg(F.count("*").alias("cells"), F.min("rr").alias("r0"), F.max("cc").alias("c1"))


def prj02_buffered_extent(spark, d):
    """Features whose centre lies in an extent grown by 50 m, in degrees at its middle latitude."""
    west, south, east, north, m = 14.002, 50.001, 14.004, 50.0025, 50.0
    dlat = m / 111320.0
    dlon = F.lit(m) / (F.cos(F.radians(F.lit((south + north) / 2))) * 111320.0)
    lon = F.lit(14.0) + (F.col("x0") + F.col("x1")) / 2 / 71500.0
    lat = F.lit(50.0) + (F.col("y0") + F.col("y1")) / 2 / 111320.0
    return T.rects(spark, d).where(lon.between(F.lit(west) - dlon, F.lit(east) + dlon) & lat.between(F.lit(south - dlat), F.lit(north + dlat))).select("fid")


def prj14_least_lengths(spark, d):
    """Lines that are long enough for their class on paper at 1 : 10 000."""
    mm = F.when(F.col("highway") == "steps", 1.0).when(F.col("highway").isin("footway", "path", "cycleway"), 120.0).otherwise(170.0)
    length = _seg(spark, d).groupBy("line_id").agg(F.sum("len").alias("length"))
    e = T.elements(spark, d).select(F.col("eid").alias("line_id"), "highway")
    return length.join(e, "line_id").where(F.col("length") >= mm * 10000 / 1000).select("line_id", "highway", F.round("length", 3).alias("length"))


def jon04_clearances(spark, d):
    """Points that keep their distance from areas (4 m), lines (3 m) and other points (5 m)."""
    v = T.vertices(spark, d)
    p = v.where("source = 'topo'").select((F.col("line_id") * 100000 + F.col("pos")).alias("id"), "x", "y")
    r = T.rects(spark, d).where("kind = 'BUILDING'").select(*((F.col(c) + k).alias(c) for c, k in (("x0", -4.0), ("y0", -4.0), ("x1", 4.0), ("y1", 4.0))))
    dx = F.greatest(F.col("x0") + 4 - F.col("x"), F.col("x") - (F.col("x1") - 4), F.lit(0.0))
    dy = F.greatest(F.col("y0") + 4 - F.col("y"), F.col("y") - (F.col("y1") - 4), F.lit(0.0))
    off = J.inside(p, r, also=dx * dx + dy * dy < 16, how="left_anti")
    others = v.where("source = 'osm'").select(F.col("x").alias("rx"), F.col("y").alias("ry"))
    return J.away_from_segments(J.away_from(off, others, 5.0), _seg(spark, d, "source = 'dtm'").select("ax", "ay", "bx", "by"), 3.0).select("id")


def _shares(spark, d, own, other, distance, least_cos=0.5):
    return lines.cover_shares(_seg(spark, d, own), _seg(spark, d, other), STEP, distance, least_cos)


def jon05_kept_lines(spark, d):
    """Lines of which less than 70 % runs along a line of a better source; the tables' lines are dense, so 0.3 m counts."""
    return _shares(spark, d, "source = 'osm'", "source = 'dtm'", 0.3, 0.94).where("hits < 0.7 * stations").select("line_id", "stations", "hits")


def jon50_kept_walls(spark, d):
    """Walls of one source less those that a wall of another covers within 0.2 m, by half at least."""
    return _shares(spark, d, "source = 'topo'", "source = 'dtm'", 0.2, 0.94).where("hits < 0.5 * stations").select("line_id", "hits")


def jon07_parallel_clipped(spark, d):
    """What is left of lines when stretches along other centre lines are cut: runs of free stations, two at least."""
    st = sequence.stations(_seg(spark, d, "source = 'osm'"), STEP)
    hit = lines.covered_stations(st.select("line_id", "k", "x", "y", "tx", "ty"), _seg(spark, d, "source = 'dtm'"), 0.3, 0.94).withColumn("hit", F.lit(True))
    flags = st.select("line_id", "k").join(hit, ["line_id", "k"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return sequence.runs(flags, ["line_id"], ["k"], "hit").where("not hit and n >= 2").select("line_id", (F.col("first") * STEP).alias("s0"), (F.col("last") * STEP).alias("s1"))


def jon29_banks(spark, d):
    """Lines that no longer line of their source covers by 30 % within 6 m."""
    return lines.not_outdone(_seg(spark, d, "source = 'topo'"), STEP, 6.0, 0.3)


def jon18_widths(spark, d):
    """Median width of the areas across a line: at each station the run of areas that the perpendicular meets around it."""
    st = sequence.stations(_seg(spark, d, "source = 'dtm'"), STEP)
    reach = 20.0
    ray = st.select("line_id", "k", (F.col("x") - reach * F.col("ty")).alias("ax"), (F.col("y") + reach * F.col("tx")).alias("ay"), (F.col("x") + reach * F.col("ty")).alias("bx"), (F.col("y") - reach * F.col("tx")).alias("by"))
    areas = written(lines.dissolved(_rects(spark, d, "kind <> 'BUILDING'")))
    inside = lines.in_boxes(ray, areas, 16.0).select("line_id", "k", (F.col("t0") * 2 * reach).alias("s0"), (F.col("t1") * 2 * reach).alias("s1"))
    runs = lines.joined_around(inside, ["line_id", "k"], reach)
    return runs.groupBy("line_id").agg(F.count("*").alias("stations"), F.round(F.expr("percentile(s1 - s0, 0.5)"), 3).alias("width"))


def jon34_ends_to_bands(spark, d):
    """Ends of lines within 15 m of a road: the distance at which they join it."""
    v = T.vertices(spark, d).where("source = 'topo'")
    last = v.groupBy("line_id").agg(F.max_by(F.struct("x", "y"), "pos").alias("p")).select("line_id", "p.x", "p.y")
    near = nearest_segments(last.withColumnRenamed("line_id", "id"), _seg(spark, d, "source = 'dtm'"), 15.0, size=16.0)
    return near.select(F.col("id").alias("line_id"), F.round(F.sqrt("d2"), 4).alias("distance"))


def jon32_confirmed(spark, d):
    """Stretches of lines that an area of a second source confirms, or low canopy where there is none: rolling share of 5 stations from 60 % on, 50 m at least."""
    st = sequence.stations(_seg(spark, d, "source = 'osm'"), STEP)
    low = grid.surfaces(T.points(spark, d), T.CELL_M).select("rr", "cc", (F.col("chm") < 12).alias("low"))
    inside = J.inside(st.select("line_id", "k", "x", "y"), _rects(spark, d, "lvl = 1")).select("line_id", "k").withColumn("zone", F.lit(True))
    seen = grid.with_cell(st, 4.0).join(low, ["rr", "cc"], "left").join(inside, ["line_id", "k"], "left")
    w = Window.partitionBy("line_id").orderBy("k").rowsBetween(-2, 2)
    on = seen.select("line_id", "k", F.avg(F.coalesce("zone", "low", F.lit(False)).cast("int")).over(w).alias("share")).withColumn("on", F.col("share") >= 0.6)
    return sequence.runs(on, ["line_id"], ["k"], "on").where((F.col("on")) & ((F.col("last") - F.col("first")) * STEP >= 50)).select("line_id", (F.col("first") * STEP).alias("s0"), (F.col("last") * STEP).alias("s1"))


def jon41_row_support(spark, d):
    """Share of a line's stations in green areas, and in no area at all."""
    st = sequence.stations(written(_seg(spark, d, "source = 'topo'")), STEP).select("line_id", "x", "y")
    count = lambda s, n: s.groupBy("line_id").agg(F.count("*").alias(n))
    # a station's first hit answers, however many areas lie over it
    green, any_ = J.inside(st, _rects(spark, d, "kind = 'HOUSEHOLD'")), J.inside(st, T.rects(spark, d))
    n = count(st, "n").join(count(green, "g"), "line_id", "left").join(count(any_, "a"), "line_id", "left")
    share = lambda c: F.round(c / F.col("n"), 5)
    return n.select("line_id", share(F.coalesce("g", F.lit(0))).alias("green"), share(F.col("n") - F.coalesce("a", F.lit(0))).alias("nothing"))


def jon42_row_crowns(spark, d):
    """Crown peaks within 4 m of a line, numbered along it."""
    from geoloom.operators import focal
    from geoloom.plans.raster import _dense

    top = focal.box(_dense(spark, d).withColumn("v", F.col("dsm")), 2, "max", "v", "top").where("dsm is not null and dsm = top and dsm - dem >= 5")
    peak = top.select((F.col("rr") * 1000 + F.col("cc")).alias("peak"), ((F.col("cc") + 0.5) * 4).alias("x"), ((F.col("rr") + 0.5) * 4).alias("y"))
    seg = _seg(spark, d, "source = 'topo' and len > 0").select("line_id", "ax", "ay", "bx", "by", "m0", "len")
    near = J.near_segments(peak, seg, 4.0, size=8.0)
    along = F.col("m0") + F.greatest(F.lit(0.0), F.least(F.col("len"), ((F.col("x") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("by") - F.col("ay"))) / F.col("len")))
    best = near.groupBy("line_id", "peak").agg(F.round(F.min(along), 4).alias("m"))
    return best.withColumn("nth", F.row_number().over(Window.partitionBy("line_id").orderBy("m", "peak"))).select("line_id", "peak", "m", "nth")


def jon43_bridge_crossings(spark, d):
    """Lower lines that pass under each bridge."""
    seg = _seg(spark, d)
    a = seg.where("cls = '1-URGENT'").select(F.col("line_id").alias("a_id"), F.col("pos").alias("a_seg"), "ax", "ay", "bx", "by")
    b = seg.where("cls = '5-LOW'").select(F.col("line_id").alias("b_id"), F.col("pos").alias("b_seg"), F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("bx").alias("dx"), F.col("by").alias("dy"))
    return crossing_counts(a, b)


def jon30_opposite_lanes(spark, d):
    """Lanes of one class that run against each other: middles within 10 m, directions at 150 degrees or more."""
    seg = _seg(spark, d, "len > 0").select("line_id", "pos", "cls", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"), ((F.col("bx") - F.col("ax")) / F.col("len")).alias("ux"), ((F.col("by") - F.col("ay")) / F.col("len")).alias("uy"))
    other = seg.toDF("b_line", "b_pos", "cls", "rx", "ry", "vx", "vy").withColumn("sector", J.sector(F.col("vx"), F.col("vy")))
    # only lanes of one class and of opposite sectors meet; cells of 20 m and few sectors keep the copies that are shuffled to 8 a lane at most
    facing = seg.withColumn("sector", F.explode(J.sectors_opposite(F.col("ux"), F.col("uy"))))
    pairs = J.within(facing, other, 10.0, on=("cls", "sector"), size=20.0).where("line_id < b_line").where(F.col("ux") * F.col("vx") + F.col("uy") * F.col("vy") <= -0.8660254)
    return pairs.select(F.col("line_id").alias("a_line"), F.col("pos").alias("a_pos"), "b_line", "b_pos", F.round(F.sqrt("d2"), 4).alias("distance"))


def jon39_fences_at_borders(spark, d):
    """Fences whose first, middle and last station all lie within 6 m of a private border."""
    seg = _seg(spark, d, "source = 'osm' and len > 0")
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y")) for k, t in ((0, 0.05), (1, 0.5), (2, 0.95)))))
    st = seg.select("line_id", "pos", at.alias("p")).select("line_id", "pos", "p.*")
    side = lambda a, b, c, e: F.struct(F.col(a).alias("ax"), F.col(b).alias("ay"), F.col(c).alias("bx"), F.col(e).alias("by"))
    border = _rects(spark, d, "kind = 'FURNITURE'").select(F.explode(F.array(side("x0", "y0", "x1", "y0"), side("x1", "y0", "x1", "y1"), side("x1", "y1", "x0", "y1"), side("x0", "y1", "x0", "y0"))).alias("s")).select("s.*")
    near = J.beside_segments(st, border, 6.0)
    return near.groupBy("line_id", "pos").agg(F.count("*").alias("n")).where("n = 3").select("line_id", "pos")


def jon26_dense_contours(spark, d):
    """Lines on steep ground: 30 % of their stations where contours (5 m) stand closer than 10 m."""
    from geoloom.operators import focal
    from geoloom.plans.raster import _dense

    g = focal.gradient(_dense(spark, d).withColumn("v", F.col("dem")), T.CELL_M).select("rr", "cc", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2).alias("rise"))
    st = grid.with_cell(sequence.stations(_seg(spark, d, "source = 'topo'"), STEP), 4.0).join(g, ["rr", "cc"])
    per = st.groupBy("line_id").agg(F.count("*").alias("stations"), F.sum((F.coalesce("rise", F.lit(0.0)) > 5 / 10.0).cast("long")).alias("dense"))
    return per.where("dense >= 0.3 * stations")


def jon20_parking_reach(spark, d):
    """How far parking areas reach beyond a road on each side, in steps of 2 m from 4 m off the axis to the first gap."""
    st = sequence.stations(_seg(spark, d, "source = 'dtm'"), STEP)
    side = F.explode(F.array(F.lit(-1), F.lit(1))).alias("side")
    steps = st.select("*", side).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(7))))
    off = F.col("side") * (4.0 + 2.0 * F.col("step"))
    at = steps.select("line_id", "k", "side", "step", (F.col("x") - off * F.col("ty")).alias("x"), (F.col("y") + off * F.col("tx")).alias("y"))
    hit = J.inside(at, _rects(spark, d, "kind = 'AUTOMOBILE'"))
    # the steps hit as bits, summed where the station is; the ones from the first on are the run
    bits = hit.groupBy("line_id", "k", "side").agg(F.bit_or(F.expr("shiftleft(1, step)")).alias("bits"))
    run = bits.withColumn("run", F.length(F.regexp_extract(F.reverse(F.bin("bits")), "^1+", 0)))
    return run.where("run > 0").select("line_id", "k", "side", (F.col("run") * 2.0 + 2.0).alias("reach"))


def _inside(a, b, x0="r.x0", y0="r.y0", x1="r.x1", y1="r.y1"):
    """Parameters of a segment's part in a box."""
    one = lambda p, q, lo, hi, f: f"CASE WHEN {q}={p} THEN {'CASE WHEN ' + p + '<' + lo + ' OR ' + p + '>' + hi + ' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END' if f == 'least' else '1.0::DOUBLE'} ELSE {f}(({lo}-{p})/({q}-{p}), ({hi}-{p})/({q}-{p})) END"
    t0 = f"greatest(0.0::DOUBLE, {one(a + 'ax', a + 'bx', x0, x1, 'least')}, {one(a + 'ay', a + 'by_', y0, y1, 'least')})"
    t1 = f"least(1.0::DOUBLE, {one(a + 'ax', a + 'bx', x0, x1, 'greatest')}, {one(a + 'ay', a + 'by_', y0, y1, 'greatest')})"
    return t0, t1


_T0, _T1 = _inside("s.", "s.")


def _outside(segments, boxes, least=0.0, head=_SEG):
    """Measures of lines outside boxes, as the operator has them."""
    return f"""WITH {head}, zs AS ({segments}), zb AS ({boxes}),
      zi AS (SELECT line_id, pos, m0 + t0*len AS s0, m0 + t1*len AS s1 FROM (SELECT s.line_id, s.pos, s.m0, s.len, {_T0} AS t0, {_T1} AS t1 FROM zs s JOIN zb r ON least(s.ax,s.bx) <= r.x1 AND greatest(s.ax,s.bx) >= r.x0 AND least(s.ay,s.by_) <= r.y1 AND greatest(s.ay,s.by_) >= r.y0 WHERE s.len > 0) q WHERE t0 < t1),
      zn AS (SELECT *, CASE WHEN s0 <= max(s1) OVER (PARTITION BY line_id, pos ORDER BY s0, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM zi),
      zg AS (SELECT *, sum(n) OVER (PARTITION BY line_id, pos ORDER BY s0, s1 ROWS UNBOUNDED PRECEDING) AS g FROM zn),
      zm AS (SELECT line_id, pos, min(s0) AS s0, max(s1) AS s1 FROM zg GROUP BY line_id, pos, g),
      zp AS (SELECT line_id, pos, lag(s1) OVER w AS a, s0 AS b FROM zm WINDOW w AS (PARTITION BY line_id, pos ORDER BY s0)),
      zo AS (SELECT p.line_id, coalesce(p.a, s.m0) AS s0, p.b AS s1 FROM zp p JOIN zs s ON p.line_id = s.line_id AND p.pos = s.pos
             UNION ALL SELECT s.line_id, max(m.s1), s.m0 + s.len FROM zm m JOIN zs s ON m.line_id = s.line_id AND m.pos = s.pos GROUP BY s.line_id, s.pos, s.m0, s.len
             UNION ALL SELECT line_id, m0, m0 + len FROM zs WHERE len > 0 AND NOT EXISTS (SELECT 1 FROM zm m WHERE m.line_id = zs.line_id AND m.pos = zs.pos)),
      zq AS (SELECT *, CASE WHEN s0 - lag(s1) OVER (PARTITION BY line_id ORDER BY s0, s1) <= 1e-6 THEN 0 ELSE 1 END AS n FROM zo WHERE s1 - s0 > 1e-9),
      zr AS (SELECT *, sum(n) OVER (PARTITION BY line_id ORDER BY s0, s1 ROWS UNBOUNDED PRECEDING) AS g FROM zq)
      SELECT line_id, round(min(s0), 3) AS s0, round(max(s1), 3) AS s1 FROM zr GROUP BY line_id, g HAVING max(s1) - min(s0) >= {least}"""


def _kind(k, grow=0.0):
    return f"SELECT fid, x0-{grow} AS x0, y0-{grow} AS y0, x1+{grow} AS x1, y1+{grow} AS y1 FROM fx_rects WHERE kind = '{k}'"


def _of(source):
    return f"SELECT * FROM seg WHERE source = '{source}'"


_D2 = "power({p}.x-{s}.ax-greatest(0,least(1,coalesce((({p}.x-{s}.ax)*({s}.bx-{s}.ax)+({p}.y-{s}.ay)*({s}.by_-{s}.ay))/nullif({s}.len*{s}.len,0),0)))*({s}.bx-{s}.ax), 2) + power({p}.y-{s}.ay-greatest(0,least(1,coalesce((({p}.x-{s}.ax)*({s}.bx-{s}.ax)+({p}.y-{s}.ay)*({s}.by_-{s}.ay))/nullif({s}.len*{s}.len,0),0)))*({s}.by_-{s}.ay), 2)"


def _near(p, s, r):
    return f"{p}.x BETWEEN least({s}.ax,{s}.bx)-{r} AND greatest({s}.ax,{s}.bx)+{r} AND {p}.y BETWEEN least({s}.ay,{s}.by_)-{r} AND greatest({s}.ay,{s}.by_)+{r} AND {_D2.format(p=p, s=s)} <= {r * r}"


def _cover(own, other, r, cos):
    return f"""{_STA}, o AS (SELECT * FROM sta WHERE source = '{own}'), t AS (SELECT * FROM seg WHERE source = '{other}' AND len > 0),
      h AS (SELECT DISTINCT o.line_id, o.k FROM o JOIN t ON {_near('o', 't', r)} AND abs(o.tx*(t.bx-t.ax)/t.len + o.ty*(t.by_-t.ay)/t.len) >= {cos})"""


_CHAIKIN = """i{n} AS (SELECT line_id, x, y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY line_id) AS n, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM c{p} WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
    c{n} AS (SELECT line_id, i AS pos, x, y FROM i{n} WHERE n < 3 UNION ALL SELECT line_id, 0, x, y FROM i{n} WHERE n >= 3 AND i = 0 UNION ALL SELECT line_id, 2*n - 1, x, y FROM i{n} WHERE n >= 3 AND x1 IS NULL
      UNION ALL SELECT line_id, 2*i + 1, x*0.75::DOUBLE + x1*0.25::DOUBLE, y*0.75::DOUBLE + y1*0.25::DOUBLE FROM i{n} WHERE n >= 3 AND x1 IS NOT NULL UNION ALL SELECT line_id, 2*i + 2, x*0.25::DOUBLE + x1*0.75::DOUBLE, y*0.25::DOUBLE + y1*0.75::DOUBLE FROM i{n} WHERE n >= 3 AND x1 IS NOT NULL)"""
_G = "rect AS (SELECT least(x1, 310) - greatest(x0, 90) AS w, least(y1, 255) - greatest(y0, 60) AS h, fid FROM fx_rects)"
_C0, _C1 = _inside("s.", "s.", "90.0", "60.0", "310.0", "255.0")
_SIDES = "SELECT fid AS line_id, 1 AS pos, x0 AS ax, y0 AS ay, x1 AS bx, y0 AS by_, x1-x0 AS len, CAST(0 AS DOUBLE) AS m0 FROM fx_rects WHERE {w} UNION ALL SELECT fid, 2, x1, y0, x1, y1, y1-y0, x1-x0 FROM fx_rects WHERE {w} UNION ALL SELECT fid, 3, x1, y1, x0, y1, x1-x0, x1-x0+y1-y0 FROM fx_rects WHERE {w} UNION ALL SELECT fid, 4, x0, y1, x0, y0, y1-y0, 2*(x1-x0)+y1-y0 FROM fx_rects WHERE {w}"
_CROSS = "(({q}x-{p}x)*({r}y-{p}y)-({q}y-{p}y)*({r}x-{p}x))"

SQL = {
    "win05_simplified": f"""WITH RECURSIVE v AS (SELECT line_id, pos, x, y FROM fx_vertices), c AS (SELECT a.line_id, a.pos AS lo, b.pos AS hi, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS len FROM v a JOIN v b ON a.line_id = b.line_id AND a.pos < b.pos),
      f AS (SELECT e.line_id, e.lo, e.hi, m.pos AS far, {_D2.format(p='m', s='e')} AS d FROM c e JOIN v m ON m.line_id = e.line_id AND m.pos > e.lo AND m.pos < e.hi QUALIFY row_number() OVER (PARTITION BY e.line_id, e.lo, e.hi ORDER BY {_D2.format(p='m', s='e')} DESC, m.pos) = 1),
      s(line_id, lo, hi) AS (SELECT line_id, min(pos), max(pos) FROM v GROUP BY 1 UNION SELECT f.line_id, CASE WHEN h = 0 THEN f.lo ELSE far END, CASE WHEN h = 0 THEN far ELSE f.hi END FROM s JOIN f ON f.line_id = s.line_id AND f.lo = s.lo AND f.hi = s.hi AND f.d > 57.3*57.3, (VALUES (0), (1)) t(h))
      SELECT DISTINCT line_id, p AS pos FROM (SELECT line_id, lo AS p FROM s UNION ALL SELECT line_id, hi FROM s) z""",
    "win06_corners_cut": f"WITH c0 AS (SELECT line_id, pos, x, y FROM fx_vertices), {_CHAIKIN.format(n=1, p=0)}, {_CHAIKIN.format(n=2, p=1)} SELECT line_id, pos, round(x, 6) AS x, round(y, 6) AS y FROM c2",
    "win07_smoothed_rings": """WITH v AS (SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY line_id) AS n, x, y FROM fx_vertices), b AS (SELECT * FROM v WHERE n >= 4),
      g AS (SELECT b.line_id, b.i, b.x, b.y, sum(exp(-0.5*k*k)*c.x)/sum(exp(-0.5*k*k)) AS mx, sum(exp(-0.5*k*k)*c.y)/sum(exp(-0.5*k*k)) AS my FROM b, (SELECT unnest([-2, -1, 0, 1, 2]) AS k) o, b c WHERE c.line_id = b.line_id AND c.i = (b.i + k + b.n) % b.n GROUP BY 1, 2, 3, 4),
      m AS (SELECT *, sqrt((mx-x)*(mx-x)+(my-y)*(my-y)) AS off FROM g), s AS (SELECT line_id, i, x, y, x + CASE WHEN off > 40 THEN 40/off ELSE 1 END*(mx-x) AS sx, y + CASE WHEN off > 40 THEN 40/off ELSE 1 END*(my-y) AS sy FROM m),
      l AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny, coalesce(lead(sx) OVER w, first_value(sx) OVER w) AS nsx, coalesce(lead(sy) OVER w, first_value(sy) OVER w) AS nsy FROM s WINDOW w AS (PARTITION BY line_id ORDER BY i)),
      a AS (SELECT line_id, abs(sum(x*ny - nx*y)) AS a0, abs(sum(sx*nsy - nsx*sy)) AS a1, avg(sx) AS cx, avg(sy) AS cy FROM l GROUP BY 1)
      SELECT l.line_id, i AS pos, round(cx + coalesce(greatest(0.95, least(1.05, sqrt(a0/nullif(a1, 0)))), 1)*(sx-cx), 3) AS x, round(cy + coalesce(greatest(0.95, least(1.05, sqrt(a0/nullif(a1, 0)))), 1)*(sy-cy), 3) AS y FROM l JOIN a ON a.line_id = l.line_id""",
    "win14_downhill": f"""WITH {_STA}, dr AS (SELECT line_id, round(avg(l.dem - r.dem), 6) AS d FROM sta s JOIN fx_cells l ON l.rr = CAST(floor((y + 6*tx)/4) AS BIGINT) AND l.cc = CAST(floor((x - 6*ty)/4) AS BIGINT) JOIN fx_cells r ON r.rr = CAST(floor((y - 6*tx)/4) AS BIGINT) AND r.cc = CAST(floor((x + 6*ty)/4) AS BIGINT) WHERE source = 'topo' GROUP BY 1)
      SELECT v.line_id, CASE WHEN coalesce(d < 0, false) THEN count(*) OVER (PARTITION BY v.line_id) + 1 - pos ELSE pos END AS pos, x, y, coalesce(d < 0, false) AS turned FROM fx_vertices v LEFT JOIN dr ON dr.line_id = v.line_id WHERE source = 'topo'""",
    "win18_support_positions": "WITH n AS (SELECT DISTINCT line_id, pos FROM fx_vertices v JOIN fx_rects r ON (v.x-(x0+x1)/2)*(v.x-(x0+x1)/2)+(v.y-(y0+y1)/2)*(v.y-(y0+y1)/2) <= 64) SELECT line_id, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS places FROM n GROUP BY 1",
    "set12_clipped_lines": f"WITH {_SEG}, q AS (SELECT s.*, {_C0} AS t0, {_C1} AS t1 FROM seg s) SELECT line_id, pos, round(ax+t0*(bx-ax), 4) AS cx, round(ay+t0*(by_-ay), 4) AS cy, round(ax+t1*(bx-ax), 4) AS dx, round(ay+t1*(by_-ay), 4) AS dy FROM q WHERE t0 < t1",
    "set12_clipped_rings": f"WITH {_G} SELECT fid, round(w*h, 4) AS area FROM rect WHERE w > 0 AND h > 0 AND round(w*h, 4) > 0",
    "set13_lines_outside": _outside("SELECT * FROM seg", _kind("BUILDING")),
    "set13_lines_inside": _outside("SELECT * FROM seg", _kind("BUILDING")).split("zp AS")[0] + """zq AS (SELECT *, CASE WHEN s0 - lag(s1) OVER (PARTITION BY line_id ORDER BY s0, s1) <= 1e-6 THEN 0 ELSE 1 END AS n FROM zm),
      zr AS (SELECT *, sum(n) OVER (PARTITION BY line_id ORDER BY s0, s1 ROWS UNBOUNDED PRECEDING) AS g FROM zq) SELECT line_id, round(min(s0), 3) AS s0, round(max(s1), 3) AS s1 FROM zr GROUP BY line_id, g""",
    "jon13_steps_outside_stairs": _outside(_of("topo"), _kind("FURNITURE"), 1.0),
    "jon15_water_lines_outside": _outside(_of("dtm"), _kind("HOUSEHOLD")),
    "jon33_roads_off_bands": _outside(_of("topo"), _kind("MACHINERY", 3.0), 6.0),
    "jon40_fences_outside_buildings": _outside(_of("osm"), _kind("BUILDING", 0.5), 1.5),
    "jon52_edges_outside_buildings": _outside(_SIDES.format(w="kind = 'AUTOMOBILE'"), _kind("BUILDING")),
    "jon11_roads_in_areas": f"WITH {_SEG}, q AS (SELECT r.fid, r.x0, r.y0, r.x1, r.y1, s.len, {_T0} AS t0, {_T1} AS t1 FROM seg s JOIN fx_rects r ON s.source = 'dtm' AND r.lvl = 0 AND s.len > 0 AND least(s.ax,s.bx) <= r.x1 AND greatest(s.ax,s.bx) >= r.x0 AND least(s.ay,s.by_) <= r.y1 AND greatest(s.ay,s.by_) >= r.y0), p AS (SELECT fid, round(sum((t1-t0)*len), 3) AS length, any_value(least(x1-x0, y1-y0)) AS width FROM q WHERE t0 < t1 GROUP BY 1) SELECT fid, length, length >= 150 OR (length >= 30 AND width >= 4) AS road FROM p",
    "set20_band_cells": f"WITH {_SEG}, p AS (SELECT r.range AS rr, k.range AS cc, (r.range+0.5::DOUBLE)*4 AS y, (k.range+0.5::DOUBLE)*4 AS x FROM range(-3, 105) r, range(-3, 105) k), h AS (SELECT DISTINCT t.line_id, p.rr, p.cc FROM seg t JOIN p ON t.source = 'dtm' AND {_near('p', 't', 5.0)}) SELECT line_id, count(*) AS cells, min(rr) AS r0, max(cc) AS c1 FROM h GROUP BY 1",
    "prj02_buffered_extent": "SELECT fid FROM fx_rects WHERE 14.0::DOUBLE + (x0+x1)/2/71500.0 BETWEEN 14.002::DOUBLE - 50.0/(cos(radians((50.001::DOUBLE+50.0025::DOUBLE)/2))*111320.0) AND 14.004::DOUBLE + 50.0/(cos(radians((50.001::DOUBLE+50.0025::DOUBLE)/2))*111320.0) AND 50.0::DOUBLE + (y0+y1)/2/111320.0 BETWEEN 50.001::DOUBLE - 50.0::DOUBLE/111320.0 AND 50.0025::DOUBLE + 50.0::DOUBLE/111320.0",
    "prj14_least_lengths": f"WITH {_SEG}, l AS (SELECT line_id, sum(len) AS length FROM seg GROUP BY 1) SELECT line_id, highway, round(length, 3) AS length FROM l JOIN fx_elements ON eid = line_id WHERE length >= CASE WHEN highway = 'steps' THEN 1.0 WHEN highway IN ('footway', 'path', 'cycleway') THEN 120.0 ELSE 170.0 END * 10000 / 1000",
    "jon04_clearances": f"""WITH {_SEG}, p AS (SELECT line_id*100000 + pos AS id, x, y FROM fx_vertices WHERE source = 'topo') SELECT id FROM p WHERE NOT EXISTS (SELECT 1 FROM fx_rects r WHERE kind = 'BUILDING' AND power(greatest(x0 - p.x, p.x - x1, 0), 2) + power(greatest(y0 - p.y, p.y - y1, 0), 2) < 16)
      AND NOT EXISTS (SELECT 1 FROM fx_vertices b WHERE b.source = 'osm' AND (p.x-b.x)*(p.x-b.x)+(p.y-b.y)*(p.y-b.y) <= 25) AND NOT EXISTS (SELECT 1 FROM seg t WHERE t.source = 'dtm' AND {_near('p', 't', 3.0)})""",
    "jon05_kept_lines": f"WITH {_cover('osm', 'dtm', 0.3, 0.94)} SELECT o.line_id, count(*) AS stations, count(h.k) AS hits FROM o LEFT JOIN h ON o.line_id = h.line_id AND o.k = h.k GROUP BY 1 HAVING count(h.k) < 0.7 * count(*)",
    "jon50_kept_walls": f"WITH {_cover('topo', 'dtm', 0.2, 0.94)} SELECT o.line_id, count(h.k) AS hits FROM o LEFT JOIN h ON o.line_id = h.line_id AND o.k = h.k GROUP BY 1 HAVING count(h.k) < 0.5 * count(*)",
    "jon07_parallel_clipped": f"""WITH {_cover('osm', 'dtm', 0.3, 0.94)}, f AS (SELECT o.line_id, o.k, h.k IS NOT NULL AS hit FROM o LEFT JOIN h ON o.line_id = h.line_id AND o.k = h.k),
      g AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY k) - row_number() OVER (PARTITION BY line_id, hit ORDER BY k) AS g FROM f) SELECT line_id, min(k)*25.0::DOUBLE AS s0, max(k)*25.0::DOUBLE AS s1 FROM g WHERE NOT hit GROUP BY line_id, g HAVING count(*) >= 2""",
    "jon29_banks": f"""WITH {_STA}, o AS (SELECT * FROM sta WHERE source = 'topo'), t AS (SELECT * FROM seg WHERE source = 'topo' AND len > 0), n AS (SELECT line_id, count(*) AS stations FROM o GROUP BY 1), tl AS (SELECT line_id, round(sum(len), 6) AS total FROM seg WHERE source = 'topo' GROUP BY 1),
      h AS (SELECT DISTINCT o.line_id, o.k, t.line_id AS by_line FROM o JOIN t ON {_near('o', 't', 6.0)}), c AS (SELECT h.line_id, by_line, count(*) AS hits FROM h WHERE h.line_id <> by_line GROUP BY 1, 2),
      b AS (SELECT c.line_id FROM c JOIN n ON n.line_id = c.line_id JOIN tl x ON x.line_id = c.line_id JOIN tl y ON y.line_id = c.by_line WHERE hits >= 0.3 * stations AND x.total < y.total) SELECT line_id, stations FROM n WHERE line_id NOT IN (SELECT line_id FROM b)""",
    "jon18_widths": f"""WITH {_STA}, s AS (SELECT line_id, k, x - 20*ty AS ax, y + 20*tx AS ay, x + 20*ty AS bx, y - 20*tx AS by_ FROM sta WHERE source = 'dtm'),
      i AS (SELECT line_id, k, t0*40 AS s0, t1*40 AS s1 FROM (SELECT s.line_id, s.k, {_T0} AS t0, {_T1} AS t1 FROM s JOIN fx_rects r ON r.kind <> 'BUILDING' AND least(s.ax,s.bx) <= r.x1 AND greatest(s.ax,s.bx) >= r.x0 AND least(s.ay,s.by_) <= r.y1 AND greatest(s.ay,s.by_) >= r.y0) q WHERE t0 < t1),
      n AS (SELECT *, CASE WHEN s0 <= max(s1) OVER (PARTITION BY line_id, k ORDER BY s0, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM i), g AS (SELECT *, sum(n) OVER (PARTITION BY line_id, k ORDER BY s0, s1 ROWS UNBOUNDED PRECEDING) AS g FROM n),
      m AS (SELECT line_id, k, min(s0) AS s0, max(s1) AS s1 FROM g GROUP BY line_id, k, g) SELECT line_id, count(*) AS stations, round(quantile_cont(s1 - s0, 0.5), 3) AS width FROM m WHERE s0 <= 20 AND s1 >= 20 GROUP BY 1""",
    "jon34_ends_to_bands": f"WITH {_SEG}, p AS (SELECT line_id, x, y FROM fx_vertices WHERE source = 'topo' QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY pos DESC) = 1) SELECT p.line_id, round(sqrt(min({_D2.format(p='p', s='t')})), 4) AS distance FROM p JOIN seg t ON t.source = 'dtm' AND {_near('p', 't', 15.0)} GROUP BY 1",
    "jon32_confirmed": f"""WITH {_STA}, o AS (SELECT * FROM sta WHERE source = 'osm'), e AS (SELECT o.line_id, o.k, CASE WHEN EXISTS (SELECT 1 FROM fx_rects r WHERE r.lvl = 1 AND o.x >= r.x0 AND o.x < r.x1 AND o.y >= r.y0 AND o.y < r.y1) THEN 1 WHEN c.chm < 12 THEN 1 ELSE 0 END AS v FROM o LEFT JOIN fx_cells c ON c.rr = CAST(floor(o.y/4) AS BIGINT) AND c.cc = CAST(floor(o.x/4) AS BIGINT)),
      w AS (SELECT line_id, k, avg(v) OVER (PARTITION BY line_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) >= 0.6 AS f FROM e), g AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY k) - row_number() OVER (PARTITION BY line_id, f ORDER BY k) AS g FROM w)
      SELECT line_id, min(k)*25.0::DOUBLE AS s0, max(k)*25.0::DOUBLE AS s1 FROM g WHERE f GROUP BY line_id, g HAVING (max(k) - min(k))*25 >= 50""",
    "jon41_row_support": f"WITH {_STA}, o AS (SELECT line_id, k, (SELECT max(CASE WHEN r.kind = 'HOUSEHOLD' THEN 1 ELSE 0 END) FROM fx_rects r WHERE sta.x >= r.x0 AND sta.x < r.x1 AND sta.y >= r.y0 AND sta.y < r.y1) AS g FROM sta WHERE source = 'topo') SELECT line_id, round(avg(coalesce(g, 0)), 5) AS green, round(avg(CASE WHEN g IS NULL THEN 1 ELSE 0 END), 5) AS nothing FROM o GROUP BY 1",
    "jon42_row_crowns": f"""WITH {_SEG}, tp AS (SELECT c.rr, c.cc, c.dsm, c.dem, max(n.dsm) AS top FROM fx_dense c JOIN fx_dense n ON n.rr BETWEEN c.rr - 2 AND c.rr + 2 AND n.cc BETWEEN c.cc - 2 AND c.cc + 2 GROUP BY 1, 2, 3, 4), p AS (SELECT rr*1000 + cc AS peak, (cc+0.5::DOUBLE)*4 AS x, (rr+0.5::DOUBLE)*4 AS y FROM tp WHERE dsm = top AND dsm - dem >= 5),
      b AS (SELECT t.line_id, p.peak, round(min(t.m0 + greatest(0, least(t.len, ((p.x-t.ax)*(t.bx-t.ax)+(p.y-t.ay)*(t.by_-t.ay))/t.len))), 4) AS m FROM p JOIN seg t ON t.source = 'topo' AND t.len > 0 AND {_near('p', 't', 4.0)} GROUP BY 1, 2) SELECT line_id, peak, m, row_number() OVER (PARTITION BY line_id ORDER BY m, peak) AS nth FROM b""",
    "jon43_bridge_crossings": f"""WITH {_SEG}, k AS (SELECT seg.*, cls FROM seg JOIN fx_vertices v ON v.line_id = seg.line_id AND v.pos = seg.pos) SELECT a.line_id AS a_id, count(*) AS crossings, count(DISTINCT b.line_id) AS lines FROM k a JOIN k b ON a.cls = '1-URGENT' AND b.cls = '5-LOW'
      AND ((a.bx-a.ax)*(b.ay-a.ay)-(a.by_-a.ay)*(b.ax-a.ax)) * ((a.bx-a.ax)*(b.by_-a.ay)-(a.by_-a.ay)*(b.bx-a.ax)) < 0 AND ((b.bx-b.ax)*(a.ay-b.ay)-(b.by_-b.ay)*(a.ax-b.ax)) * ((b.bx-b.ax)*(a.by_-b.ay)-(b.by_-b.ay)*(a.bx-b.ax)) < 0 GROUP BY 1""",
    "jon30_opposite_lanes": f"""WITH {_SEG}, k AS (SELECT seg.line_id, seg.pos, cls, (ax+bx)/2 AS x, (ay+by_)/2 AS y, (bx-ax)/len AS ux, (by_-ay)/len AS uy FROM seg JOIN fx_vertices v ON v.line_id = seg.line_id AND v.pos = seg.pos WHERE len > 0)
      SELECT a.line_id AS a_line, a.pos AS a_pos, b.line_id AS b_line, b.pos AS b_pos, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), 4) AS distance FROM k a JOIN k b ON a.cls = b.cls AND a.line_id < b.line_id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 100 AND a.ux*b.ux + a.uy*b.uy <= -0.8660254""",
    "jon39_fences_at_borders": f"""WITH {_SEG}, st AS (SELECT line_id, pos, unnest([0, 1, 2]) AS k, unnest([0.05::DOUBLE, 0.5::DOUBLE, 0.95::DOUBLE]) AS t, ax, ay, bx, by_ FROM seg WHERE source = 'osm' AND len > 0), p AS (SELECT line_id, pos, k, ax + t*(bx-ax) AS x, ay + t*(by_-ay) AS y FROM st),
      b AS ({_SIDES.format(w="kind = 'FURNITURE'")}), h AS (SELECT DISTINCT p.line_id, p.pos, p.k FROM p JOIN b t ON {_near('p', 't', 6.0)}) SELECT line_id, pos FROM h GROUP BY 1, 2 HAVING count(*) = 3""",
    "jon26_dense_contours": f"WITH {_STA}, " + "{grad}" + " SELECT line_id, count(*) AS stations, CAST(sum(CASE WHEN sqrt(gx*gx+gy*gy) > 5/10.0 THEN 1 ELSE 0 END) AS BIGINT) AS dense FROM sta s JOIN g ON g.rr = CAST(floor(s.y/4) AS BIGINT) AND g.cc = CAST(floor(s.x/4) AS BIGINT) WHERE s.source = 'topo' GROUP BY 1 HAVING sum(CASE WHEN sqrt(gx*gx+gy*gy) > 5/10.0 THEN 1 ELSE 0 END) >= 0.3 * count(*)",
    "jon20_parking_reach": f"""WITH {_STA}, p AS (SELECT line_id, k, side, step, x - side*(4.0::DOUBLE+2.0::DOUBLE*step)*ty AS x, y + side*(4.0::DOUBLE+2.0::DOUBLE*step)*tx AS y FROM sta, (SELECT unnest([-1, 1]) AS side) sd, (SELECT CAST(unnest(range(0, 8)) AS INTEGER) AS step) st WHERE source = 'dtm'),
      h AS (SELECT DISTINCT line_id, k, side, step FROM p JOIN fx_rects r ON r.kind = 'AUTOMOBILE' AND p.x >= r.x0 AND p.x < r.x1 AND p.y >= r.y0 AND p.y < r.y1), n AS (SELECT *, row_number() OVER (PARTITION BY line_id, k, side ORDER BY step) - 1 AS nth FROM h) SELECT line_id, k, side, max(step)*2.0::DOUBLE + 4.0::DOUBLE AS reach FROM n WHERE nth = step GROUP BY 1, 2, 3""",
}


def _with_gradient() -> None:
    from geoloom.plans.raster import _GRAD

    SQL["jon26_dense_contours"] = SQL["jon26_dense_contours"].replace("{grad}", _GRAD)


_with_gradient()
QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("jon", "win", "set", "prj")) and callable(f)}
