"""Queries on tags, texts, times and functions of geometry; retention, change detection and whole reports."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.functions import geometry, times
from geoloom.operators import grid, ops, sequence
from geoloom.operators import spatial_join as J
from geoloom.plans.spatial import _SEG, _STA
from geoloom.sources import tables as T
from geoloom.sources.store import written

# Which class of which map becomes which of the library's kinds, and the least size that counts.
MAPPING = (
    ("dtm", "1-URGENT", "road", 0.0), ("dtm", "2-HIGH", "sidewalk", 20.0), ("dtm", "3-MEDIUM", "building", 0.0),
    ("osm", "1-URGENT", "road", 30.0), ("osm", "2-HIGH", "road", 0.0), ("osm", "5-LOW", "path", 50.0),
    ("topo", "1-URGENT", "cliff", 100.0), ("topo", "4-NOT SPECIFIED", "water", 0.0),
)
PAVED = ("asphalt", "paved", "concrete")


def prj04_abroad_classes(spark, d):
    """Classes of ways where a country has its own substitutes, which come before the common rules."""
    e = T.elements(spark, d).withColumn("country", (F.col("eid") % 4).cast("long"))
    abroad = F.col("country") > 0
    common = F.when(F.col("highway") == "steps", "stairs").when(F.col("highway").isin("footway", "path"), "path").otherwise("way")
    kind = F.when(abroad & (F.col("highway") == "track") & (F.col("surface") == "gravel"), "forest_road").when(abroad & (F.col("highway") == "cycleway"), "path").otherwise(common)
    return e.select("eid", "country", kind.alias("kind"))


def prj16_exclusions(spark, d):
    """Features that the rules leave out, with the reason: below ground, covered, closed, or not paved where that is asked for."""
    e = T.elements(spark, d).withColumn("layer", (F.col("eid") % 5 - 1).cast("long")).withColumn("covered", F.col("eid") % 11 == 0).withColumn("access", F.when(F.col("eid") % 7 == 0, "private"))
    reason = (
        F.when(F.col("layer") < 0, "underground").when(F.col("covered"), "covered").when((F.col("highway") == "service") & (F.col("access") == "private"), "closed")
        .when((F.col("highway") == "cycleway") & ~F.coalesce(F.col("surface").isin(*PAVED), F.lit(False)), "unpaved")
    )
    return e.select("eid", reason.alias("reason")).where("reason is not null")


def _mapped(spark, d):
    dim = spark.createDataFrame(MAPPING, "source string, cls string, target string, least double")
    seg = sequence.segments(T.vertices(spark, d))
    return seg.join(F.broadcast(dim), ["source", "cls"])  # a fixed table of a few rules


def prj18_national_classes(spark, d):
    """Classes of national maps as common ones, with what is too short left out."""
    m = _mapped(spark, d).where("len >= least")
    return m.groupBy("source", "cls", "target").agg(F.count("*").alias("n"), F.round(F.sum("len"), 2).alias("length"))


def prj19_topographic_filter(spark, d):
    """Lines of the topographic map that a rule knows, cliffs only from their least length on, and why the rest went."""
    dim = spark.createDataFrame([r[1:] for r in MAPPING if r[0] == "topo"], "cls string, target string, least double")
    seg = sequence.segments(T.vertices(spark, d)).where("source = 'topo'").join(F.broadcast(dim), "cls", "left")
    status = F.when(F.col("target").isNull(), "unknown class").when(F.col("len") < F.col("least"), "too short").otherwise("kept")
    return seg.groupBy("cls", status.alias("status")).agg(F.count("*").alias("n"))


def prj23_merged_recipes(spark, d):
    """Points of two deliveries: each keeps its classes, one renumbers them, and both are one cloud."""
    p = T.points(spark, d)
    a = p.where("l_suppkey % 2 = 0 and cls in (2, 5)").select("x", "y", "z", "cls")
    b = p.where("l_suppkey % 2 = 1 and cls <> 5").select("x", "y", "z", F.when(F.col("cls") == 3, 5).otherwise(F.col("cls")).alias("cls"))
    return a.unionByName(b).groupBy("cls").agg(F.count("*").alias("n"), F.round(F.avg("z"), 5).alias("mean_z"))


def prj26_valid_fences(spark, d):
    """Fences above ground of a known origin; those of unknown origin only if both ends lie in private areas."""
    seg = sequence.segments(T.vertices(spark, d)).where("source <> 'dtm'")
    own = T.rects(spark, d).where("kind = 'HOUSEHOLD'").select("x0", "y0", "x1", "y1")
    at = seg.select("line_id", "pos", F.explode(F.array(F.struct(F.lit(0).alias("e"), F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.lit(1).alias("e"), F.col("bx").alias("x"), F.col("by").alias("y")))).alias("p")).select("line_id", "pos", "p.*")
    private = J.inside(at, own).groupBy("line_id", "pos").agg(F.count("*").alias("ends"))
    level = F.col("line_id") % 3 - 1
    return seg.join(private, ["line_id", "pos"], "left").where(level >= 0).where((F.col("cls") != "4-NOT SPECIFIED") | (F.coalesce("ends", F.lit(0)) == 2)).select("line_id", "pos")


def agg25_layer_summary(spark, d):
    """What was written by layer, and the sentence for the job's report."""
    r = T.rects(spark, d).groupBy(F.col("kind").alias("layer")).agg(F.count("*").alias("n"))
    text = F.when(F.col("n") == 0, "nothing").when(F.col("n") < 30, F.concat(F.lit("few: "), F.col("n").cast("string"))).otherwise(F.concat(F.lit("written: "), F.col("n").cast("string")))
    return r.select("layer", "n", text.alias("text"))


def win02_stations_with_ends(spark, d):
    """Stations each 25 m and the end of every line."""
    seg = sequence.segments(T.vertices(spark, d))
    st = sequence.stations(seg, 25.0).select("line_id", "m", "x", "y")
    end = seg.groupBy("line_id").agg(F.max(F.col("m0") + F.col("len")).alias("m"), F.max_by(F.struct("bx", "by"), "pos").alias("p")).select("line_id", "m", F.col("p.bx").alias("x"), F.col("p.by").alias("y"))
    return st.unionByName(end).select("line_id", *(F.round(c, 3).alias(c) for c in ("m", "x", "y")))


def win03_tangents(spark, d):
    """Tangent and normal at each vertex, from its neighbours on the line."""
    w = Window.partitionBy("line_id").orderBy("pos")
    near = lambda f, c: F.coalesce(f(c).over(w), F.col(c))
    v = T.vertices(spark, d).select("line_id", "pos", (near(F.lead, "x") - near(F.lag, "x")).alias("dx"), (near(F.lead, "y") - near(F.lag, "y")).alias("dy"))
    n = F.nullif(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), F.lit(0.0))
    return v.select("line_id", "pos", F.round(F.col("dx") / n, 5).alias("tx"), F.round(F.col("dy") / n, 5).alias("ty"), F.round(-F.col("dy") / n, 5).alias("nx"), F.round(F.col("dx") / n, 5).alias("ny"))


def win10_generalised_flags(spark, d):
    """Flags with hysteresis, where unknown vertices take what lies on both sides if that agrees, and runs of fewer than 2 go."""
    v = T.vertices(spark, d)
    w = Window.partitionBy("line_id").orderBy("pos")
    flag = F.when(F.col("y") > 380, F.lit(None).cast("boolean")).otherwise((F.col("x") >= 150))
    back = F.last("f", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("f", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    full = v.withColumn("f", flag).select("line_id", "pos", F.coalesce("f", F.when(back == ahead, back), F.lit(False)).alias("on"))
    return sequence.runs(full, ["line_id"], ["pos"], "on").where("on and n >= 2").select("line_id", F.col("first").alias("s0"), F.col("last").alias("s1"), "n")


def win11_outward_walk(spark, d):
    """How far a walk along each line gets before three stations in a row are open ground."""
    open_cells = grid.surfaces(T.points(spark, d), T.CELL_M).select("rr", "cc", (F.col("chm") < 20).alias("open"))
    st = grid.with_cell(sequence.stations(sequence.segments(T.vertices(spark, d)), 25.0), 4.0).join(open_cells, ["rr", "cc"], "left").withColumn("open", F.coalesce("open", F.lit(True)))
    blocked = sequence.runs(st, ["line_id"], ["k"], "open").where("open and n >= 3").groupBy("line_id").agg(F.min("first").alias("stop"))
    every = st.groupBy("line_id").agg(F.max("k").alias("last"))
    return every.join(blocked, "line_id", "left").select("line_id", (F.coalesce("stop", F.col("last") + 1) * 25.0).alias("reach"))


def win21_time_until_free(spark, d):
    """For each event, the seconds until its user may act again: the third event of the last day leaves the window."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = T.table(spark, d, "events").select("event_id", "user_id", "ts").withColumn("third", F.lag("ts", 2).over(w))
    wait = times.seconds("third") + 86400 - times.seconds("ts")
    return e.select("event_id", F.greatest(F.lit(0), F.coalesce(wait, F.lit(0))).cast("long").alias("wait"))


def win23_deviations(spark, d):
    """Figures of a month that leave their limits against the country's mean, without those that are accepted."""
    per = T.jobs(spark, d).groupBy("country_no", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.avg("build_seconds").alias("seconds"), F.count("*").alias("jobs"))
    mean = per.groupBy("country_no").agg(F.avg("seconds").alias("usual"))
    rules = spark.createDataFrame([("ratio", 0.9, 1.1), ("jobs", 20.0, 60.0)], "rule string, low double, high double")
    value = F.when(F.col("rule") == "ratio", F.col("seconds") / F.col("usual")).otherwise(F.col("jobs").cast("double"))
    found = per.join(mean, "country_no").join(F.broadcast(rules), F.lit(True)).withColumn("value", value).where("value < low or value > high")  # two rules
    accepted = spark.createDataFrame([(0, "ratio"), (1, "jobs")], "country_no long, rule string")
    return found.join(F.broadcast(accepted), ["country_no", "rule"], "left_anti").select("country_no", "month", "rule", F.round("value", 5).alias("value"))


def str04_retention(spark, d):
    """Events of the last 20 days of the log; what is older goes."""
    e = T.table(spark, d, "events")
    last = e.agg(F.max("ts").alias("now"))
    kept = e.join(F.broadcast(last), F.lit(True)).where(times.seconds("ts") >= times.seconds("now") - 20 * 86400)  # one row
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def str08_log_tail(spark, d):
    """Log lines after each job's second, as steps with their number and the text's beginning."""
    w = Window.partitionBy("job_id").orderBy("line_no")
    tail = T.log_lines(spark, d).where("line_no > 1")
    return tail.select("job_id", "line_no", F.row_number().over(w).alias("step"), F.substring("line", 1, 12).alias("begins"))


def str09_changed_inputs(spark, d):
    """Pages against an earlier state of the same table: new, changed, or the same, by fingerprint."""
    now = T.table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("print"))
    before = now.where("page_id % 10 <> 3").select("page_id", F.when(F.col("page_id") % 7 == 1, F.lit("old")).otherwise(F.col("print")).alias("was"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("was") != F.col("print"), "changed").otherwise("same")
    return now.join(before, "page_id", "left").select("page_id", status.alias("status"))


def str06_counted_once(spark, d):
    """Usage by day where an event told twice counts once."""
    e = T.table(spark, d, "events")
    told = e.unionByName(e.where("event_id % 3 = 0"))
    return told.dropDuplicates(["event_id"]).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("events"), F.round(F.sum("value"), 3).alias("value"))


def str03_digests(spark, d):
    """One digest a day, for days with failures: sources and failures."""
    p = T.probes(spark, d).where("not ok")
    return p.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.countDistinct("source_key").alias("sources"), F.count("*").alias("failures"), F.max("code").alias("worst"))


def str02_alerts_once(spark, d):
    """An alert for each outage of an hour and more, once; a recovery only for those."""
    spans = ops.outage_spans(T.probes(spark, d)).withColumn("seconds", times.seconds("last_down") - times.seconds("down_since")).where("seconds >= 3600")
    kinds = F.explode(F.array(F.lit("alert"), F.when(F.col("up_at").isNotNull(), F.lit("recovery")))).alias("kind")
    return spans.select("source_key", "outage", "seconds", kinds).where("kind is not null")


def str07_chunked_grid(spark, d):
    """Points summed chunk by chunk and then together: the same cells as in one go."""
    keyed = grid.with_cell(T.points(spark, d), 10.0).withColumn("chunk", F.col("l_orderkey") % 16)
    part = keyed.groupBy("chunk", "rr", "cc").agg(F.count("*").alias("n"), F.sum("z").alias("z"), F.max("z").alias("top"))
    return part.groupBy("rr", "cc").agg(F.sum("n").alias("n"), F.round(F.sum("z") / F.sum("n"), 6).alias("mean_z"), F.max("top").alias("top"))


def str11_late_rows(spark, d):
    """Probes in the order of their times, duplicates dropped, and those that came more than a day late marked."""
    p = T.probes(spark, d)
    told = p.unionByName(p.where("event_id % 5 = 0")).dropDuplicates(["event_id"])
    seen = F.max(times.seconds("ts")).over(Window.partitionBy("source_key").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    return told.withColumn("late", F.coalesce(seen - times.seconds("ts") > 86400, F.lit(False))).groupBy("source_key").agg(F.count("*").alias("n"), F.sum(F.col("late").cast("long")).alias("late"))


def _lonlat(spark, d):
    return T.vertices(spark, d).select("line_id", "pos", (F.lit(15.0) + (F.col("x") - 200) / 100).alias("lon"), (F.lit(48.0) + (F.col("y") - 200) / 100).alias("lat"))


def fun01_projected(spark, d):
    """Longitude and latitude in Web Mercator and UTM zone 33."""
    v = _lonlat(spark, d)
    mx, my = geometry.web_mercator(F.col("lon"), F.col("lat"))
    ux, uy = geometry.utm(F.col("lon"), F.col("lat"), 33)
    return v.select("line_id", "pos", *(F.round(c, 2).alias(n) for c, n in ((mx, "mx"), (my, "my"), (ux, "ux"), (uy, "uy"))))


def fun02_map_coordinates(spark, d):
    """Projected coordinates on the map: about a reference point, at 1 : 10 000, turned by the grivation; and back."""
    x, y = F.col("x") - 200.0, F.col("y") - 200.0
    mx, my = geometry.rotated(x, y, 4.5, 0.1)
    bx, by = geometry.rotated(mx, my, -4.5, 10.0)
    return T.vertices(spark, d).select("line_id", "pos", F.round(mx, 5).alias("mx"), F.round(my, 5).alias("my"), F.round(bx + 200.0, 5).alias("x"), F.round(by + 200.0, 5).alias("y"))


def fun04_extent_sizes(spark, d):
    """Area and sides of extents in degrees, in km2 and km."""
    r = T.rects(spark, d).select("fid", *((F.lit(b) + F.col(c) / 1000).alias(n) for c, b, n in (("x0", 14.0, "w"), ("x1", 14.0, "e"), ("y0", 50.0, "s"), ("y1", 50.0, "n"))))
    width = (F.col("e") - F.col("w")) * 111.32 * F.cos(F.radians((F.col("s") + F.col("n")) / 2))
    height = (F.col("n") - F.col("s")) * 111.32
    return r.select("fid", F.round(width, 5).alias("width"), F.round(height, 5).alias("height"), F.round(width * height, 5).alias("area"))


def fun05_point_to_segment(spark, d):
    """Distance of the middle of the map from each segment, and whether the segment meets the diagonal."""
    seg = sequence.segments(T.vertices(spark, d))
    dist = F.sqrt(J.segment_distance2(F.lit(200.0), F.lit(200.0), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    return seg.select("line_id", "pos", F.round(dist, 4).alias("distance"), ((F.col("ax") - F.col("ay")) * (F.col("bx") - F.col("by")) < 0).alias("crosses"))


def fun07_guards(spark, d):
    """Smooth step, clipping and a ratio that survives zero."""
    e = T.table(spark, d, "events")
    return e.select("event_id", F.round(geometry.smoothstep(F.col("value"), 20.0, 70.0), 6).alias("step"), F.greatest(F.lit(10.0), F.least(F.lit(60.0), F.col("value"))).alias("clipped"), F.round(F.col("value") / F.nullif((F.col("user_id") % 3).cast("double"), F.lit(0.0)), 6).alias("ratio"))


def fun08_quantiles(spark, d):
    """Quantiles with linear interpolation by kind."""
    q = lambda p: F.round(F.expr(f"percentile(value, {p})"), 6).alias(f"q{int(p * 100)}")
    return T.table(spark, d, "events").groupBy("event_type").agg(q(0.1), q(0.5), q(0.95))


def fun09_paper_sizes(spark, d):
    """Sides of areas in millimetres of a map at 1 : 4 000, and half a millimetre in metres."""
    mm = lambda a, b: F.round((F.col(a) - F.col(b)) / 4.0, 5)
    return T.rects(spark, d).select("fid", mm("x1", "x0").alias("width_mm"), mm("y1", "y0").alias("height_mm"), geometry.metres(0.5, 4000).alias("half_mm"))


def fun10_image_figures(spark, d):
    """Excess green, luminance, vegetation index and hue of pixels."""
    from geoloom.operators.terrain import hsv

    e = lambda k: 1 / (1 + F.exp(-F.col("embedding")[k].cast("double") * 4))
    c = T.table(spark, d, "embeddings").select("vec_id", e(0).alias("r"), e(1).alias("g"), e(2).alias("b"), e(3).alias("nir"))
    hue, sat, val = hsv(F.col("r"), F.col("g"), F.col("b"))
    lum = 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    ndvi = (F.col("nir") - F.col("r")) / F.nullif(F.col("nir") + F.col("r"), F.lit(0.0))
    return c.select("vec_id", *(F.round(x, 5).alias(n) for x, n in ((geometry.excess_green(F.col("r"), F.col("g"), F.col("b")), "exg"), (lum, "luminance"), (ndvi, "ndvi"), (sat, "saturation"), (val, "value"))))


def fun12_tag_texts(spark, d):
    """Tags in lower case without outer blanks, lists split at semicolons, numbers with a comma read, codes split."""
    t = T.table(spark, d, "part").select("p_partkey", F.concat(F.lit("  "), F.upper("p_brand"), F.lit(";"), F.col("p_type"), F.lit(" ; ")).alias("tag"), F.concat(F.col("p_size").cast("string"), F.lit(","), (F.col("p_partkey") % 10).cast("string"), F.lit(" m")).alias("width"), F.concat(F.lit("5"), F.lpad((F.col("p_partkey") % 40).cast("string"), 2, "0"), F.lit("."), (F.col("p_size") % 3).cast("string")).alias("code"))
    parts = F.filter(F.transform(F.split("tag", ";"), lambda s: F.lower(F.trim(s))), lambda s: s != "")
    number = F.expr("try_cast(replace(regexp_extract(width, '^[0-9]+,?[0-9]*', 0), ',', '.') as double)")
    return t.select("p_partkey", F.array_join(parts, "|").alias("values"), F.size(parts).alias("n"), number.alias("width"), F.split("code", r"\.")[0].alias("symbol"), F.split("code", r"\.")[1].cast("int").alias("variant"))


def fun13_tile_names(spark, d):
    """Name of the 100 m tile with letters for the column, and the bounds that the name gives back."""
    v = T.vertices(spark, d).select("line_id", "pos", F.floor(F.col("x") / 100).cast("int").alias("tx"), F.floor(F.col("y") / 100).cast("int").alias("ty"))
    name = F.concat(F.char(F.col("tx") + 65), F.lpad(F.col("ty").cast("string"), 2, "0"))
    back = v.withColumn("name", name)
    return back.select("line_id", "pos", "name", ((F.ascii("name") - 65) * 100.0).alias("west"), (F.substring("name", 2, 2).cast("int") * 100.0).alias("south"))


def fun15_normal_addresses(spark, d):
    """Mail addresses without alias and dots, their keyed tag, and the network of an address."""
    c = T.table(spark, d, "customer").select("c_custkey", F.concat(F.regexp_replace("c_name", "#", "."), F.lit("+news"), (F.col("c_custkey") % 3).cast("string"), F.lit("@Mail.Example")).alias("mail"), F.concat_ws(".", F.lit("10"), (F.col("c_custkey") % 200).cast("string"), (F.col("c_custkey") % 7).cast("string"), (F.col("c_custkey") % 250).cast("string")).alias("ip"))
    local = F.replace(F.regexp_replace(F.lower(F.substring_index("mail", "@", 1)), r"\+.*$", ""), F.lit("."), F.lit(""))
    mail = F.concat(local, F.lit("@"), F.lower(F.substring_index("mail", "@", -1)))
    return c.select("c_custkey", mail.alias("mail"), F.sha2(F.concat(F.lit("key:"), mail), 256).alias("tag"), F.concat(F.substring_index("ip", ".", 3), F.lit(".0/24")).alias("network"))


def fun17_times(spark, d):
    """Day, age in days, five-day slot and the text of a duration."""
    e = T.table(spark, d, "events")
    now = F.to_date(F.lit("2024-03-01"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    secs = F.col("event_id") * 37 % 9000
    return e.select("event_id", iso.alias("iso"), times.age_days(F.to_timestamp_ntz(iso, F.lit("yyyy-MM-dd'T'HH:mm:ss")), now).cast("long").alias("age"), times.slot(F.col("ts"), "2024-01-01", 5).cast("long").alias("slot"), times.duration_text(secs).alias("duration"))


def fun18_rings(spark, d):
    """Rings closed, turned round and as pairs of neighbours."""
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"))
    closed = F.concat(ring, F.slice(ring, 1, 1))
    turned = F.reverse(closed)
    pairs = F.zip_with(F.slice(closed, 1, 4), F.slice(closed, 2, 4), lambda a, b: F.abs(b["x"] - a["x"]) + F.abs(b["y"] - a["y"]))
    return T.rects(spark, d).select("fid", F.size(closed).alias("points"), F.round(geometry.ring_area(ring), 3).alias("area"), F.round(geometry.ring_area(turned), 3).alias("turned"), F.array_join(F.transform(pairs, lambda v: F.format_string("%.1f", v)), ";").alias("sides"))


def fun19_geojson(spark, d):
    """Areas as GeoJSON features and back to rows."""
    r = T.rects(spark, d)
    num = lambda c: F.format_string("%.1f", F.col(c))
    at = lambda a, b: F.concat(F.lit("["), num(a), F.lit(","), num(b), F.lit("]"))
    ring = F.concat_ws(",", at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1"), at("x0", "y0"))
    doc = F.concat(F.lit('{"type":"Feature","properties":{"kind":"'), F.col("kind"), F.lit('","level":'), F.col("lvl").cast("string"), F.lit('},"geometry":{"type":"Polygon","coordinates":[['), ring, F.lit("]]}}"))
    shape = "struct<properties:struct<kind:string,level:int>,geometry:struct<coordinates:array<array<array<double>>>>>"
    read = r.select("fid", doc.alias("doc")).withColumn("f", F.from_json("doc", shape))
    points = F.col("f.geometry.coordinates")[0]
    return read.select("fid", "doc", F.col("f.properties.kind").alias("kind"), F.col("f.properties.level").alias("level"), F.size(points).alias("points"), points[2][0].alias("x1"), points[2][1].alias("y1"))


def udf01_sampled_predicates(spark, d):
    """Elevation and cover at the stations of lines, as joins in place of callbacks."""
    st = sequence.stations(written(sequence.segments(T.vertices(spark, d)).where("source = 'topo'")), 25.0).select("line_id", "x", "y")
    dem = written(grid.surfaces(T.points(spark, d), T.CELL_M).select("rr", "cc", "dem"))
    # a station's first hit answers, however many areas lie over it
    zone = J.inside(st, T.rects(spark, d).where("lvl = 1")).groupBy("line_id").agg(F.count("*").alias("zone"))
    seen = grid.with_cell(st, 4.0).join(dem, ["rr", "cc"], "left").groupBy("line_id").agg(F.count("*").alias("stations"), F.count("dem").alias("with_ground"), F.round(F.avg("dem"), 5).alias("mean_dem"))
    return seen.join(zone, "line_id", "left").select("line_id", "stations", "with_ground", "mean_dem", F.coalesce("zone", F.lit(0)).alias("in_zone"))


def udf02_merged_parts(spark, d):
    """Counts, sums and extremes kept by part and merged."""
    part = T.table(spark, d, "events").groupBy("event_type", (F.col("event_id") % 8).alias("part")).agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.min("value").alias("low"), F.max("value").alias("high"))
    return part.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"))


def udf03_ring_edges(spark, d):
    """Each area as its four edges."""
    side = lambda n, a, b, c, e: F.struct(F.lit(n).alias("side"), F.col(a).alias("ax"), F.col(b).alias("ay"), F.col(c).alias("bx"), F.col(e).alias("by"))
    sides = F.array(side(1, "x0", "y0", "x1", "y0"), side(2, "x1", "y0", "x1", "y1"), side(3, "x1", "y1", "x0", "y1"), side(4, "x0", "y1", "x0", "y0"))
    return T.rects(spark, d).select("fid", F.explode(sides).alias("s")).select("fid", "s.*")


def udf05_fitted_times(spark, d):
    """A line fitted to build time over the estimate by country, and what each job is off by."""
    j = T.jobs(spark, d).withColumn("est", (F.col("est_prep_min") + F.col("est_maps_min")).cast("double"))
    fit = j.groupBy("country_no").agg(F.regr_slope("build_seconds", "est").alias("a"), F.regr_intercept("build_seconds", "est").alias("b"))
    return j.join(fit, "country_no").select("job_id", F.round(F.col("build_seconds") - F.col("a") * F.col("est") - F.col("b"), 4).alias("off"))


def pip18_feasibility(spark, d):
    """Each extent: the level that covers most of it, the share of its cells with points, the estimate in minutes, and whether a map can be made."""
    from geoloom.operators import cellsets

    r = T.rects(spark, d)
    ext = r.where("kind = 'BUILDING'")
    by_level = J.shape_overlaps(ext, r.where("kind <> 'BUILDING'"), "lvl").groupBy(*J.BOX, "lvl").agg(F.round(F.sum(F.col("common") * F.col("n")), 4).alias("common"))
    best = ext.select("fid", *J.BOX).join(by_level.groupBy(*J.BOX).agg(F.max_by("lvl", F.struct("common", "lvl")).alias("country")), list(J.BOX)).select("fid", "country")
    have = grid.surfaces(T.points(spark, d).where("cls = 2"), T.CELL_M).select("rr", "cc", F.lit(1).alias("has"))
    cover = cellsets.box_cells(ext, T.CELL_M, "fid").join(have, ["rr", "cc"], "left").groupBy("fid").agg(F.count("*").alias("cells"), F.count("has").alias("covered"))
    share = F.col("covered") / F.nullif("cells", F.lit(0))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    minutes = 3.5 + area / 100.0
    status = F.when(F.col("country").isNull(), "no country").when(share < 0.2, "no coverage").when(share < 0.6, "partial").otherwise("good")
    return ext.join(best, "fid", "left").join(cover, "fid", "left").select("fid", "country", F.round(share, 5).alias("share"), F.round(minutes, 4).alias("minutes"), status.alias("status"))


def pip19_usage_report(spark, d):
    """Jobs by country: finished, failed, users, mean minutes, error of the estimate, share of all."""
    j = T.jobs(spark, d)
    done = F.col("status") != "failed"
    per = j.groupBy("country_no").agg(F.count("*").alias("jobs"), F.sum(done.cast("long")).alias("done"), F.countDistinct("ip_tag").alias("users"), F.round(F.avg(F.when(done, F.col("build_seconds") / 60)), 5).alias("minutes"), F.round(F.avg(F.when(done, F.col("build_seconds") / 60 / (F.col("est_prep_min") + F.col("est_maps_min")))), 5).alias("ratio"))
    total = per.agg(F.sum("jobs").alias("total"))
    return per.join(F.broadcast(total), F.lit(True)).select("country_no", "jobs", "done", "users", "minutes", "ratio", F.round(F.col("jobs") / F.col("total"), 6).alias("share"))  # one row


def pip20_reliability(spark, d):
    """Sources: probes, failures, outages, longest outage, and availability."""
    p = T.probes(spark, d)
    spans = ops.outage_spans(p).withColumn("seconds", times.seconds("last_down") - times.seconds("down_since"))
    worst = spans.groupBy("source_key").agg(F.count("*").alias("outages"), F.max("seconds").alias("longest"))
    per = p.groupBy("source_key").agg(F.count("*").alias("probes"), F.sum((~F.col("ok")).cast("long")).alias("failures"))
    return per.join(worst, "source_key", "left").select("source_key", "probes", "failures", F.coalesce("outages", F.lit(0)).alias("outages"), "longest", F.round(1 - F.col("failures") / F.col("probes"), 6).alias("availability"))


def jon51_blocked_requests(spark, d):
    """Requests (purchases) whose critical source was down at its last probe before them, by source."""
    e = T.table(spark, d, "events")
    requests = e.where("event_type = 'purchase'").select("event_id", "ts", (F.col("user_id") % 10).alias("source_key"))
    return ops.blocked(requests, T.probes(spark, d), ["source_key"], "ts", "event_id").groupBy("source_key").agg(F.count("*").alias("requests"), F.sum(F.col("blocked").cast("long")).alias("blocked"))


_PIX = "SELECT vec_id, 1/(1+exp(-CAST(embedding[1] AS DOUBLE)*4)) AS r, 1/(1+exp(-CAST(embedding[2] AS DOUBLE)*4)) AS g, 1/(1+exp(-CAST(embedding[3] AS DOUBLE)*4)) AS b, 1/(1+exp(-CAST(embedding[4] AS DOUBLE)*4)) AS nir FROM embeddings"
_MAP = "(VALUES " + ", ".join(f"('{s}', '{c}', '{t}', {m}::DOUBLE)" for s, c, t, m in MAPPING) + ") m(source, cls, target, least)"
_KSEG = f"{_SEG}, ks AS (SELECT seg.*, v.cls FROM seg JOIN fx_vertices v ON v.line_id = seg.line_id AND v.pos = seg.pos)"
_SPANS = """fp AS (SELECT *, lead(ts) OVER w AS nx, CASE WHEN NOT ok AND coalesce(lag(ok) OVER w, true) THEN 1 ELSE 0 END AS b FROM fx_probes WINDOW w AS (PARTITION BY source_key ORDER BY ts, event_id)),
    fo AS (SELECT *, CAST(sum(b) OVER (PARTITION BY source_key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS outage FROM fp),
    sp AS (SELECT source_key, outage, CAST(floor(epoch(max(ts))) AS BIGINT) - CAST(floor(epoch(min(ts))) AS BIGINT) AS seconds, arg_max(nx, ts) AS up_at, count(nx) FILTER (WHERE TRUE) AS k, max(event_id) AS e FROM fo WHERE NOT ok GROUP BY 1, 2)"""


def _utm_sql() -> tuple[str, str]:
    """The same series as text."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * 0.9996
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    t = f"sinh(atanh(sin(radians(lat))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians(lat))))"
    xi, eta = f"atan2({t}, cos(radians(lon - 15)))", f"atanh(sin(radians(lon - 15)) / sqrt(1 + {t} * {t}))"
    east = " + ".join(f"{al!r}::DOUBLE*cos({2 * j}*({xi}))*sinh({2 * j}*({eta}))" for j, al in enumerate(alpha, 1))
    north = " + ".join(f"{al!r}::DOUBLE*sin({2 * j}*({xi}))*cosh({2 * j}*({eta}))" for j, al in enumerate(alpha, 1))
    return f"({eta} + {east}) * {big!r}::DOUBLE + 500000", f"({xi} + {north}) * {big!r}::DOUBLE"


_UX, _UY = _utm_sql()
_C, _S = math.cos(math.radians(4.5)) * 0.1, math.sin(math.radians(4.5)) * 0.1
_SM = "greatest(0, least(1, (value - 20)/50))"

SQL = {
    "prj04_abroad_classes": "SELECT eid, eid % 4 AS country, CASE WHEN eid % 4 > 0 AND highway = 'track' AND surface = 'gravel' THEN 'forest_road' WHEN eid % 4 > 0 AND highway = 'cycleway' THEN 'path' WHEN highway = 'steps' THEN 'stairs' WHEN highway IN ('footway', 'path') THEN 'path' ELSE 'way' END AS kind FROM fx_elements",
    "prj16_exclusions": "WITH r AS (SELECT eid, CASE WHEN eid % 5 - 1 < 0 THEN 'underground' WHEN eid % 11 = 0 THEN 'covered' WHEN highway = 'service' AND eid % 7 = 0 THEN 'closed' WHEN highway = 'cycleway' AND NOT coalesce(surface IN ('asphalt', 'paved', 'concrete'), false) THEN 'unpaved' END AS reason FROM fx_elements) SELECT eid, reason FROM r WHERE reason IS NOT NULL",
    "prj18_national_classes": f"WITH {_KSEG} SELECT ks.source, ks.cls, target, count(*) AS n, round(sum(len), 2) AS length FROM ks JOIN {_MAP} ON m.source = ks.source AND m.cls = ks.cls AND len >= least GROUP BY 1, 2, 3",
    "prj19_topographic_filter": f"WITH {_KSEG} SELECT ks.cls, CASE WHEN target IS NULL THEN 'unknown class' WHEN len < least THEN 'too short' ELSE 'kept' END AS status, count(*) AS n FROM ks LEFT JOIN {_MAP} ON m.source = 'topo' AND m.cls = ks.cls WHERE ks.source = 'topo' GROUP BY 1, 2",
    "prj23_merged_recipes": "WITH u AS (SELECT z, cls FROM fx_points WHERE l_suppkey % 2 = 0 AND cls IN (2, 5) UNION ALL SELECT z, CASE WHEN cls = 3 THEN 5 ELSE cls END FROM fx_points WHERE l_suppkey % 2 = 1 AND cls <> 5) SELECT cls, count(*) AS n, round(avg(z), 5) AS mean_z FROM u GROUP BY 1",
    "prj26_valid_fences": f"WITH {_KSEG}, pr AS (SELECT x0, y0, x1, y1 FROM fx_rects WHERE kind = 'HOUSEHOLD') SELECT line_id, pos FROM ks WHERE source <> 'dtm' AND line_id % 3 - 1 >= 0 AND (cls <> '4-NOT SPECIFIED' OR (EXISTS (SELECT 1 FROM pr WHERE ks.ax >= x0 AND ks.ax < x1 AND ks.ay >= y0 AND ks.ay < y1) AND EXISTS (SELECT 1 FROM pr WHERE ks.bx >= x0 AND ks.bx < x1 AND ks.by_ >= y0 AND ks.by_ < y1)))",
    "agg25_layer_summary": "WITH k AS (SELECT kind AS layer, count(*) AS n FROM fx_rects GROUP BY 1) SELECT layer, n, CASE WHEN n < 30 THEN 'few: ' || n ELSE 'written: ' || n END AS text FROM k",
    "win02_stations_with_ends": f"WITH {_STA}, en AS (SELECT line_id, max(m0 + len) AS m, arg_max(bx, pos) AS x, arg_max(by_, pos) AS y FROM seg GROUP BY 1) SELECT line_id, round(k*25.0::DOUBLE, 3) AS m, round(x, 3) AS x, round(y, 3) AS y FROM sta UNION ALL SELECT line_id, round(m, 3), round(x, 3), round(y, 3) FROM en",
    "win03_tangents": "WITH v AS (SELECT line_id, pos, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy FROM fx_vertices WINDOW w AS (PARTITION BY line_id ORDER BY pos)), n AS (SELECT *, nullif(sqrt(dx*dx+dy*dy), 0) AS l FROM v) SELECT line_id, pos, round(dx/l, 5) AS tx, round(dy/l, 5) AS ty, round(-dy/l, 5) AS nx, round(dx/l, 5) AS ny FROM n",
    "win10_generalised_flags": """WITH v AS (SELECT line_id, pos, CASE WHEN y > 380 THEN NULL ELSE x >= 150 END AS f FROM fx_vertices), b AS (SELECT *, last_value(f IGNORE NULLS) OVER (PARTITION BY line_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS p, first_value(f IGNORE NULLS) OVER (PARTITION BY line_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM v),
      o AS (SELECT line_id, pos, coalesce(f, CASE WHEN p = n THEN p END, false) AS o FROM b), g AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY pos) - row_number() OVER (PARTITION BY line_id, o ORDER BY pos) AS g FROM o) SELECT line_id, min(pos) AS s0, max(pos) AS s1, count(*) AS n FROM g WHERE o GROUP BY line_id, g HAVING count(*) >= 2""",
    "win11_outward_walk": f"""WITH {_STA}, s AS (SELECT line_id, k, coalesce(chm < 20, true) AS o FROM sta LEFT JOIN fx_cells c ON c.rr = CAST(floor(y/4) AS BIGINT) AND c.cc = CAST(floor(x/4) AS BIGINT)), g AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY k) - row_number() OVER (PARTITION BY line_id, o ORDER BY k) AS g FROM s),
      r AS (SELECT line_id, min(k) AS f FROM g WHERE o GROUP BY line_id, g HAVING count(*) >= 3), b AS (SELECT line_id, min(f) AS stop FROM r GROUP BY 1) SELECT s.line_id, coalesce(any_value(stop), max(k) + 1)*25.0::DOUBLE AS reach FROM s LEFT JOIN b ON b.line_id = s.line_id GROUP BY 1""",
    "win21_time_until_free": "WITH e AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(floor(epoch(lag(ts, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS BIGINT) AS p FROM events) SELECT event_id, greatest(0, coalesce(p + 86400 - t, 0)) AS wait FROM e",
    "win23_deviations": "WITH p AS (SELECT country_no, strftime(created_at, '%Y-%m') AS month, avg(build_seconds) AS s, count(*) AS n FROM fx_jobs GROUP BY 1, 2), u AS (SELECT country_no, avg(s) AS u FROM p GROUP BY 1), v AS (SELECT p.country_no, month, 'ratio' AS rule, s/u AS value FROM p JOIN u ON u.country_no = p.country_no WHERE s/u < 0.9 OR s/u > 1.1 UNION ALL SELECT country_no, month, 'jobs', CAST(n AS DOUBLE) FROM p WHERE n < 20 OR n > 60) SELECT country_no, month, rule, round(value, 5) AS value FROM v WHERE NOT (country_no = 0 AND rule = 'ratio') AND NOT (country_no = 1 AND rule = 'jobs')",
    "str04_retention": "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE CAST(floor(epoch(ts)) AS BIGINT) >= (SELECT CAST(floor(epoch(max(ts))) AS BIGINT) FROM events) - 20*86400 GROUP BY 1",
    "str08_log_tail": "SELECT job_id, line_no, row_number() OVER (PARTITION BY job_id ORDER BY line_no) AS step, substring(line, 1, 12) AS begins FROM fx_loglines WHERE line_no > 1",
    "str09_changed_inputs": "SELECT page_id, CASE WHEN page_id % 10 = 3 THEN 'new' WHEN page_id % 7 = 1 THEN 'changed' ELSE 'same' END AS status FROM pages",
    "str06_counted_once": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, round(sum(value), 3) AS value FROM events GROUP BY 1",
    "str03_digests": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT source_key) AS sources, count(*) AS failures, max(code) AS worst FROM fx_probes WHERE NOT ok GROUP BY 1",
    "str02_alerts_once": f"WITH {_SPANS} SELECT source_key, outage, seconds, 'alert' AS kind FROM sp WHERE seconds >= 3600 UNION ALL SELECT source_key, outage, seconds, 'recovery' FROM sp WHERE seconds >= 3600 AND EXISTS (SELECT 1 FROM fx_probes q JOIN fo ON fo.source_key = q.source_key AND fo.outage = sp.outage AND q.source_key = sp.source_key AND q.ok AND q.ts >= fo.ts AND NOT fo.ok)",
    "str07_chunked_grid": "SELECT CAST(floor(y/10) AS BIGINT) AS rr, CAST(floor(x/10) AS BIGINT) AS cc, count(*) AS n, round(avg(z), 6) AS mean_z, max(z) AS top FROM fx_points GROUP BY 1, 2",
    "str11_late_rows": "WITH p AS (SELECT source_key, CAST(floor(epoch(ts)) AS BIGINT) AS t, max(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY source_key ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM fx_probes) SELECT source_key, count(*) AS n, CAST(sum(CASE WHEN s - t > 86400 THEN 1 ELSE 0 END) AS BIGINT) AS late FROM p GROUP BY 1",
    "fun01_projected": f"WITH v AS (SELECT line_id, pos, 15 + (x-200)/100 AS lon, 48 + (y-200)/100 AS lat FROM fx_vertices) SELECT line_id, pos, round(radians(lon)*6378137, 2) AS mx, round(ln(tan(pi()/4 + radians(lat)/2))*6378137, 2) AS my, round({_UX}, 2) AS ux, round({_UY}, 2) AS uy FROM v",
    "fun02_map_coordinates": f"SELECT line_id, pos, round((x-200)*{_C!r}::DOUBLE - (y-200)*{_S!r}::DOUBLE, 5) AS mx, round((x-200)*{_S!r}::DOUBLE + (y-200)*{_C!r}::DOUBLE, 5) AS my, x, y FROM fx_vertices",
    "fun04_extent_sizes": "WITH s AS (SELECT fid, (x1-x0)/1000*111.32*cos(radians((50 + y0/1000 + 50 + y1/1000)/2)) AS w, (y1-y0)/1000*111.32 AS h FROM fx_rects) SELECT fid, round(w, 5) AS width, round(h, 5) AS height, round(w*h, 5) AS area FROM s",
    "fun05_point_to_segment": f"WITH {_SEG} SELECT line_id, pos, round(sqrt(power(200-ax-greatest(0,least(1,coalesce(((200-ax)*(bx-ax)+(200-ay)*(by_-ay))/nullif(len*len,0),0)))*(bx-ax), 2) + power(200-ay-greatest(0,least(1,coalesce(((200-ax)*(bx-ax)+(200-ay)*(by_-ay))/nullif(len*len,0),0)))*(by_-ay), 2)), 4) AS distance, (ax-ay)*(bx-by_) < 0 AS crosses FROM seg",
    "fun07_guards": f"SELECT event_id, round({_SM}*{_SM}*(3-2*{_SM}), 6) AS step, greatest(10, least(60, value)) AS clipped, round(value/nullif(user_id % 3, 0), 6) AS ratio FROM events",
    "fun08_quantiles": "SELECT event_type, round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95 FROM events GROUP BY 1",
    "fun09_paper_sizes": "SELECT fid, round((x1-x0)/4.0, 5) AS width_mm, round((y1-y0)/4.0, 5) AS height_mm, 2.0::DOUBLE AS half_mm FROM fx_rects",
    "fun10_image_figures": f"WITH p AS ({_PIX}) SELECT vec_id, round((2*g-r-b)/(r+g+b), 5) AS exg, round(0.299::DOUBLE*r+0.587::DOUBLE*g+0.114::DOUBLE*b, 5) AS luminance, round((nir-r)/(nir+r), 5) AS ndvi, round(1-least(r,g,b)/greatest(r,g,b), 5) AS saturation, round(greatest(r,g,b), 5) AS value FROM p",
    "fun12_tag_texts": "WITH t AS (SELECT p_partkey, list_filter(list_transform(string_split('  ' || upper(p_brand) || ';' || p_type || ' ; ', ';'), lambda s: lower(trim(s))), lambda s: s <> '') AS v, p_size, p_partkey AS k FROM part) SELECT p_partkey, array_to_string(v, '|') AS values, len(v) AS n, p_size + (k % 10)/10.0::DOUBLE AS width, '5' || lpad(CAST(k % 40 AS VARCHAR), 2, '0') AS symbol, p_size % 3 AS variant FROM t",
    "fun13_tile_names": "SELECT line_id, pos, chr(CAST(65 + floor(x/100) AS INTEGER)) || lpad(CAST(CAST(floor(y/100) AS INTEGER) AS VARCHAR), 2, '0') AS name, floor(x/100)*100 AS west, floor(y/100)*100 AS south FROM fx_vertices",
    "fun15_normal_addresses": "WITH m AS (SELECT c_custkey, replace(lower(replace(c_name, '#', '.')), '.', '') || '@mail.example' AS mail FROM customer) SELECT c_custkey, mail, sha256('key:' || mail) AS tag, '10.' || c_custkey % 200 || '.' || c_custkey % 7 || '.0/24' AS network FROM m",
    "fun17_times": "WITH e AS (SELECT event_id, ts, event_id*37 % 9000 AS s FROM events) SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, date_diff('day', CAST(ts AS DATE), DATE '2024-03-01') AS age, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))/5) AS BIGINT) AS slot, CASE WHEN s >= 3600 THEN printf('%d h %02d min', s // 3600, s % 3600 // 60) WHEN s >= 60 THEN printf('%d min', s % 3600 // 60) ELSE printf('%d s', s) END AS duration FROM e",
    "fun18_rings": "SELECT fid, 5 AS points, round((x1-x0)*(y1-y0), 3) AS area, round(-(x1-x0)*(y1-y0), 3) AS turned, printf('%.1f;%.1f;%.1f;%.1f', x1-x0, y1-y0, x1-x0, y1-y0) AS sides FROM fx_rects",
    "fun19_geojson": """SELECT fid, printf('{"type":"Feature","properties":{"kind":"%s","level":%d},"geometry":{"type":"Polygon","coordinates":[[[%.1f,%.1f],[%.1f,%.1f],[%.1f,%.1f],[%.1f,%.1f],[%.1f,%.1f]]]}}', kind, lvl, x0, y0, x1, y0, x1, y1, x0, y1, x0, y0) AS doc, kind, lvl AS level, 5 AS points, round(x1, 1) AS x1, round(y1, 1) AS y1 FROM fx_rects""",
    "udf01_sampled_predicates": f"WITH {_STA}, o AS (SELECT line_id, dem, CASE WHEN EXISTS (SELECT 1 FROM fx_rects r WHERE lvl = 1 AND sta.x >= x0 AND sta.x < x1 AND sta.y >= y0 AND sta.y < y1) THEN 1 END AS zone FROM sta LEFT JOIN fx_cells c ON c.rr = CAST(floor(sta.y/4) AS BIGINT) AND c.cc = CAST(floor(sta.x/4) AS BIGINT) WHERE source = 'topo') SELECT line_id, count(*) AS stations, count(dem) AS with_ground, round(avg(dem), 5) AS mean_dem, count(zone) AS in_zone FROM o GROUP BY 1",
    "udf02_merged_parts": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1",
    "udf03_ring_edges": "SELECT fid, unnest([1, 2, 3, 4]) AS side, unnest([x0, x1, x1, x0]) AS ax, unnest([y0, y0, y1, y1]) AS ay, unnest([x1, x1, x0, x0]) AS bx, unnest([y0, y1, y1, y0]) AS by FROM fx_rects",
    "udf05_fitted_times": "WITH j AS (SELECT *, CAST(est_prep_min + est_maps_min AS DOUBLE) AS est FROM fx_jobs), f AS (SELECT country_no, regr_slope(build_seconds, est) AS a, regr_intercept(build_seconds, est) AS b FROM j GROUP BY 1) SELECT job_id, round(build_seconds - a*est - b, 4) AS off FROM j JOIN f ON f.country_no = j.country_no",
    "pip18_feasibility": """WITH p AS (SELECT a.fid, b.lvl, round(sum((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))), 4) AS common FROM fx_rects a JOIN fx_rects b ON a.kind = 'BUILDING' AND b.kind <> 'BUILDING' AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) GROUP BY 1, 2),
      l AS (SELECT fid, lvl FROM p QUALIFY row_number() OVER (PARTITION BY fid ORDER BY common DESC, lvl DESC) = 1), h AS (SELECT DISTINCT CAST(floor(y/4) AS BIGINT) AS rr, CAST(floor(x/4) AS BIGINT) AS cc FROM fx_points WHERE cls = 2),
      g AS (SELECT r.range AS rr, k.range AS cc FROM range(0, 120) r, range(0, 120) k), c AS (SELECT q.fid, count(*) AS cells, count(h.rr) AS covered FROM fx_rects q JOIN g ON (cc+0.5::DOUBLE)*4 >= x0 AND (cc+0.5::DOUBLE)*4 < x1 AND (rr+0.5::DOUBLE)*4 >= y0 AND (rr+0.5::DOUBLE)*4 < y1 LEFT JOIN h ON h.rr = g.rr AND h.cc = g.cc WHERE q.kind = 'BUILDING' GROUP BY 1)
      SELECT e.fid, lvl_ AS country, round(covered/cells, 5) AS share, round(3.5::DOUBLE + (x1-x0)*(y1-y0)/100, 4) AS minutes, CASE WHEN lvl_ IS NULL THEN 'no country' WHEN covered/cells < 0.2 THEN 'no coverage' WHEN covered/cells < 0.6 THEN 'partial' ELSE 'good' END AS status FROM fx_rects e LEFT JOIN (SELECT fid, lvl AS lvl_ FROM l) l ON l.fid = e.fid LEFT JOIN c ON c.fid = e.fid WHERE kind = 'BUILDING'""",
    "pip19_usage_report": "WITH p AS (SELECT country_no, count(*) AS jobs, CAST(sum(CASE WHEN status <> 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS done, count(DISTINCT ip_tag) AS users, round(avg(CASE WHEN status <> 'failed' THEN build_seconds/60 END), 5) AS minutes, round(avg(CASE WHEN status <> 'failed' THEN build_seconds/60/(est_prep_min+est_maps_min) END), 5) AS ratio FROM fx_jobs GROUP BY 1) SELECT *, round(jobs / sum(jobs) OVER (), 6) AS share FROM p",
    "pip20_reliability": f"WITH {_SPANS}, w AS (SELECT source_key, count(*) AS outages, max(seconds) AS longest FROM sp GROUP BY 1), p AS (SELECT source_key, count(*) AS probes, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS failures FROM fx_probes GROUP BY 1) SELECT p.source_key, probes, failures, coalesce(outages, 0) AS outages, longest, round(1 - failures/probes, 6) AS availability FROM p LEFT JOIN w ON w.source_key = p.source_key",
    "jon51_blocked_requests": "SELECT source_key, count(*) AS requests, CAST(sum(CASE WHEN NOT before THEN 1 ELSE 0 END) AS BIGINT) AS blocked FROM (SELECT user_id % 10 AS source_key, event_type, lag(event_type <> 'error', 1, true) OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS before FROM events) WHERE event_type = 'purchase' GROUP BY 1",
}

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("prj", "agg", "win", "str", "fun", "udf", "pip", "jon")) and callable(f)}
