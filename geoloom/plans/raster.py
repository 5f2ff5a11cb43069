"""Queries over points and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import focal, grid
from geoloom.sources import tables as T

SIDE = 100  # cells of 4 m on each side of the area


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return grid.surfaces(T.points(spark, d), T.CELL_M)


def _dense(spark: SparkSession, d: str) -> DataFrame:
    return grid.densify(_cells(spark, d), SIDE, SIDE)


def agg01_terrain_surface(spark, d):
    return grid.terrain_surface(T.points(spark, d), T.CELL_M).select("rr", "cc", F.round("terrain", 4).alias("terrain"), "surface")


def agg02_grid_stats(spark, d):
    """Flagship: points to cells to canopy height to class shares."""
    h = grid.canopy_height(F.col("dsm"), F.col("dem"))
    classed = _cells(spark, d).select("n", h.alias("h")).withColumn("cls", grid.ladder(F.col("h")))
    return classed.groupBy("cls").agg(F.count("*").alias("n_cells"), F.sum("n").alias("n_points"), F.round(F.avg("h"), 4).alias("mean_height"), (F.count("*") * 16).alias("area_m2"))


def agg03_block_stats(spark, d):
    keyed = grid.with_cell(T.points(spark, d), 20.0, "br", "bc")
    first = (F.col("rn") == 1).cast("long")
    return keyed.groupBy("br", "bc").agg(F.max("hag").alias("top"), F.sum(first).alias("first_returns"), F.sum(F.when(F.col("cls") == 2, F.lit(1.0) / F.col("nr")).otherwise(0.0)).alias("ground_weight"), F.sum((F.col("hag") >= 5.5).cast("long")).alias("high")).withColumn("ground_weight", F.round("ground_weight", 4))


def agg04_green_blocks(spark, d):
    return grid.green_blocks(T.points(spark, d), 20.0).select("br", "bc", "top", "low", "first", F.round("green", 4).alias("green"), "high", F.round("value", 5).alias("value"))


def agg05_shade_classes(spark, d):
    step = grid.shade(F.round("value", 6), 0.05)
    return grid.green_blocks(T.points(spark, d), 20.0).select(step.alias("step")).withColumn("shade", grid.shade_class(F.col("step"))).groupBy("step", "shade").agg(F.count("*").alias("blocks"))


def agg06_above_mean(spark, d):
    cells = _cells(spark, d)
    mean = cells.where("ground_hits > 0").agg(F.avg("n").alias("mean"))
    return cells.join(F.broadcast(mean), F.lit(True)).groupBy((F.col("n") > F.col("mean")).alias("above")).agg(F.count("*").alias("cells"), F.sum("n").alias("points"))


def agg08_block_downsample(spark, d):
    return grid.blocks(_cells(spark, d), 4, F.round(F.avg("dem"), 4).alias("mean_dem"), F.max("dsm").alias("max_dsm"), F.sum("n").alias("n"))


def agg09_canopy_height(spark, d):
    return _cells(spark, d).select("rr", "cc", grid.canopy_height(F.col("dsm"), F.col("dem")).alias("h"))


def agg10_surface_composition(spark, d):
    h = F.greatest(F.coalesce(F.col("dsm"), F.col("dem")) - F.col("dem"), F.lit(0.0))
    return _cells(spark, d).select("rr", "cc", (F.col("dem") + F.least(h, F.coalesce(F.col("chm"), h))).alias("surface"))


def agg11_class_shares(spark, d):
    classed = _cells(spark, d).select(grid.ladder(grid.canopy_height(F.col("dsm"), F.col("dem"))).alias("cls"))
    return grid.shares(classed, "cls").withColumn("share", F.round("share", 6))


def agg12_mask_scores(spark, d):
    m = focal.box_mean(_dense(spark, d).withColumn("v", F.col("chm")), 1)
    scores = grid.match_scores(m, F.coalesce(F.col("chm") >= 15, F.lit(False)), F.coalesce(F.col("mean") >= 12, F.lit(False)))
    return scores.select("tp", "positives", "truth", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def agg13_confusion(spark, d):
    h = grid.canopy_height(F.col("dsm"), F.col("dem"))
    pairs = _cells(spark, d).select(grid.ladder(h).alias("ref"), grid.ladder(F.col("chm")).alias("ours"))
    wide = grid.confusion(pairs, "ref", "ours", [0, 1, 2, 3, 4])
    return wide.select("ref", *(F.col(str(k)).alias(f"c{k}") for k in range(5)))


def agg28_sheet_epochs(spark, d):
    line = T.table(spark, d, "lineitem")
    return line.groupBy((F.col("l_suppkey") % 16).alias("sheet")).agg(F.to_date(F.min("l_shipdate")).cast("string").alias("first_day"), F.to_date(F.max("l_shipdate")).cast("string").alias("last_day"), F.count("*").alias("points"))


def agg31_zonal_quantile(spark, d):
    zone = F.floor(F.col("rr") / 25) * 4 + F.floor(F.col("cc") / 25)
    return _cells(spark, d).groupBy(zone.alias("zone")).agg(F.expr("percentile(dem, 0.9)").alias("p90"), F.expr("percentile(dsm, 0.5)").alias("median_dsm"))


def ras01_box_sum(spark, d):
    return focal.box(_dense(spark, d).withColumn("v", F.col("n")), 2).select("rr", "cc", F.coalesce("s", F.lit(0)).cast("long").alias("s"))


def ras01_box_mean(spark, d):
    return focal.box_mean(_dense(spark, d).withColumn("v", F.col("chm")), 2).select("rr", "cc", F.round("mean", 4).alias("mean"))


def ras02_fraction(spark, d):
    m = _dense(spark, d).withColumn("v", F.coalesce((F.col("chm") >= 15).cast("int"), F.lit(0)))
    return focal.box_mean(m, 1).select("rr", "cc", F.round("mean", 5).alias("fraction"))


def ras03_min_max(spark, d):
    v = _dense(spark, d).withColumn("v", F.col("dem"))
    return focal.box(focal.box(v, 1, "min", "v", "low"), 1, "max", "v", "high").select("rr", "cc", "low", "high")


def ras05_gauss(spark, d):
    return focal.gauss(_dense(spark, d).withColumn("v", F.col("dem")), 1.0).select("rr", "cc", F.round("g", 4).alias("g"))


def ras06_local_std(spark, d):
    return focal.box_std(_dense(spark, d).withColumn("v", F.col("chm")), 1).select("rr", "cc", F.round("std", 3).alias("std"))


def ras07_majority(spark, d):
    m = _dense(spark, d).withColumn("v", F.coalesce(F.col("chm") >= 15, F.lit(False)))
    return focal.majority(m, 1).select("rr", "cc", "maj")


def ras08_open_close(spark, d):
    m = _dense(spark, d).withColumn("v", F.coalesce(F.col("chm") >= 10, F.lit(False)))
    out = focal.closed(focal.opened(m, 1, "v", "o"), 1, "v", "c")
    return out.select("rr", "cc", "o", "c")


def ras08_disk_dilate(spark, d):
    return focal.disk_dilate(_cells(spark, d).where("chm >= 20"), 2.5).where("rr between 0 and 99 and cc between 0 and 99")


def ras09_slope(spark, d):
    g = focal.gradient(_dense(spark, d).withColumn("v", F.col("dem")), T.CELL_M)
    return g.select("rr", "cc", F.round("gx", 5).alias("gx"), F.round("gy", 5).alias("gy"), F.round(focal.slope_degrees(), 3).alias("slope"))


def ras10_hillshade(spark, d):
    g = focal.gradient(_dense(spark, d).withColumn("v", F.col("dem")), T.CELL_M)
    return g.select("rr", "cc", F.round(focal.hillshade(), 2).alias("shade"))


def ras12_open_ratio(spark, d):
    """Share of low hits in forward 2 x 2 windows over cells."""
    low = grid.with_cell(T.points(spark, d), T.CELL_M).groupBy("rr", "cc").agg(F.sum((F.col("hag") < 5).cast("long")).alias("low"), F.count("*").alias("n"))
    moved = focal.shifted(low, [(0, 0), (0, -1), (-1, 0), (-1, -1)]).groupBy("rr", "cc").agg(F.sum("low").alias("low"), F.sum("n").alias("n"))
    return moved.where("rr >= 0 and cc >= 0").select("rr", "cc", "low", "n", (F.col("low") > F.col("n") * 0.2).alias("open"))


def ras17_young_stand(spark, d):
    m = focal.box_mean(_dense(spark, d).withColumn("v", F.col("chm")), 1).withColumn("y", F.coalesce((F.col("mean") >= 1) & (F.col("mean") <= 18), F.lit(False)))
    return focal.opened(m, 1, "y", "green").where("green").select("rr", "cc")


def ras29_crown_peaks(spark, d):
    top = focal.box(_dense(spark, d).withColumn("v", F.col("dsm")), 2, "max", "v", "top")
    return top.where("dsm is not null and dsm = top and dsm - dem >= 5").select("rr", "cc", "dsm")


def ras28_boulders(spark, d):
    """Cells that rise above both neighbours on all four axes and are the highest around."""
    base = _dense(spark, d).where("dem is not null").select("rr", "cc", "dem")
    axes = [((0, 2), (0, -2)), ((2, 0), (-2, 0)), ((2, 2), (-2, -2)), ((2, -2), (-2, 2))]
    offsets = [o for pair in axes for o in pair]
    around = focal.shifted(base, offsets).groupBy("rr", "cc").agg(*(F.max(F.when((F.col("dy") == dy) & (F.col("dx") == dx), F.col("dem"))).alias(f"o{i}") for i, (dy, dx) in enumerate(offsets)))
    rise = F.least(*(F.col("dem") - F.greatest(f"o{2 * i}", f"o{2 * i + 1}") for i in range(4)))
    return base.join(around, ["rr", "cc"]).where(" and ".join(f"o{i} is not null" for i in range(8))).withColumn("rise", rise).where("rise >= 1.2").select("rr", "cc", F.round("rise", 4).alias("rise"))


def ras26_step_cells(spark, d):
    """Cells where the ground falls between near neighbours by more than the wider trend explains."""
    base = _dense(spark, d).where("dem is not null").select("rr", "cc", "dem")
    out = None
    for k, (dy, dx) in enumerate(((0, 1), (1, 0), (1, 1), (1, -1))):
        offs = {"a": (-dy, -dx), "b": (dy, dx), "fa": (-3 * dy, -3 * dx), "fb": (3 * dy, 3 * dx)}
        got = focal.shifted(base, list(offs.values())).groupBy("rr", "cc").agg(*(F.max(F.when((F.col("dy") == y) & (F.col("dx") == x), F.col("dem"))).alias(n) for n, (y, x) in offs.items()))
        drop = F.abs(F.col("a") - F.col("b")) - F.abs(F.col("fa") - F.col("fb")) / 3
        part = got.select("rr", "cc", F.lit(k).alias("axis"), drop.alias("drop")).where("drop >= 20")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("rr", "cc").agg(F.round(F.max("drop"), 4).alias("drop"), F.count("*").alias("axes"))


def ras33_regrid_bilinear(spark, d):
    """The terrain at points between cell centres, from the four cells around each."""
    dem = _cells(spark, d).select("rr", "cc", "dem")
    target = grid.grid_dimension(spark, 60, 60).select(F.col("rr").alias("tr"), F.col("cc").alias("tc"), ((F.col("rr") + 0.5) * (SIDE / 60.0) - 0.5).alias("fy"), ((F.col("cc") + 0.5) * (SIDE / 60.0) - 0.5).alias("fx"))
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))).alias("k")
    four = target.select("tr", "tc", "fy", "fx", corner).select("tr", "tc", (F.floor("fy") + F.col("k.a")).alias("rr"), (F.floor("fx") + F.col("k.b")).alias("cc"), (F.when(F.col("k.a") == 1, F.col("fy") - F.floor("fy")).otherwise(1 - (F.col("fy") - F.floor("fy"))) * F.when(F.col("k.b") == 1, F.col("fx") - F.floor("fx")).otherwise(1 - (F.col("fx") - F.floor("fx")))).alias("w"))
    return four.join(dem, ["rr", "cc"]).groupBy("tr", "tc").agg(F.round(F.sum(F.col("w") * F.col("dem")) / F.nullif(F.sum("w"), F.lit(0.0)), 4).alias("dem"))


def ras34_fill_nodata(spark, d):
    """Cells without points take the inverse-distance mean of valid cells at most 2 cells away."""
    cells = _dense(spark, d)
    moved = focal.shifted(cells.where("valid").select("rr", "cc", "dem"), [o for o in focal.disk(2) if o != (0, 0)])
    w = 1.0 / (F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx"))
    guess = moved.groupBy("rr", "cc").agg((F.sum(F.col("dem") * w) / F.sum(w)).alias("guess"))
    return cells.where("not valid").select("rr", "cc").join(guess, ["rr", "cc"]).select("rr", "cc", F.round("guess", 4).alias("dem"))


def ras45_shift_search(spark, d):
    """The shift between two masks with the most common cells."""
    a = _cells(spark, d).where("chm >= 20").select("rr", "cc")
    b = _cells(spark, d).where("dsm >= 520").select((F.col("rr") + 1).alias("rr"), F.col("cc").alias("cc"))
    moved = focal.shifted(a, [(dy, dx) for dy in range(-3, 4) for dx in range(-3, 4)])
    return moved.join(b, ["rr", "cc"]).groupBy("dy", "dx").agg(F.count("*").alias("common"))


_BETWEEN = "n.rr BETWEEN c.rr - {k} AND c.rr + {k} AND n.cc BETWEEN c.cc - {k} AND c.cc + {k}"
_NEAR = "FROM fx_dense c JOIN fx_dense n ON " + _BETWEEN
_LADDER = "CASE WHEN {h} < 1 THEN 1 WHEN {h} < 2 THEN 2 WHEN {h} < 4 THEN 3 WHEN {h} < 6 THEN 4 ELSE 0 END"
_H = "greatest(coalesce(dsm, dem) - dem, 0)"
_GREEN = """b AS (SELECT CAST(floor(y/20) AS BIGINT) AS br, CAST(floor(x/20) AS BIGINT) AS bc, hag, rn, nr FROM fx_points),
    t AS (SELECT br, bc, max(hag) AS top FROM b GROUP BY 1, 2),
    g AS (SELECT b.br, b.bc, max(top) AS top, sum(CASE WHEN hag < 1 THEN 1 ELSE 0 END) AS low, sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) AS first,
      sum(CASE WHEN rn = nr THEN CASE WHEN hag >= 1.0 AND hag < 2.65 THEN 1.0 WHEN hag >= 2.65 AND hag < 3.4 THEN 0.1 WHEN hag >= 3.4 AND hag < 5.5 AND top < 8 THEN 0.2 ELSE 0 END ELSE 0 END) AS green,
      sum(CASE WHEN hag >= 5.5 THEN 1 ELSE 0 END) AS high FROM b JOIN t ON b.br = t.br AND b.bc = t.bc GROUP BY 1, 2),
    v AS (SELECT *, green / (green + low + 1) * (0.2 + 0.8 * high / (low + green + high + 1)) AS value FROM g)"""
_GRAD = """g AS (SELECT c.rr, c.cc,
      (coalesce(CASE WHEN e.rr IS NULL THEN c.dem ELSE e.dem END, NULL) - CASE WHEN w.rr IS NULL THEN c.dem ELSE w.dem END) / ((coalesce(e.cc, c.cc) - coalesce(w.cc, c.cc)) * 4.0) AS gx,
      (CASE WHEN s.rr IS NULL THEN c.dem ELSE s.dem END - CASE WHEN n.rr IS NULL THEN c.dem ELSE n.dem END) / ((coalesce(s.rr, c.rr) - coalesce(n.rr, c.rr)) * 4.0) AS gy
    FROM fx_dense c LEFT JOIN fx_dense e ON e.rr = c.rr AND e.cc = c.cc + 1 LEFT JOIN fx_dense w ON w.rr = c.rr AND w.cc = c.cc - 1
    LEFT JOIN fx_dense s ON s.cc = c.cc AND s.rr = c.rr + 1 LEFT JOIN fx_dense n ON n.cc = c.cc AND n.rr = c.rr - 1)"""


def _morph(op: str, src: str, dst: str) -> str:
    return f"{dst} AS (SELECT c.rr, c.cc, {op}(n.v) AS v FROM {src} c JOIN {src} n ON {_BETWEEN.format(k=1)} GROUP BY 1, 2)"


_AXIS = " UNION ALL ".join(
    f"SELECT c.rr, c.cc, abs(a.dem - b.dem) - abs(fa.dem - fb.dem) / 3 AS dr FROM pos c JOIN fx_dense a ON a.rr = c.rr + {dy} AND a.cc = c.cc + {dx} JOIN fx_dense b ON b.rr = c.rr - {dy} AND b.cc = c.cc - {dx}"
    f" JOIN fx_dense fa ON fa.rr = c.rr + 3 * {dy} AND fa.cc = c.cc + 3 * {dx} JOIN fx_dense fb ON fb.rr = c.rr - 3 * {dy} AND fb.cc = c.cc - 3 * {dx}"
    for dy, dx in (("0", "1"), ("1", "0"), ("1", "1"), ("1", "(-1)"))
)

SQL = {
    "agg01_terrain_surface": "SELECT CAST(floor(y/4) AS BIGINT) AS rr, CAST(floor(x/4) AS BIGINT) AS cc, round(avg(CASE WHEN cls=2 THEN z END), 4) AS terrain, max(CASE WHEN cls<>2 THEN z END) AS surface FROM fx_points GROUP BY 1, 2",
    "agg02_grid_stats": f"SELECT cls, count(*) AS n_cells, sum(n) AS n_points, round(avg(h), 4) AS mean_height, count(*)*16 AS area_m2 FROM (SELECT n, h, {_LADDER.format(h='h')} AS cls FROM (SELECT n, {_H} AS h FROM fx_cells) a) b GROUP BY cls",
    "agg03_block_stats": "SELECT CAST(floor(y/20) AS BIGINT) AS br, CAST(floor(x/20) AS BIGINT) AS bc, max(hag) AS top, sum(CASE WHEN rn=1 THEN 1 ELSE 0 END) AS first_returns, round(sum(CASE WHEN cls=2 THEN 1.0::DOUBLE/nr ELSE 0 END), 4) AS ground_weight, sum(CASE WHEN hag >= 5.5 THEN 1 ELSE 0 END) AS high FROM fx_points GROUP BY 1, 2",
    "agg04_green_blocks": f"WITH {_GREEN} SELECT br, bc, top, low, first, round(green, 4) AS green, high, round(value, 5) AS value FROM v",
    "agg05_shade_classes": f"WITH {_GREEN}, s AS (SELECT " + " + ".join(f"CASE WHEN round(value, 6) > {x}*0.05::DOUBLE THEN 1 ELSE 0 END" for x in grid.SHADE_STEPS) + " AS step FROM v) SELECT step, CASE WHEN step >= 7 THEN 3 WHEN step >= 4 THEN 2 WHEN step >= 1 THEN 1 ELSE 0 END AS shade, count(*) AS blocks FROM s GROUP BY 1, 2",
    "agg06_above_mean": "SELECT n > (SELECT avg(n) FROM fx_cells WHERE ground_hits > 0) AS above, count(*) AS cells, sum(n) AS points FROM fx_cells GROUP BY 1",
    "agg08_block_downsample": "SELECT rr // 4 AS br, cc // 4 AS bc, round(avg(dem), 4) AS mean_dem, max(dsm) AS max_dsm, sum(n) AS n FROM fx_cells GROUP BY 1, 2",
    "agg09_canopy_height": f"SELECT rr, cc, {_H} AS h FROM fx_cells",
    "agg10_surface_composition": f"SELECT rr, cc, dem + least({_H}, coalesce(chm, {_H})) AS surface FROM fx_cells",
    "agg11_class_shares": f"SELECT cls, count(*) AS n_cells, round(count(*) / (SELECT count(*) FROM fx_cells), 6) AS share FROM (SELECT {_LADDER.format(h=_H)} AS cls FROM fx_cells) GROUP BY 1",
    "agg12_mask_scores": f"WITH m AS (SELECT c.rr, c.cc, any_value(c.chm) AS chm, avg(n.chm) AS mean {_NEAR.format(k=1)} GROUP BY 1, 2), k AS (SELECT sum(CASE WHEN chm >= 15 AND mean >= 12 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN mean >= 12 THEN 1 ELSE 0 END) AS positives, sum(CASE WHEN chm >= 15 THEN 1 ELSE 0 END) AS truth FROM m) SELECT tp, positives, truth, round(tp / positives, 6) AS precision, round(tp / truth, 6) AS recall, round(2 * tp / (positives + truth), 6) AS f1 FROM k",
    "agg13_confusion": f"SELECT ref, {', '.join(f'sum(CASE WHEN ours={k} THEN 1 ELSE 0 END) AS c{k}' for k in range(5))} FROM (SELECT {_LADDER.format(h=_H)} AS ref, {_LADDER.format(h='chm')} AS ours FROM fx_cells) GROUP BY ref",
    "agg28_sheet_epochs": "SELECT l_suppkey % 16 AS sheet, CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) AS first_day, CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS last_day, count(*) AS points FROM lineitem GROUP BY 1",
    "agg31_zonal_quantile": "SELECT (rr // 25) * 4 + cc // 25 AS zone, quantile_cont(dem, 0.9) AS p90, quantile_cont(dsm, 0.5) AS median_dsm FROM fx_cells GROUP BY 1",
    "ras01_box_sum": f"SELECT c.rr, c.cc, CAST(coalesce(sum(n.n), 0) AS BIGINT) AS s {_NEAR.format(k=2)} GROUP BY 1, 2",
    "ras01_box_mean": f"SELECT c.rr, c.cc, round(avg(n.chm), 4) AS mean {_NEAR.format(k=2)} GROUP BY 1, 2",
    "ras02_fraction": f"SELECT c.rr, c.cc, round(avg(CASE WHEN n.chm >= 15 THEN 1 ELSE 0 END), 5) AS fraction {_NEAR.format(k=1)} GROUP BY 1, 2",
    "ras03_min_max": f"SELECT c.rr, c.cc, min(n.dem) AS low, max(n.dem) AS high {_NEAR.format(k=1)} GROUP BY 1, 2",
    "ras05_gauss": f"SELECT c.rr, c.cc, round(sum(exp(-0.5*((n.rr-c.rr)*(n.rr-c.rr)+(n.cc-c.cc)*(n.cc-c.cc))) * n.dem) / sum(CASE WHEN n.dem IS NOT NULL THEN exp(-0.5*((n.rr-c.rr)*(n.rr-c.rr)+(n.cc-c.cc)*(n.cc-c.cc))) END), 4) AS g {_NEAR.format(k=2)} GROUP BY 1, 2",
    "ras06_local_std": f"SELECT c.rr, c.cc, round(sqrt(greatest(avg(n.chm*n.chm) - avg(n.chm)*avg(n.chm), 0)), 3) AS std {_NEAR.format(k=1)} GROUP BY 1, 2",
    "ras07_majority": f"SELECT c.rr, c.cc, avg(CASE WHEN n.chm >= 15 THEN 1 ELSE 0 END) > 0.5 AS maj {_NEAR.format(k=1)} GROUP BY 1, 2",
    "ras08_open_close": "WITH m AS (SELECT rr, cc, CASE WHEN chm >= 10 THEN 1 ELSE 0 END AS v FROM fx_dense), " + ", ".join((_morph("min", "m", "e"), _morph("max", "e", "o"), _morph("max", "m", "x"), _morph("min", "x", "k"))) + " SELECT o.rr, o.cc, o.v = 1 AS o, k.v = 1 AS c FROM o JOIN k ON o.rr = k.rr AND o.cc = k.cc",
    "ras08_disk_dilate": "SELECT d.rr, d.cc, count(*) AS hits FROM fx_dense d JOIN fx_cells c ON c.chm >= 20 AND (d.rr-c.rr)*(d.rr-c.rr) + (d.cc-c.cc)*(d.cc-c.cc) <= 6.25 GROUP BY 1, 2",
    "ras09_slope": f"WITH {_GRAD} SELECT rr, cc, round(gx, 5) AS gx, round(gy, 5) AS gy, round(degrees(atan(sqrt(gx*gx+gy*gy))), 3) AS slope FROM g",
    "ras10_hillshade": f"WITH {_GRAD} SELECT rr, cc, CASE WHEN gx IS NULL OR gy IS NULL THEN 0.0 ELSE round(255 * greatest(0, sin(radians(45)) * cos(atan(sqrt(gx*gx+gy*gy))) + cos(radians(45)) * sin(atan(sqrt(gx*gx+gy*gy))) * cos(radians(135) - atan2(gy, -gx))), 2) END AS shade FROM g",
    "ras12_open_ratio": "WITH k AS (SELECT CAST(floor(y/4) AS BIGINT) AS rr, CAST(floor(x/4) AS BIGINT) AS cc, sum(CASE WHEN hag < 5 THEN 1 ELSE 0 END) AS low, count(*) AS n FROM fx_points GROUP BY 1, 2), g AS (SELECT rr, cc FROM fx_dense) SELECT g.rr, g.cc, sum(low) AS low, sum(n) AS n, sum(low) > sum(n) * 0.2 AS open FROM g JOIN k ON k.rr BETWEEN g.rr AND g.rr + 1 AND k.cc BETWEEN g.cc AND g.cc + 1 GROUP BY 1, 2",
    "ras17_young_stand": f"WITH m AS (SELECT c.rr, c.cc, CASE WHEN avg(n.chm) BETWEEN 1 AND 18 THEN 1 ELSE 0 END AS v {_NEAR.format(k=1)} GROUP BY 1, 2), " + _morph("min", "m", "e") + ", " + _morph("max", "e", "o") + " SELECT rr, cc FROM o WHERE v = 1",
    "ras28_boulders": "WITH k AS (SELECT c.rr, c.cc, any_value(c.dem) AS dem, " + ", ".join(f"max(CASE WHEN n.rr - c.rr = {y} AND n.cc - c.cc = {x} THEN n.dem END) AS o{i}" for i, (y, x) in enumerate(((0, 2), (0, -2), (2, 0), (-2, 0), (2, 2), (-2, -2), (2, -2), (-2, 2)))) + f" {_NEAR.format(k=2)} WHERE c.valid GROUP BY 1, 2), r AS (SELECT rr, cc, least(dem - greatest(o0, o1), dem - greatest(o2, o3), dem - greatest(o4, o5), dem - greatest(o6, o7)) AS rise FROM k WHERE o0 + o1 + o2 + o3 + o4 + o5 + o6 + o7 IS NOT NULL) SELECT rr, cc, round(rise, 4) AS rise FROM r WHERE rise >= 1.2",
    "ras26_step_cells": f"WITH pos AS (SELECT rr, cc FROM (SELECT r.range - 5 AS rr, k.range - 5 AS cc FROM range(0, 110) r, range(0, 110) k)), u AS ({_AXIS}) SELECT rr, cc, round(max(dr), 4) AS drop, count(*) AS axes FROM u WHERE dr >= 20 GROUP BY 1, 2",
    "ras29_crown_peaks": f"SELECT c.rr, c.cc, c.dsm {_NEAR.format(k=2)} GROUP BY c.rr, c.cc, c.dsm, c.dem HAVING c.dsm = max(n.dsm) AND c.dsm - c.dem >= 5",
    "ras33_regrid_bilinear": "WITH t AS (SELECT r.range AS tr, k.range AS tc, (r.range + 0.5::DOUBLE) * (100/60.0::DOUBLE) - 0.5 AS fy, (k.range + 0.5::DOUBLE) * (100/60.0::DOUBLE) - 0.5 AS fx FROM range(0, 60) r, range(0, 60) k) SELECT tr, tc, round(sum((1 - abs(c.rr - fy)) * (1 - abs(c.cc - fx)) * dem) / nullif(sum((1 - abs(c.rr - fy)) * (1 - abs(c.cc - fx))), 0), 4) AS dem FROM t JOIN fx_cells c ON c.rr BETWEEN floor(fy) AND floor(fy) + 1 AND c.cc BETWEEN floor(fx) AND floor(fx) + 1 GROUP BY 1, 2",
    "ras34_fill_nodata": "SELECT c.rr, c.cc, round(sum(n.dem / ((n.rr-c.rr)*(n.rr-c.rr)+(n.cc-c.cc)*(n.cc-c.cc))) / sum(1.0::DOUBLE / ((n.rr-c.rr)*(n.rr-c.rr)+(n.cc-c.cc)*(n.cc-c.cc))), 4) AS dem FROM fx_dense c JOIN fx_dense n ON n.valid AND NOT c.valid AND (n.rr-c.rr)*(n.rr-c.rr)+(n.cc-c.cc)*(n.cc-c.cc) BETWEEN 1 AND 4 GROUP BY 1, 2",
    "ras45_shift_search": "SELECT b.rr + 1 - a.rr AS dy, b.cc - a.cc AS dx, count(*) AS common FROM fx_cells a JOIN fx_cells b ON a.chm >= 20 AND b.dsm >= 520 AND b.rr + 1 - a.rr BETWEEN -3 AND 3 AND b.cc - a.cc BETWEEN -3 AND 3 GROUP BY 1, 2",
}

QUERIES = {n: f for n, f in list(globals().items()) if n.startswith(("agg", "ras")) and callable(f)}
