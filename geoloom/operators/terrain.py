"""Terrain and vegetation detectors on cell tables: knolls, contours, shadows, colour masks, small regions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.operators import focal, graph
from geoloom.sources.store import written

# Fixed values of the knoll detector.
RING_POINTS, KNOLL_RISE = 16, (1.5, 3.0)


def ring_offsets(radius: float, n: int = RING_POINTS) -> list[tuple[int, int]]:
    """Whole cell offsets around a circle."""
    return sorted({(round(radius * math.sin(2 * math.pi * k / n)), round(radius * math.cos(2 * math.pi * k / n))) for k in range(n)})


def prominences(cells: DataFrame, radius: float, value: str = "v") -> DataFrame:
    """Rise of each cell over the mean and over the highest of a ring around it; the ring must be complete."""
    offsets = ring_offsets(radius)
    base = cells.where(F.col(value).isNotNull()).select("rr", "cc", value)
    ring = focal.shifted(base, [(-dy, -dx) for dy, dx in offsets]).groupBy("rr", "cc").agg(F.avg(value).alias("ring_mean"), F.max(value).alias("ring_max"), F.min(value).alias("ring_min"), F.count("*").alias("n")).where(F.col("n") == len(offsets))
    return base.join(ring, ["rr", "cc"]).select("rr", "cc", (F.col(value) - F.col("ring_mean")).alias("rise"), (F.col(value) - F.col("ring_max")).alias("clear"), (F.col("ring_min") - F.col(value)).alias("sunk"))


def contour_segments(cells: DataFrame, interval: float, value: str = "v") -> DataFrame:
    """Contour segments by marching triangles: each square of four cell centres is two triangles, each level that cuts one gives a segment.

    Squares come from three shifted copies, so no window or self-join over the grid is needed.
    """
    corners = {"a": (0, 0), "b": (0, -1), "c": (-1, 0), "d": (-1, -1)}
    base = cells.where(F.col(value).isNotNull()).select("rr", "cc", value)
    square = focal.shifted(base, list(corners.values())).groupBy("rr", "cc").agg(*(F.max(F.when((F.col("dy") == dy) & (F.col("dx") == dx), F.col(value))).alias(n) for n, (dy, dx) in corners.items()), F.count("*").alias("k")).where("k = 4")
    at = {"a": (0, 0), "b": (0, 1), "c": (1, 0), "d": (1, 1)}
    triangle = lambda p, q, r: F.struct(*(x for n, k in zip("pqr", (p, q, r)) for x in (F.col(k).alias(f"{n}v"), (F.col("rr") + at[k][0]).alias(f"{n}y"), (F.col("cc") + at[k][1]).alias(f"{n}x"))))
    tri = square.select(F.explode(F.array(triangle("a", "b", "c"), triangle("b", "d", "c"))).alias("t")).select("t.*")
    low, high = F.least("pv", "qv", "rv"), F.greatest("pv", "qv", "rv")
    first, last = F.floor(low / interval) + 1, F.ceil(high / interval) - 1
    # a level counts where it lies strictly inside; corners on a level belong to the higher side
    cut = tri.withColumn("k", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))).withColumn("level", F.col("k") * interval)

    def crossing(m: str, n: str) -> Column:
        t = (F.col("level") - F.col(f"{m}v")) / (F.col(f"{n}v") - F.col(f"{m}v"))
        inside = (F.col(f"{m}v") >= F.col("level")) != (F.col(f"{n}v") >= F.col("level"))
        return F.when(inside, F.struct((F.col(f"{m}x") + t * (F.col(f"{n}x") - F.col(f"{m}x"))).alias("x"), (F.col(f"{m}y") + t * (F.col(f"{n}y") - F.col(f"{m}y"))).alias("y")))

    ends = cut.select("level", (F.col("k") % 5 == 0).alias("index"), F.array_compact(F.array(crossing("p", "q"), crossing("q", "r"), crossing("r", "p"))).alias("e"))
    return ends.where(F.size("e") == 2).select("level", "index", F.col("e")[0]["x"].alias("x0"), F.col("e")[0]["y"].alias("y0"), F.col("e")[1]["x"].alias("x1"), F.col("e")[1]["y"].alias("y1"))


def shadow_direction(tall: DataFrame, dark: DataFrame, steps: int = 12, margin: float = 0.12, least: int = 10) -> DataFrame:
    """The direction in which shifted tall cells fall on dark ones most, if it stands out from the median direction."""
    moves = sorted({(d, k, round(-k * math.cos(math.radians(d))), round(k * math.sin(math.radians(d)))) for d in range(0, 360, 10) for k in range(1, steps + 1)})
    o = F.explode(F.array(*(F.struct(F.lit(d).alias("direction"), F.lit(k).alias("k"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for d, k, dy, dx in moves))).alias("o")
    moved = tall.select("rr", "cc", o).select((F.col("rr") + F.col("o.dy")).alias("rr"), (F.col("cc") + F.col("o.dx")).alias("cc"), "o.direction", "o.k")
    shares = moved.join(dark.select("rr", "cc").distinct().withColumn("dark", F.lit(1)), ["rr", "cc"], "left").groupBy("direction", "k").agg((F.sum(F.coalesce("dark", F.lit(0))) / F.count("*")).alias("share"), F.count("*").alias("n")).where(F.col("n") >= least)
    best = shares.groupBy("direction").agg(F.max("share").alias("share"))
    top = best.agg(F.max_by("direction", F.struct("share", -F.col("direction"))).alias("direction"), F.max("share").alias("share"), F.expr("percentile(share, 0.5)").alias("median"))
    return top.withColumn("clear", F.col("share") >= F.col("median") + margin)


def small_regions_merged(cells: DataFrame, width: int, cls: str, least: int, passes: int = 4) -> DataFrame:
    """Regions of fewer than ``least`` cells take the commonest class around them (the smallest one on ties), pass by pass on a snapshot."""
    out = cells.select("rr", "cc", cls)
    for _ in range(passes):
        named = graph.regions(out, width, cls)
        size = named.groupBy("component").agg(F.count("*").alias("n"))
        tiny = named.join(size.where(F.col("n") < least), "component").drop("n")
        if tiny.isEmpty():
            break
        around = focal.shifted(tiny.select("rr", "cc", "component", cls), [(0, 1), (1, 0), (0, -1), (-1, 0)]).drop("dy", "dx").join(named.select("rr", "cc", F.col("component").alias("other"), F.col(cls).alias("new")), ["rr", "cc"]).where("component <> other")
        votes = around.groupBy("component", "new").agg(F.count("*").alias("n"))
        won = votes.groupBy("component").agg(F.min_by("new", F.struct(-F.col("n"), F.col("new"))).alias("new"))
        out = named.join(won, "component", "left").select("rr", "cc", F.coalesce("new", cls).alias(cls))
        out = written(out)
    return out


def settlement_zones(buildings: DataFrame, rows: int, cols: int, size: float, join: float = 20.0, trim: float = 12.0, least: float = 3000.0) -> DataFrame:
    """Building cells grown and shrunk by disks (metres), cut at the grid; 4-connected zones of less than ``least`` m2 go."""
    grown = focal.disk_dilate(buildings.select("rr", "cc").distinct(), max(1, round(join / size))).select("rr", "cc")
    element = focal.disk(max(0, round(trim / size)))
    shrunk = focal.shifted(grown, element).groupBy("rr", "cc").agg(F.count("*").alias("n")).where(F.col("n") == len(element))
    zone = written(shrunk.where(F.col("rr").between(0, rows - 1) & F.col("cc").between(0, cols - 1)).select("rr", "cc"))
    named = graph.regions(zone, cols)
    large = named.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") * size * size >= least)
    return named.join(large, "component", "left_semi").select("rr", "cc")


def holes_filled(mask: DataFrame, rows: int, cols: int, most: int) -> DataFrame:
    """Cells of a mask with its holes of at most ``most`` cells; a hole doesn't touch the grid's edge."""
    from geoloom.operators.grid import grid_dimension

    free = grid_dimension(mask.sparkSession, rows, cols).join(mask.select("rr", "cc"), ["rr", "cc"], "left_anti")
    named = graph.regions(free, cols)
    edge = (F.col("rr") == 0) | (F.col("cc") == 0) | (F.col("rr") == rows - 1) | (F.col("cc") == cols - 1)
    holes = named.groupBy("component").agg(F.count("*").alias("n"), F.max(edge).alias("open")).where((F.col("n") <= most) & ~F.col("open"))
    return mask.select("rr", "cc").unionByName(named.join(holes, "component").select("rr", "cc"))


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value of 0..1 colours."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = F.nullif(high - low, F.lit(0.0))
    hue = F.coalesce(F.when(high == r, F.pmod((g - b) / d, F.lit(6.0))).when(high == g, (b - r) / d + 2).otherwise((r - g) / d + 4) * 60, F.lit(0.0))
    return hue, F.coalesce((high - low) / F.nullif(high, F.lit(0.0)), F.lit(0.0)), high


def colour_class(r: Column, g: Column, b: Column) -> Column:
    """Class of a map pixel by ordered colour rules."""
    h, s, v = hsv(r, g, b)
    return F.when(v < 0.25, "black").when((s < 0.12) & (v > 0.85), "white").when(s < 0.15, "grey").when((h >= 40) & (h < 70), "yellow").when((h >= 70) & (h < 170), "green").when((h >= 170) & (h < 260), "blue").when((h >= 15) & (h < 40), "brown").otherwise("other")


def green_threshold(pixels: DataFrame, cls: str, exg: str, least: int = 400, bounds: tuple[float, float] = (0.02, 0.12), default: float = 0.05) -> DataFrame:
    """Midpoint between the roads' 95th and the grass's 25th percentile; the default for few pixels or classes that overlap."""
    both = pixels.agg(
        F.expr(f"percentile({exg}, 0.95) FILTER (WHERE {cls} = 'road')").alias("road"), F.expr(f"percentile({exg}, 0.25) FILTER (WHERE {cls} = 'grass')").alias("grass"),
        F.sum((F.col(cls) == "road").cast("long")).alias("roads"), F.sum((F.col(cls) == "grass").cast("long")).alias("grasses"),
    )
    good = (F.col("roads") >= least) & (F.col("grasses") >= least) & (F.col("road") < F.col("grass"))
    return both.withColumn("threshold", F.when(good, F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), (F.col("road") + F.col("grass")) / 2))).otherwise(default))
