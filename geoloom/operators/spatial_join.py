"""Spatial joins as equi-joins on grid cells, with exact predicates.

Both sides name the cells that they touch; pairs meet on the cell and are kept in
one cell only, the one that holds the larger of the two boxes' lower corners. So
no result depends on the cell size, no distinct is needed, and a crowded cell is
split by Spark's skew join.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.sources.store import written

CELL = 32.0


def box_cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, size: float = CELL) -> DataFrame:
    """A row for every cell that a box touches."""
    span = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return df.withColumn("__gx", F.explode(span(x0, x1))).withColumn("__gy", F.explode(span(y0, y1)))


def point_cell(df: DataFrame, x: str = "x", y: str = "y", size: float = CELL) -> DataFrame:
    return df.withColumn("__gx", F.floor(F.col(x) / size)).withColumn("__gy", F.floor(F.col(y) / size))


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float = CELL) -> DataFrame:
    """Pairs of points and boxes (x0, y0, x1, y1) with the point inside; lower edges belong to a box. A point has one cell, so pairs come once."""
    b = box_cells(boxes, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size)
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return point_cell(points, size=size).join(b, ["__gx", "__gy"]).where(inside).drop("__gx", "__gy")


def ring_contains(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting over a ring array<struct<x, y>>, closed or not."""
    closed = F.concat(F.slice(ring, F.size(ring), 1), ring)
    edges = F.zip_with(F.slice(closed, 1, F.size(ring)), ring, lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    crosses = F.filter(edges, lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"]))
    return F.size(crosses) % 2 == 1


def within(left: DataFrame, right: DataFrame, distance: float, lx: str = "x", ly: str = "y", rx: str = "rx", ry: str = "ry", on: tuple[str, ...] = (), size: float | None = None) -> DataFrame:
    """Pairs of points at most ``distance`` apart, and equal in ``on``, if given; the left side goes to the 3 x 3 cells around it, or with a cell ``size``
    to those that its reach touches (2 x 2 for twice the distance). Both sides are shuffled: a written table of places packs so well that the planner
    would send millions of them through the driver."""
    near = F.sequence(F.lit(-1), F.lit(1))
    reach = distance + 1e-9  # rounding takes no cell away
    around = lambda c: F.transform(near, lambda d: F.floor(F.col(c) / distance) + d) if size is None else F.sequence(F.floor((F.col(c) - reach) / size), F.floor((F.col(c) + reach) / size))
    l = left.withColumn("__gx", F.explode(around(lx))).withColumn("__gy", F.explode(around(ly)))  # noqa: E741
    r = point_cell(right, rx, ry, size or distance)
    d2 = (F.col(lx) - F.col(rx)) ** 2 + (F.col(ly) - F.col(ry)) ** 2
    if on:
        l, r = dealt(l, "__gx", "__gy", *on), dealt(r, "__gx", "__gy", *on)  # noqa: E741
    return l.join(r.hint("merge"), ["__gx", "__gy", *on]).where(d2 <= distance * distance).withColumn("d2", d2).drop("__gx", "__gy")


#: Sectors of a circle: what lies within 31 degrees of a direction is in two sectors at most.
SECTORS = 5


def sector(dx: Column, dy: Column) -> Column:
    """The sector of a direction."""
    return _sector_at(F.atan2(dy, dx) / (2 * math.pi))


def _sector_at(turn: Column) -> Column:
    return F.pmod(F.floor((turn + 0.5) * SECTORS), F.lit(SECTORS))


def sectors_opposite(dx: Column, dy: Column) -> Column:
    """The sectors of all directions that turn by 149 degrees and more from this one: one or two, since each is a copy in a join."""
    turn = F.atan2(-dy, -dx) / (2 * math.pi)
    return F.array_distinct(F.array(_sector_at(turn - 31 / 360), _sector_at(turn + 31 / 360)))


def overlaps(a: DataFrame, b: DataFrame, size: float = CELL) -> DataFrame:
    """Pairs of boxes (columns a_* and b_*: fid, x0, y0, x1, y1) with positive common area, and that area."""
    names = ("fid", "x0", "y0", "x1", "y1")
    left = box_cells(a.select(*(F.col(c).alias(f"a_{c}") for c in names)), F.col("a_x0"), F.col("a_y0"), F.col("a_x1"), F.col("a_y1"), size)
    right = box_cells(b.select(*(F.col(c).alias(f"b_{c}") for c in names)), F.col("b_x0"), F.col("b_y0"), F.col("b_x1"), F.col("b_y1"), size)
    lx, ly = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    w, h = F.least("a_x1", "b_x1") - lx, F.least("a_y1", "b_y1") - ly
    owner = (F.floor(lx / size) == F.col("__gx")) & (F.floor(ly / size) == F.col("__gy"))
    return left.join(right, ["__gx", "__gy"]).where((w > 0) & (h > 0) & owner).select(*(f"a_{c}" for c in names), *(f"b_{c}" for c in names), (w * h).alias("common"))


#: The corners of a box, which name its shape.
BOX = ("x0", "y0", "x1", "y1")


def shapes(boxes: DataFrame, *also: str) -> DataFrame:
    """Boxes of equal corners (and equal ``also``) once, with the number ``n`` of their rows."""
    return boxes.groupBy(*BOX, *also).agg(F.count("*").alias("n"))


def shape_overlaps(a: DataFrame, b: DataFrame, *also: str, size: float = CELL) -> DataFrame:
    """Pairs of shapes with positive common area: the corners of ``a``'s, those of ``b``'s as b_*, ``common``, ``also`` of ``b`` and its rows ``n``.

    Copies lie over each other in any number without more pairs: join what a shape is given to its rows by ``BOX``.
    """
    left = a.select(*BOX).distinct().withColumn("fid", F.lit(0))
    right = shapes(b, *also).withColumn("fid", F.struct("n", *also))
    met = overlaps(left, right, size)
    return met.select(*(F.col(f"a_{c}").alias(c) for c in BOX), *(f"b_{c}" for c in BOX), "common", "b_fid.*")


def inside(points: DataFrame, boxes: DataFrame, size: float = 8.0, also: Column | None = None, how: str = "left_semi") -> DataFrame:
    """Points (x, y) in any box (that meets the condition ``also``), or with ``left_anti`` those in none. Each shape is there once, and a
    point's first hit ends its search. The shapes' cells are written first: the planner then knows whether they are few enough to send around."""
    shape = shapes(boxes).drop("n")
    cells = written(box_cells(shape, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size))
    met = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    p = point_cell(points, size=size).withColumnsRenamed({"__gx": "__px", "__gy": "__py"})
    on = (F.col("__px") == F.col("__gx")) & (F.col("__py") == F.col("__gy")) & met
    return p.join(cells, on if also is None else on & also, how).drop("__px", "__py")


def segment_distance2(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance from a point to a segment. It divides by the square of the length, as SQL over segments with a length does, so that equal distances stay equal."""
    dx, dy = bx - ax, by - ay
    length = F.sqrt(dx * dx + dy * dy)
    t = F.coalesce(((px - ax) * dx + (py - ay) * dy) / F.nullif(length * length, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return (px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2


def _reached(segments: DataFrame, distance: float, size: float) -> DataFrame:
    """A row for every cell with a point at most ``distance`` from a segment, and few more: row by row, the stretch of cells that the segment reaches there."""
    reach = distance + 1e-9  # rounding takes no cell away
    rows = segments.withColumn("__gy", F.explode(F.sequence(F.floor((F.least("ay", "by") - reach) / size), F.floor((F.greatest("ay", "by") + reach) / size))))
    dy = F.nullif(F.col("by") - F.col("ay"), F.lit(0.0))
    t = lambda edge: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (edge - F.col("ay")) / dy))
    x_at = lambda edge, level: F.when(F.col("ay") == F.col("by"), F.col(level)).otherwise(F.col("ax") + t(edge) * (F.col("bx") - F.col("ax")))
    ends = rows.withColumn("__p", x_at(F.col("__gy") * size - reach, "ax")).withColumn("__q", x_at((F.col("__gy") + 1) * size + reach, "bx"))
    r = ends.withColumn("__gx", F.explode(F.sequence(F.floor((F.least("__p", "__q") - reach) / size), F.floor((F.greatest("__p", "__q") + reach) / size)))).drop("__p", "__q")
    cx, cy = (F.col("__gx") + 0.5) * size, (F.col("__gy") + 0.5) * size
    far = distance + size * 0.7072
    return r.where(segment_distance2(cx, cy, F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= far * far)


def near_segments(samples: DataFrame, segments: DataFrame, distance: float, size: float | None = None) -> DataFrame:
    """Pairs of samples (x, y) and segments (ax, ay, bx, by) at most ``distance`` apart; cells are twice that wide."""
    size = size or 2.0 * distance
    d2 = segment_distance2(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return point_cell(samples, size=size).join(_reached(segments, distance, size), ["__gx", "__gy"]).withColumn("d2", d2).where(F.col("d2") <= distance * distance).drop("__gx", "__gy")


#: Slices of 64 in which rounds take others: where these are dense, the first slice answers nearly all.
SLICES = ((0, 1), (1, 8), (8, 64))


def _first_hits(samples: DataFrame, others: DataFrame, deal: list[str], size: float, cells: Callable[[DataFrame], DataFrame], met: Column) -> DataFrame:
    """Samples (x, y) with one of the others in their cell that meets the condition. Semi joins, so a sample's first hit ends its search.

    Equal others are there once. They come in growing slices by a hash, each once; samples that a slice hits ask no further, and a slice goes into the
    cells of open samples only. So however dense the others are, most of them meet the few samples that hardly any of them reaches.
    """
    on = (F.col("__sx") == F.col("__gx")) & (F.col("__sy") == F.col("__gy")) & met
    dealt = written(others.distinct().withColumn("__s", F.pmod(F.xxhash64(*deal), F.lit(64))))
    open_ = written(point_cell(samples, size=size).withColumnsRenamed({"__gx": "__sx", "__gy": "__sy"}).withColumn("__i", F.monotonically_increasing_id()))
    hits = []
    for low, high in SLICES:
        asked = written(open_.select(F.col("__sx").alias("__gx"), F.col("__sy").alias("__gy")).distinct())
        near = cells(dealt.where(f"__s >= {low} and __s < {high}").drop("__s")).join(asked, ["__gx", "__gy"], "left_semi")
        hits.append(written(open_.join(near.hint("merge"), on, "left_semi")))
        if high < SLICES[-1][1]:
            open_ = written(open_.join(hits[-1].select("__i"), "__i", "left_anti"))
            if open_.isEmpty():
                break
    return reduce(DataFrame.unionByName, hits).drop("__sx", "__sy", "__i")


def beside_segments(samples: DataFrame, segments: DataFrame, distance: float, also: Column | None = None) -> DataFrame:
    """Samples (x, y) that have a segment at most ``distance`` away that meets the condition ``also``, by their first hits."""
    size = max(2.0 * distance, 2.0)
    met = segment_distance2(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= distance * distance
    return _first_hits(samples, segments, ["ax", "ay", "bx", "by"], size, lambda s: _reached(s, distance, size), met if also is None else met & also)


def _around(others: DataFrame, distance: float) -> DataFrame:
    """A row for each of the 3 x 3 cells around every point (rx, ry)."""
    steps = F.sequence(F.lit(-1), F.lit(1))
    wide = others.withColumn("__gx", F.explode(F.transform(steps, lambda k: F.floor(F.col("rx") / distance) + k)))
    return wide.withColumn("__gy", F.explode(F.transform(steps, lambda k: F.floor(F.col("ry") / distance) + k)))


def beside(points: DataFrame, others: DataFrame, distance: float, **on: str) -> DataFrame:
    """Points (x, y) with one of the others (rx, ry) at most ``distance`` away, by their first hits; ``on`` names a column of the points for each of the
    others' columns that has to be equal."""
    met = (F.col("x") - F.col("rx")) ** 2 + (F.col("y") - F.col("ry")) ** 2 <= distance * distance
    for theirs, own in on.items():
        met &= F.col(theirs) == F.col(own)
    return _first_hits(points, others.select("rx", "ry", *on), ["rx", "ry"], distance, lambda o: _around(o, distance), met)


def away_from(points: DataFrame, others: DataFrame, distance: float) -> DataFrame:
    """Points (x, y) with none of the others (rx, ry) within ``distance``: an anti join, so the first hit ends a point's search."""
    steps = F.sequence(F.lit(-1), F.lit(1))
    around = others.select("rx", "ry", F.explode(F.transform(steps, lambda k: F.floor(F.col("rx") / distance) + k)).alias("__gx"), F.floor(F.col("ry") / distance).alias("__y"))
    around = around.select("rx", "ry", "__gx", F.explode(F.transform(steps, lambda k: F.col("__y") + k)).alias("__gy"))
    p = point_cell(points, size=distance).withColumnsRenamed({"__gx": "__px", "__gy": "__py"})
    near = (F.col("x") - F.col("rx")) ** 2 + (F.col("y") - F.col("ry")) ** 2 <= distance * distance
    return p.join(around.hint("merge"), (F.col("__px") == F.col("__gx")) & (F.col("__py") == F.col("__gy")) & near, "left_anti").drop("__px", "__py")


def away_from_segments(points: DataFrame, segments: DataFrame, distance: float) -> DataFrame:
    """Points (x, y) with no segment within ``distance``. Segments are followed into the cells of points only, which are known before."""
    size = 2.0 * distance
    p = written(point_cell(points, size=size).withColumnsRenamed({"__gx": "__px", "__gy": "__py"}))
    asked = written(p.select(F.col("__px").alias("__gx"), F.col("__py").alias("__gy")).distinct())
    reached = _reached(segments, distance, size).join(asked, ["__gx", "__gy"], "left_semi")
    near = segment_distance2(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= distance * distance
    return p.join(reached.hint("merge"), (F.col("__px") == F.col("__gx")) & (F.col("__py") == F.col("__gy")) & near, "left_anti").drop("__px", "__py")


def beside_any(samples: DataFrame, segments: DataFrame, distance: float) -> DataFrame:
    """Samples (x, y) with a segment (ax, ay, bx, by) within ``distance``, in two passes.

    Squares that a segment covers whole hold hits only. A 64th of the segments, by a hash, tells most of them where lines are dense; what lies in
    none of these squares is asked for against all segments. So however dense the lines are, the second pass is for the places that few reach.
    """
    some = segments.where(F.pmod(F.xxhash64("ax", "ay", "bx", "by"), F.lit(64)) == 0)
    size = distance / 4
    cells = _reached(some, distance, size)
    cx, cy = (F.col("__gx") + 0.5) * size, (F.col("__gy") + 0.5) * size
    near = distance - size * 0.7072
    whole = written(cells.where(segment_distance2(cx, cy, F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= near * near).select("__gx", "__gy").distinct())
    placed = point_cell(samples, size=size)
    sure = placed.join(whole, ["__gx", "__gy"], "left_semi").drop("__gx", "__gy")
    open_ = written(placed.join(whole, ["__gx", "__gy"], "left_anti").drop("__gx", "__gy"))
    wide = 2.0 * distance
    p = point_cell(open_, size=wide).withColumnsRenamed({"__gx": "__px", "__gy": "__py"})
    asked = written(p.select(F.col("__px").alias("__gx"), F.col("__py").alias("__gy")).distinct())
    reached = _reached(segments, distance, wide).join(asked, ["__gx", "__gy"], "left_semi")
    met = segment_distance2(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= distance * distance
    rest = p.join(reached.hint("merge"), (F.col("__px") == F.col("__gx")) & (F.col("__py") == F.col("__gy")) & met, "left_semi").drop("__px", "__py")
    return sure.unionByName(rest)


def by_cell(cells: DataFrame) -> DataFrame:
    """Rows dealt by their cell into a fixed number of partitions: where few bytes meet in many pairs, small partitions must not be put together."""
    return dealt(cells, "__gx", "__gy")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The same by any keys."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def segment_cells(segments: DataFrame, ax: str, ay: str, bx: str, by: str, size: float = CELL) -> DataFrame:
    """A row for every cell that a segment comes near; long slanting ones touch few of their box's cells."""
    boxed = box_cells(segments, F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by), size)
    far = 0.75 * size  # a little more than half a cell's diagonal
    return boxed.where(segment_distance2((F.col("__gx") + 0.5) * size, (F.col("__gy") + 0.5) * size, F.col(ax), F.col(ay), F.col(bx), F.col(by)) <= far * far)


def crossings(a: DataFrame, b: DataFrame, size: float = CELL) -> DataFrame:
    """Pairs of segments (a_id, a_seg, ax, ay, bx, by) and (b_id, b_seg, cx, cy, dx, dy) that properly cross; the cell of the crossing keeps the pair."""
    ca, cb = segment_cells(a, "ax", "ay", "bx", "by", size), segment_cells(b, "cx", "cy", "dx", "dy", size)
    side = lambda px, py, qx, qy, rx, ry: (F.col(qx) - F.col(px)) * (F.col(ry) - F.col(py)) - (F.col(qy) - F.col(py)) * (F.col(rx) - F.col(px))
    from_a, to_a = side("cx", "cy", "dx", "dy", "ax", "ay"), side("cx", "cy", "dx", "dy", "bx", "by")
    cross = (side("ax", "ay", "bx", "by", "cx", "cy") * side("ax", "ay", "bx", "by", "dx", "dy") < 0) & (from_a * to_a < 0)
    t = from_a / (from_a - to_a)

    def at(p: str, q: str, r: str, s: str) -> Column:
        """The crossing's coordinate, within both boxes."""
        return F.least(F.greatest(F.col(p) + t * (F.col(q) - F.col(p)), F.least(p, q), F.least(r, s)), F.greatest(p, q), F.greatest(r, s))

    owner = (F.floor(at("ax", "bx", "cx", "dx") / size) == F.col("__gx")) & (F.floor(at("ay", "by", "cy", "dy") / size) == F.col("__gy"))
    ca, cb = by_cell(ca), by_cell(cb)
    return ca.join(cb, ["__gx", "__gy"]).where(F.when(cross, owner).otherwise(False)).drop("__gx", "__gy")


def crossing(a: DataFrame, b: DataFrame, size: float = CELL) -> DataFrame:
    """Segments (ax, ay, bx, by) with a segment of ``b`` (cx, cy, dx, dy) that properly crosses them, once a cell at most: a semi join, so the first hit in a cell ends the search there."""
    side = lambda px, py, qx, qy, rx, ry: (F.col(qx) - F.col(px)) * (F.col(ry) - F.col(py)) - (F.col(qy) - F.col(py)) * (F.col(rx) - F.col(px))
    met = (side("ax", "ay", "bx", "by", "cx", "cy") * side("ax", "ay", "bx", "by", "dx", "dy") < 0) & (side("cx", "cy", "dx", "dy", "ax", "ay") * side("cx", "cy", "dx", "dy", "bx", "by") < 0)
    ca = by_cell(segment_cells(a, "ax", "ay", "bx", "by", size)).withColumnsRenamed({"__gx": "__sx", "__gy": "__sy"})
    cb = by_cell(segment_cells(b, "cx", "cy", "dx", "dy", size))
    return ca.join(cb, (F.col("__sx") == F.col("__gx")) & (F.col("__sy") == F.col("__gy")) & met, "left_semi").drop("__sx", "__sy")


def nearest(left: DataFrame, right: DataFrame, key: str, distance: float, lx: str = "x", ly: str = "y", rx: str = "rx", ry: str = "ry") -> DataFrame:
    """The least distance within reach for each left key.

    Places meet once, within a 64th of the distance at first and four times as far each round; those that have found another ask no further. So
    where points lie dense, a place meets the few around it only.
    """
    others = written(right.select(rx, ry).distinct())
    open_ = written(left.select(lx, ly).where(F.col(lx).isNotNull() & F.col(ly).isNotNull()).distinct())
    found = []
    for part in (64, 16, 4, 1):
        found.append(written(within(open_, others, distance / part, lx, ly, rx, ry).groupBy(lx, ly).agg(F.min("d2").alias("d2"))))
        if part > 1:
            open_ = written(open_.join(found[-1].hint("merge"), [lx, ly], "left_anti"))
            if open_.isEmpty():
                break
    return left.join(reduce(DataFrame.unionByName, found).hint("merge"), [lx, ly]).groupBy(key).agg(F.sqrt(F.min("d2")).alias("distance"))
