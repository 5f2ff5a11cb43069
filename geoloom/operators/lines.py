"""Lines against boxes, bands and other lines: clipping, cutting, simplifying, smoothing, covering."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators import graph, sequence
from geoloom.operators import spatial_join as J
from geoloom.sources.store import written


def clip_range(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """The part of a segment (ax, ay, bx, by) inside a box, as parameters from 0 to 1; empty where the first is not below the second."""
    t0, t1 = [F.lit(0.0)], [F.lit(1.0)]
    for a, b, low, high in (("ax", "bx", x0, x1), ("ay", "by", y0, y1)):
        d = F.col(b) - F.col(a)
        at = lambda edge: (edge - F.col(a)) / F.nullif(d, F.lit(0.0))  # noqa: B023, E731
        outside = (F.col(a) < low) | (F.col(a) > high)
        t0.append(F.when(d == 0, F.when(outside, 2.0).otherwise(0.0)).otherwise(F.least(at(low), at(high))))
        t1.append(F.when(d == 0, F.lit(1.0)).otherwise(F.greatest(at(low), at(high))))
    return F.greatest(*t0), F.least(*t1)


def clipped(segments: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Segments inside one rectangle, cut at its edges."""
    a, b = clip_range(*(F.lit(float(v)) for v in (x0, y0, x1, y1)))
    near = (F.least("ax", "bx") <= x1) & (F.greatest("ax", "bx") >= x0) & (F.least("ay", "by") <= y1) & (F.greatest("ay", "by") >= y0)
    cut = segments.where(near).withColumn("t0", a).withColumn("t1", b).where("t0 < t1")
    at = lambda t, p, q: F.col(p) + F.col(t) * (F.col(q) - F.col(p))
    return cut.select("*", at("t0", "ax", "bx").alias("cx"), at("t0", "ay", "by").alias("cy"), at("t1", "ax", "bx").alias("dx"), at("t1", "ay", "by").alias("dy"))


def clipped_ring(ring: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """A ring array<struct<x, y>> cut by a rectangle, one edge after the other (Sutherland and Hodgman)."""
    for axis, limit, sign in (("x", x0, 1), ("x", x1, -1), ("y", y0, 1), ("y", y1, -1)):
        other = "y" if axis == "x" else "x"
        inside = lambda p: (p[axis] - limit) * sign >= 0  # noqa: B023, E731

        def crossing(p, q):
            t = (F.lit(float(limit)) - p[axis]) / F.nullif(q[axis] - p[axis], F.lit(0.0))  # noqa: B023
            parts = {axis: F.lit(float(limit)), other: p[other] + t * (q[other] - p[other])}  # noqa: B023
            return F.struct(parts["x"].alias("x"), parts["y"].alias("y"))

        def step(p, q):
            own = F.struct(q["x"].alias("x"), q["y"].alias("y"))
            return F.when(inside(q), F.when(inside(p), F.array(own)).otherwise(F.array(crossing(p, q), own))).otherwise(F.when(inside(p), F.array(crossing(p, q))).otherwise(F.slice(F.array(own), 1, 0)))  # noqa: B023

        cut = lambda r: F.flatten(F.zip_with(F.slice(F.concat(F.slice(r, -1, 1), r), 1, F.size(r)), r, step))  # noqa: B023, E731
        ring = F.element_at(F.transform(F.array(ring), lambda r: F.when(F.size(r) > 0, cut(r)).otherwise(r)), 1)  # a name for the ring, so that it is worked out once
    return ring


def in_boxes(segments: DataFrame, boxes: DataFrame, size: float = J.CELL) -> DataFrame:
    """Pairs of segments and boxes (x0, y0, x1, y1) with the segment's part inside: t0 below t1. The cell of the part's beginning keeps a pair."""
    s = J.segment_cells(segments, "ax", "ay", "bx", "by", size)
    b = J.box_cells(boxes, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size)
    t0, t1 = clip_range(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    # the part's lower left corner lies in both, up to rounding, which the clamps take away
    low = lambda p, q, a: F.greatest(F.least(F.col(p) + F.col("t0") * (F.col(q) - F.col(p)), F.greatest(p, q), F.col(a.replace("0", "1"))), F.least(p, q), F.col(a))
    owner = (F.floor(low("ax", "bx", "x0") / size) == F.col("__gx")) & (F.floor(low("ay", "by", "y0") / size) == F.col("__gy"))
    met = J.by_cell(s).join(J.by_cell(b), ["__gx", "__gy"]).where(t0 < t1)
    # a generator of one row keeps the two expressions from being written out at every use, in code too long to be compiled
    parts = met.select("*", F.explode(F.array(F.struct(t0.alias("t0"), t1.alias("t1")))).alias("__t")).select("*", "__t.t0", "__t.t1")
    return parts.where(owner).drop("__gx", "__gy", "__t")


def dissolved(boxes: DataFrame, leaf: float = 2.0, levels: int = 3) -> DataFrame:
    """Boxes (x0, y0, x1, y1) with the same union and few overlaps: squares of ``leaf`` that a box covers whole, put together by four where
    all are covered, and the parts of boxes in the other squares. However many boxes lie over each other, a place is in one square."""
    cell = boxes.select("x0", "y0", "x1", "y1")
    # a box that ends on a square's edge doesn't reach into it
    span = lambda a, b: F.sequence(F.floor(F.col(a) / leaf), F.greatest(F.ceil(F.col(b) / leaf) - 1, F.floor(F.col(a) / leaf)))
    cell = cell.withColumn("gx", F.explode(span("x0", "x1"))).withColumn("gy", F.explode(span("y0", "y1")))
    low = lambda a, g: F.greatest(F.col(a), F.col(g) * leaf)
    high = lambda b, g: F.least(F.col(b), (F.col(g) + 1) * leaf)
    part = cell.select("gx", "gy", low("x0", "gx").alias("x0"), low("y0", "gy").alias("y0"), high("x1", "gx").alias("x1"), high("y1", "gy").alias("y1"))
    whole = (F.col("x1") - F.col("x0") >= leaf) & (F.col("y1") - F.col("y0") >= leaf)
    part = written(part.withColumn("whole", whole).distinct())
    full = part.where("whole").select("gx", "gy")
    out = part.where("not whole").join(full, ["gx", "gy"], "left_anti").select("x0", "y0", "x1", "y1")
    size = leaf
    for _ in range(levels):
        up = full.groupBy(F.floor(F.col("gx") / 2).alias("ux"), F.floor(F.col("gy") / 2).alias("uy")).agg(F.count("*").alias("n")).where("n = 4").select("ux", "uy")
        rest = full.join(up, (F.floor(F.col("gx") / 2) == F.col("ux")) & (F.floor(F.col("gy") / 2) == F.col("uy")), "left_anti")
        out = out.unionByName(_squares(rest, size))
        full, size = up.toDF("gx", "gy"), size * 2
    return out.unionByName(_squares(full, size))


def _squares(cells: DataFrame, size: float) -> DataFrame:
    return cells.select((F.col("gx") * size).alias("x0"), (F.col("gy") * size).alias("y0"), ((F.col("gx") + 1) * size).alias("x1"), ((F.col("gy") + 1) * size).alias("y1"))


def inside_spans(segments: DataFrame, boxes: DataFrame) -> DataFrame:
    """(line_id, pos, m0, len, s0, s1): the measures at which each segment runs inside any of the boxes, overlaps merged."""
    keys = ["line_id", "pos"]
    met = in_boxes(segments.where("len > 0"), J.shapes(boxes)).select(*keys, "m0", "len", (F.col("m0") + F.col("t0") * F.col("len")).alias("s0"), (F.col("m0") + F.col("t1") * F.col("len")).alias("s1"))
    return merged(met, keys, ["m0", "len"])


def merged(spans: DataFrame, keys: list[str], also: list[str] = []) -> DataFrame:  # noqa: B006
    """Spans (s0, s1) of each key with those that overlap or touch made one."""
    w = Window.partitionBy(*keys).orderBy("s0", "s1")
    reach = F.max("s1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("__new", F.when(F.col("s0") <= reach, 0).otherwise(1))
    return new.withColumn("__n", F.sum("__new").over(w)).groupBy(*keys, *also, "__n").agg(F.min("s0").alias("s0"), F.max("s1").alias("s1")).drop("__n")


def joined_around(spans: DataFrame, keys: list[str], at: float, gap: float = 1e-9) -> DataFrame:
    """(keys, s0, s1): of each key's spans, joined where they overlap or touch, the one that holds the measure ``at``."""
    w = Window.partitionBy(*keys).orderBy("s0", "s1")
    reach = F.max("s1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("__new", F.when(F.col("s0") <= reach + gap, 0).otherwise(1)).withColumn("__n", F.sum("__new").over(w))
    return new.groupBy(*keys, "__n").agg(F.min("s0").alias("s0"), F.max("s1").alias("s1")).where((F.col("s0") <= at) & (F.col("s1") >= at)).drop("__n")


def outside_spans(segments: DataFrame, boxes: DataFrame, least: float = 0.0) -> DataFrame:
    """(line_id, s0, s1): the measures between which a line runs outside all boxes, joined over vertices; pieces shorter than ``least`` go."""
    whole = segments.where("len > 0").select("line_id", "pos", F.col("m0").alias("a"), (F.col("m0") + F.col("len")).alias("b"))
    inside = written(inside_spans(segments, boxes))
    w = Window.partitionBy("line_id", "pos").orderBy("s0")
    cuts = inside.select("line_id", "pos", F.col("s0"), F.col("s1"), F.lag("s1").over(w).alias("before"), F.lead("s0").over(w).alias("after"))
    gaps = cuts.join(whole, ["line_id", "pos"]).select("line_id", F.explode(F.array(F.struct(F.coalesce("before", "a").alias("s0"), F.col("s0").alias("s1")), F.when(F.col("after").isNull(), F.struct(F.col("s1").alias("s0"), F.col("b").alias("s1"))))).alias("g")).where("g is not null").select("line_id", "g.s0", "g.s1")
    free = whole.join(inside.select("line_id", "pos").distinct(), ["line_id", "pos"], "left_anti").select("line_id", F.col("a").alias("s0"), F.col("b").alias("s1"))
    pieces = gaps.where("s1 - s0 > 1e-9").unionByName(free)
    return joined(pieces, ["line_id"]).where(F.col("s1") - F.col("s0") >= least)


def joined(spans: DataFrame, keys: list[str], gap: float = 1e-6) -> DataFrame:
    """Spans whose ends meet, up to ``gap``, made one."""
    w = Window.partitionBy(*keys).orderBy("s0", "s1")
    new = spans.withColumn("__new", F.when(F.col("s0") - F.lag("s1").over(w) <= gap, 0).otherwise(1))
    return new.withColumn("__n", F.sum("__new").over(w)).groupBy(*keys, "__n").agg(F.min("s0").alias("s0"), F.max("s1").alias("s1")).drop("__n")


def simplified(vertices: DataFrame, tolerance: float) -> DataFrame:
    """(line_id, pos) of the vertices that stay (Douglas and Peucker): each round splits every span at its farthest vertex, if that is off by more than ``tolerance``.

    Rounds are few (a span's depth of splits), and each reads the open spans alone.
    """
    v = written(vertices.select("line_id", "pos", "x", "y"))
    at = F.struct("pos", "x", "y")
    ends = written(v.groupBy("line_id").agg(F.min_by(at, "pos").alias("a"), F.max_by(at, "pos").alias("b")))
    kept = ends.select("line_id", F.explode(F.array("a.pos", "b.pos")).alias("pos"))
    spans = ends.where("b.pos - a.pos > 1")
    while not spans.isEmpty():
        d2 = J.segment_distance2(F.col("x"), F.col("y"), F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
        inner = spans.join(v, "line_id").where("pos > a.pos and pos < b.pos").withColumn("d2", d2)
        far = inner.groupBy("line_id", "a", "b").agg(F.max(F.struct("d2", -F.col("pos"))).alias("far"), F.max_by(at, F.struct("d2", -F.col("pos"))).alias("m")).where(F.col("far.d2") > tolerance * tolerance)
        far = written(far.select("line_id", "a", "b", "m"))
        kept = kept.unionByName(far.select("line_id", "m.pos"))
        halves = far.select("line_id", F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("m").alias("a"), "b"))).alias("s")).select("line_id", "s.a", "s.b")
        spans = halves.where("b.pos - a.pos > 1")
    return kept.distinct()


def corners_cut(vertices: DataFrame, rounds: int = 2) -> DataFrame:
    """(line_id, pos, x, y): corners cut at a quarter and three quarters of every segment (Chaikin); ends stay, as do lines of fewer than three vertices."""
    out = vertices.select("line_id", F.col("pos").cast("long").alias("pos"), "x", "y")
    for _ in range(rounds):
        w = Window.partitionBy("line_id").orderBy("pos")
        n = F.count("*").over(Window.partitionBy("line_id"))
        nth = out.select("line_id", "x", "y", (F.row_number().over(w) - 1).cast("long").alias("i"), n.alias("n"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"))
        mix = lambda k, f: F.struct((F.col("i") * 2 + k).alias("pos"), (F.col("x") * f + F.col("x1") * (1 - f)).alias("x"), (F.col("y") * f + F.col("y1") * (1 - f)).alias("y"))
        own = lambda k: F.struct(k.alias("pos"), "x", "y")
        first, last = F.when(F.col("i") == 0, own(F.lit(0).cast("long"))), F.when(F.col("x1").isNull(), own(F.col("n") * 2 - 1))
        points = F.when(F.col("n") < 3, F.array(own(F.col("i")))).otherwise(F.array(first, F.when(F.col("x1").isNotNull(), mix(1, 0.75)), F.when(F.col("x1").isNotNull(), mix(2, 0.25)), last))
        out = nth.select("line_id", F.explode(points).alias("p")).where("p is not null").select("line_id", "p.*")
    return out


def smoothed_rings(vertices: DataFrame, sigma: float, most: float, radius: int = 2) -> DataFrame:
    """(line_id, pos, x, y): each ring's vertices moved to the Gaussian mean of their neighbours around it, by ``most`` at the farthest, then scaled from its centre so that its area stays (by 5 % at most)."""
    w = Window.partitionBy("line_id")
    base = vertices.select("line_id", (F.row_number().over(w.orderBy("pos")) - 1).alias("i"), F.count("*").over(w).alias("n"), "x", "y").where("n >= 4")
    weights = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(math.exp(-0.5 * (k / sigma) ** 2)).alias("w")) for k in range(-radius, radius + 1)))
    sent = base.select("line_id", "n", "x", "y", "i", F.explode(weights).alias("o")).select("line_id", F.pmod(F.col("i") + F.col("o.k"), F.col("n")).alias("i"), "o.w", (F.col("x") * F.col("o.w")).alias("wx"), (F.col("y") * F.col("o.w")).alias("wy"))
    mean = sent.groupBy("line_id", "i").agg((F.sum("wx") / F.sum("w")).alias("mx"), (F.sum("wy") / F.sum("w")).alias("my"))
    off = F.hypot(F.col("mx") - F.col("x"), F.col("my") - F.col("y"))
    share = F.when(off > most, most / off).otherwise(1.0)
    moved = base.join(mean, ["line_id", "i"]).select("line_id", "i", "x", "y", (F.col("x") + share * (F.col("mx") - F.col("x"))).alias("sx"), (F.col("y") + share * (F.col("my") - F.col("y"))).alias("sy"))
    order = w.orderBy("i")
    nxt = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(order))
    part = lambda x, y: F.col(x) * nxt(y) - nxt(x) * F.col(y)
    areas = moved.withColumn("a0", part("x", "y")).withColumn("a1", part("sx", "sy")).withColumn("cx", F.avg("sx").over(w)).withColumn("cy", F.avg("sy").over(w)).withColumn("A0", F.abs(F.sum("a0").over(w))).withColumn("A1", F.abs(F.sum("a1").over(w)))
    f = F.coalesce(F.greatest(F.lit(0.95), F.least(F.lit(1.05), F.sqrt(F.col("A0") / F.nullif("A1", F.lit(0.0))))), F.lit(1.0))
    return areas.select("line_id", F.col("i").alias("pos"), (F.col("cx") + f * (F.col("sx") - F.col("cx"))).alias("x"), (F.col("cy") + f * (F.col("sy") - F.col("cy"))).alias("y"))


def band_cells(segments: DataFrame, radius: float, size: float, *keep: str) -> DataFrame:
    """Cells (rr, cc) whose centre is at most ``radius`` from a segment: row by row, only the stretch that the segment's band can reach."""
    low, high = F.least("ay", "by") - radius, F.greatest("ay", "by") + radius
    rows = segments.withColumn("rr", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    y = (F.col("rr") + 0.5) * size
    d = F.nullif(F.col("by") - F.col("ay"), F.lit(0.0))
    t = lambda edge: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (edge - F.col("ay")) / d))
    x_at = lambda edge, other: F.coalesce(F.col("ax") + t(edge) * (F.col("bx") - F.col("ax")), F.col(other))
    one, two = x_at(y - radius, "ax"), x_at(y + radius, "bx")
    spread = rows.withColumn("cc", F.explode(F.sequence(F.floor((F.least(one, two) - radius) / size), F.floor((F.greatest(one, two) + radius) / size))))
    x = (F.col("cc") + 0.5) * size
    return spread.where(J.segment_distance2(x, y, F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= radius * radius).select("rr", "cc", *keep)


def _directed(segments: DataFrame, *keep: str) -> DataFrame:
    ux, uy = (F.col("bx") - F.col("ax")) / F.col("len"), (F.col("by") - F.col("ay")) / F.col("len")
    return segments.where("len > 0").select("ax", "ay", "bx", "by", ux.alias("ux"), uy.alias("uy"), *keep)


def _like(least_cos: float) -> Column:
    return F.abs(F.col("tx") * F.col("ux") + F.col("ty") * F.col("uy")) >= least_cos


def covered_stations(samples: DataFrame, segments: DataFrame, distance: float, least_cos: float = 0.0) -> DataFrame:
    """(line_id, k): stations (x, y, tx, ty) with a segment within ``distance`` whose direction differs by no more than the cosine allows."""
    return J.beside_segments(samples, _directed(segments), distance, _like(least_cos)).select("line_id", "k")


def covering_lines(samples: DataFrame, segments: DataFrame, distance: float, by: str, least_cos: float = 0.0) -> DataFrame:
    """(line_id, k, ``by``): the same with every line that covers a station."""
    return J.near_segments(samples, _directed(segments, by), distance).where(_like(least_cos)).select("line_id", "k", by).distinct()


def _cover_counts(seg: DataFrame, others: DataFrame, step: float, distance: float, least_cos: float) -> DataFrame:
    """(line_id, by_line, hits): how many of a line's stations each of the other lines covers."""
    st = sequence.stations(seg, step).select("line_id", "k", "x", "y", "tx", "ty")
    hit = covering_lines(st, others.withColumnRenamed("line_id", "by_line"), distance, "by_line", least_cos).where("line_id <> by_line")
    return hit.groupBy("line_id", "by_line").agg(F.count("*").alias("hits"))


def _of(seg: DataFrame, lines: DataFrame) -> DataFrame:
    return seg.join(lines.select("line_id"), "line_id", "left_semi")


def not_outdone(seg: DataFrame, step: float, distance: float, share: float, least_cos: float = 0.0) -> DataFrame:
    """(line_id, stations): lines of which no longer line covers ``share`` of the stations or more.

    The longest lines are asked first, then more of them each time; a line that one covers asks no further, nor does one as long as those to come.
    """
    seg = written(seg.select("line_id", "ax", "ay", "bx", "by", "len", "m0"))
    total = written(seg.groupBy("line_id").agg(F.round(F.sum("len"), 6).alias("total")))
    left = written(sequence.stations(seg, step).groupBy("line_id").agg(F.count("*").alias("stations")).join(total, "line_id"))
    done, to_come, size = [], total, 4
    while not left.isEmpty() and (cut := to_come.orderBy(F.desc("total")).limit(size).agg(F.min("total")).first()[0]) is not None:
        by = to_come.where(F.col("total") >= cut).select(F.col("line_id").alias("by_line"), F.col("total").alias("by_total"))
        others = written(_of(seg, by.withColumnRenamed("by_line", "line_id")))
        hits = _cover_counts(_of(seg, left), others, step, distance, least_cos).join(left, "line_id").where(f"hits >= {share} * stations")
        left = written(left.join(hits.join(by, "by_line").where("total < by_total").select("line_id"), "line_id", "left_anti"))
        done.append(left.where(F.col("total") >= cut))
        left, to_come, size = left.where(F.col("total") < cut), total.where(F.col("total") < cut), size * 8
    return reduce(DataFrame.unionByName, [left, *done]).select("line_id", "stations")


def taken_lines(seg: DataFrame, order: DataFrame, step: float, distance: float, most: float, least_cos: float) -> DataFrame:
    """(line_id): lines that stay when taken one by one by ``order`` (line_id, o), if no line that stayed covers more than ``most`` of their stations.

    The first lines decide among themselves; those that stay drop what they cover, then come the first of the rest, more each time. So only lines that
    stay meet all others, which are few where lines lie dense.
    """
    seg = written(seg.select("line_id", "ax", "ay", "bx", "by", "len", "m0"))
    stations = sequence.stations(seg, step).groupBy("line_id").agg(F.count("*").alias("stations"))
    left = written(order.select("line_id", "o").join(stations, "line_id", "left"))
    kept, size = [], 16

    def covered(lines: DataFrame, own: DataFrame, others: DataFrame) -> DataFrame:
        return _cover_counts(own, others, step, distance, least_cos).join(lines, "line_id").where(f"hits > {most} * stations")

    while not left.isEmpty():
        block = written(left.orderBy("o").limit(size))
        own = written(_of(seg, block))
        before = covered(block, own, own).join(block.select(F.col("line_id").alias("by_line"), F.col("o").alias("p")), "by_line").where("p < o")
        kept.append(graph.taken_in_order(block.select(F.col("line_id").alias("id")), before.select(F.col("line_id").alias("id"), F.col("by_line").alias("j"))).select(F.col("id").alias("line_id")))
        rest = written(left.join(block.select("line_id"), "line_id", "left_anti"))
        gone = covered(rest, _of(seg, rest), written(_of(own, kept[-1])))
        left = written(rest.join(gone.select("line_id"), "line_id", "left_anti"))
        size *= 4
    return reduce(DataFrame.unionByName, kept, order.select("line_id").limit(0))


def cover_shares(segments: DataFrame, others: DataFrame, step: float, distance: float, least_cos: float = 0.5) -> DataFrame:
    """(line_id, stations, hits): of the stations along each line, those that run beside another centre line."""
    st = sequence.stations(segments, step)
    hits = covered_stations(st, others, distance, least_cos).groupBy("line_id").agg(F.count("*").alias("hits"))
    return st.groupBy("line_id").agg(F.count("*").alias("stations")).join(hits, "line_id", "left").select("line_id", "stations", F.coalesce("hits", F.lit(0)).alias("hits"))
