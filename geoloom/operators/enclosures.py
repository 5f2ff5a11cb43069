"""Ground that a network of fences encloses, with short gaps bridged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators import planar as P
from geoloom.operators import sequence
from geoloom.operators import spatial_join as J
from geoloom.sources.store import written

#: A line whose ends are this near (metres), or this near and a small share of its length apart, is a ring for its ticks, if it holds this much ground. Fixed values.
RING_CLOSED, RING_GAP, RING_SHARE, RING_AREA = 0.3, 6.0, 0.1, 15.0


@dataclass(frozen=True)
class Rules:
    """Metres and square metres. The values are fixed by the results that are asked for."""

    least_area: float = 15.0
    most_area: float = 100_000.0
    most_compact: float = 20_000.0
    least_width: float = 2.5
    gap: float = 5.0
    closed: float = 0.3
    bridge_share: float = 0.3
    private_share: float = 0.5


def gap_bridges(segments: DataFrame, gap: float, closed: float) -> DataFrame:
    """(line_id, k, ax, ay, bx, by): from each end (k 0 or 1) of an open line the shortest way to another line that it doesn't touch, if within ``gap``.

    ``segments``: line_id, pos, ax, ay, bx, by. Of equally near lines the least line_id counts.
    """
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ends = segments.groupBy("line_id").agg(F.min_by(at("ax", "ay"), "pos").alias("a"), F.max_by(at("bx", "by"), "pos").alias("b"))
    loose = ends.where(F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")) > closed)
    free = loose.select("line_id", F.posexplode(F.array("a", "b")).alias("k", "p")).select("line_id", "k", "p.x", "p.y")
    other = segments.select(F.col("line_id").alias("other"), "ax", "ay", "bx", "by")
    near = J.near_segments(free, other, gap).where("line_id <> other")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = F.coalesce(((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    foot = near.select("line_id", "k", "x", "y", "other", "d2", (F.col("ax") + t * dx).alias("fx"), (F.col("ay") + t * dy).alias("fy"))
    # a line that touches the end is no aim, with any of its parts
    line = foot.groupBy("line_id", "k", "x", "y", "other").agg(F.min(F.struct("d2", "fx", "fy")).alias("m")).where("m.d2 > 1e-18")
    best = line.groupBy("line_id", "k", "x", "y").agg(F.min(F.struct("m.d2", "other", "m.fx", "m.fy")).alias("m"))
    return best.select("line_id", "k", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("m.fx").alias("bx"), F.col("m.fy").alias("by"))


def _under(y: Column, y0: Column, y1: Column) -> Column:
    """The integral of a height cut to [y0, y1], over the height."""
    mid = F.greatest(y0, F.least(y1, y))
    return y0 * F.least(y, y0) + (mid * mid - y0 * y0) / 2 + y1 * F.greatest(y - y1, F.lit(0.0))


def covered_area(found: P.Faces, boxes: DataFrame, faces: DataFrame, cell: float = P.CELL) -> DataFrame:
    """(face, covered): the area that each of ``faces`` has in common with boxes, added up over boxes. Each side gives the area under it, cut to the box."""
    g = found.grid
    own = found.sides.join(faces.select("face"), "face", "left_semi").select("face", *((F.col(c) * g).alias(c) for c in ("ox", "oy", "dx", "dy")))
    reach = own.groupBy("face").agg(F.min("ox").alias("x0"), F.min("oy").alias("y0"), F.max("ox").alias("x1"), F.max("oy").alias("y1")).withColumnRenamed("face", "fid")
    shapes = J.shapes(boxes).withColumnRenamed("n", "fid")
    pairs = J.overlaps(reach, shapes, cell).select(F.col("a_fid").alias("face"), F.col("b_fid").alias("n"), *(F.col(f"b_{c}").alias(c) for c in ("x0", "y0", "x1", "y1")))
    w = F.col("dx") - F.col("ox")
    near = own.where("dx <> ox").join(pairs, "face")
    a, b = F.greatest(F.least("ox", "dx"), F.col("x0")), F.least(F.greatest("ox", "dx"), F.col("x1"))
    y_at = lambda x: F.col("oy") + F.try_divide(x - F.col("ox"), w) * (F.col("dy") - F.col("oy"))
    cut = near.withColumn("a", a).withColumn("b", b).where("a < b").withColumn("ya", y_at(F.col("a"))).withColumn("yb", y_at(F.col("b")))
    flat = F.abs(F.col("yb") - F.col("ya")) < 1e-9
    mean = F.when(flat, F.greatest(F.col("y0"), F.least(F.col("y1"), F.col("ya")))).otherwise(F.try_divide(_under(F.col("yb"), F.col("y0"), F.col("y1")) - _under(F.col("ya"), F.col("y0"), F.col("y1")), F.col("yb") - F.col("ya")))
    # sides that run to the left have their face below
    return cut.groupBy("face").agg(F.sum(-F.signum(w) * (F.col("b") - F.col("a")) * mean * F.col("n")).alias("covered"))


def enclosed(segments: DataFrame, private: DataFrame, rules: Rules = Rules(), grid: float = P.GRID, cell: float = P.CELL) -> tuple[P.Faces, DataFrame]:
    """The arrangement's faces, and (face, area, perimeter, holes, bridge_share, private_share, compact): those that fences enclose.

    Fences (line_id, pos, ax, ay, bx, by) and bridges over their gaps bound the faces. A face counts with an area in the limits, at most
    ``bridge_share`` of its outer boundary on bridges, and if it is wide enough for its perimeter or mostly private ground (boxes fid, x0, y0, x1, y1).
    """
    shape = sequence.line_shapes(segments).where("line_id = shape").select("line_id")
    segments = written(segments.join(shape, "line_id", "left_semi"))  # copies of a line touch it, so they are no aim of its ends, and bound the same faces
    bridges = gap_bridges(segments, rules.gap, rules.closed)
    all_ = segments.select("ax", "ay", "bx", "by", F.lit(False).alias("bridge")).unionByName(bridges.select("ax", "ay", "bx", "by", F.lit(True).alias("bridge")))
    all_ = written(all_.withColumn("sid", F.monotonically_increasing_id()))
    net = P.noded(all_, grid, cell)
    found = P.faces(net, cell)
    only = net.sources.join(all_.select("sid", "bridge"), "sid").groupBy("eid").agg(F.min("bridge").alias("bridge")).where("bridge").select("eid")
    length = F.hypot((F.col("dx") - F.col("ox")).cast("double"), (F.col("dy") - F.col("oy")).cast("double")) * grid
    on_bridge = found.sides.where("ring = face").join(only, "eid", "left_semi").groupBy("face").agg(F.sum(length).alias("bridged"))
    sized = written(found.faces.where(F.col("area").between(rules.least_area, rules.most_area)))
    shares = sized.join(on_bridge, "face", "left").join(covered_area(found, private, sized, cell), "face", "left")
    zero = F.lit(0.0)
    out = shares.select("face", "area", "perimeter", "holes", (F.coalesce("bridged", zero) / F.col("perimeter")).alias("bridge_share"), (F.coalesce("covered", zero) / F.col("area")).alias("private_share"))
    out = out.withColumn("compact", (2 * F.col("area") / F.col("perimeter") >= rules.least_width) & (F.col("area") <= rules.most_compact))
    return found, out.where((F.col("bridge_share") <= rules.bridge_share) & (F.col("compact") | (F.col("private_share") >= rules.private_share)))


def oriented(segments: DataFrame, private: DataFrame, public: DataFrame, step: float = 6.0, offset: float = 1.2, ticks_on_left: bool = False) -> DataFrame:
    """(line_id, ring, net, reverse): which fences (line_id, pos, ax, ay, bx, by, len, m0) run the wrong way for the side that their ticks are on.

    Rings have their ticks inside, whatever lies around. Along other lines, from half a step on, points ``offset`` to either side count one
    in private ground only and minus one in public ground only (boxes x0, y0, x1, y1); a line turns if the ticks' side has less than the other.
    """
    shape = sequence.line_shapes(segments)
    segments = written(segments.join(shape.where("line_id = shape"), "line_id", "left_semi"))
    ends = segments.groupBy("line_id").agg(F.min_by(F.struct("ax", "ay"), "pos").alias("a"), F.max_by(F.struct("bx", "by"), "pos").alias("b"), F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")).alias("open"), F.count("*").alias("n"), F.sum("len").alias("length"))
    whole = F.col("open") + F.col("b.bx") * F.col("a.ay") - F.col("a.ax") * F.col("b.by")
    gap = F.hypot(F.col("a.ax") - F.col("b.bx"), F.col("a.ay") - F.col("b.by"))
    near = (gap <= RING_CLOSED) | ((gap <= RING_GAP) & (gap <= RING_SHARE * F.col("length")))
    lines = ends.select("line_id", ((F.col("n") >= 3) & near & (F.abs(whole / 2) >= RING_AREA)).alias("ring"), (whole / 2).alias("area"))
    st = sequence.stations(segments.withColumn("m0", F.col("m0") + step / 2), step)
    side = lambda s: F.struct(F.lit(s).alias("side"), (F.col("x") - s * offset * F.col("ty")).alias("x"), (F.col("y") + s * offset * F.col("tx")).alias("y"))
    probe = written(st.select("line_id", "k", F.explode(F.array(side(1), side(-1))).alias("p")).select("line_id", "k", "p.side", "p.x", "p.y"))
    key = ["line_id", "k", "side"]
    within = lambda boxes, name: J.inside(probe, boxes).select(*key).withColumn(name, F.lit(1))
    told = probe.join(within(private, "mine"), key, "left").join(within(public, "theirs"), key, "left")
    votes = told.groupBy("line_id").agg(F.sum((1 if ticks_on_left else -1) * F.col("side") * (F.coalesce("mine", F.lit(0)) - F.coalesce("theirs", F.lit(0)))).alias("net"))
    net = F.coalesce("net", F.lit(0)).cast("long")
    told = lines.join(votes, "line_id", "left").withColumnRenamed("line_id", "shape").join(shape, "shape")
    return told.select("line_id", "ring", net.alias("net"), F.when(F.col("ring"), (F.col("area") > 0) != F.lit(ticks_on_left)).otherwise(net < 0).alias("reverse"))


def outer_rings(found: P.Faces, faces: DataFrame) -> DataFrame:
    """(face, place, x, y): the nodes of each face's outer boundary in order, from its least side on, by list ranking along the boundary."""
    own = found.sides.where("ring = face").join(faces.select("face"), "face", "left_semi").select("face", "hid", "ox", "oy", "dx", "dy")
    angle = F.atan2((F.col("dy") - F.col("oy")).cast("double"), (F.col("dx") - F.col("ox")).cast("double"))
    # a boundary that touches itself in a node has several ways on from there: the first one clockwise from where it came
    out = own.select("face", F.col("hid").alias("next"), F.col("ox").alias("dx"), F.col("oy").alias("dy"), angle.alias("out"))
    back = F.atan2((F.col("oy") - F.col("dy")).cast("double"), (F.col("ox") - F.col("dx")).cast("double"))
    way = own.withColumn("back", back).join(out, ["face", "dx", "dy"]).withColumn("turn", F.pmod(F.col("back") - F.col("out") - 1e-12, F.lit(6.283185307179586)))
    following = way.groupBy("face", "hid", "ox", "oy").agg(F.min_by("next", "turn").alias("next"))
    state = written(following.select("face", "hid", F.when(F.col("next") != F.col("face"), F.col("next")).alias("next"), F.when(F.col("next") != F.col("face"), 1).otherwise(0).alias("behind")))
    while not state.where("next is not null").isEmpty():
        ahead = state.select(F.col("hid").alias("next"), F.col("next").alias("then"), F.col("behind").alias("more"))
        state = written(state.join(ahead, "next", "left").select("face", "hid", F.col("then").alias("next"), (F.col("behind") + F.coalesce("more", F.lit(0))).alias("behind")))
    most = Window.partitionBy("face")
    return state.join(own.select("hid", "ox", "oy"), "hid").select("face", (F.max("behind").over(most) - F.col("behind")).alias("place"), (F.col("ox") * found.grid).alias("x"), (F.col("oy") * found.grid).alias("y"))
