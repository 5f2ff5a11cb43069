"""Planar arrangements: crossing lines as nodes, edges and faces.

``noded`` snaps lines to a grid and cuts them where they meet (snap rounding: every line goes through the middle of each hot
pixel on its way, a pixel that holds an end or a crossing), so that edges meet in nodes only. ``faces`` sorts the edges
around every node by angle, follows each side of an edge to the next one, names the cycles by pointer jumping, and hangs
cycles that turn the other way into the face that lies around them. Edges with the same face on both sides (dead ends,
and links between loops) bound nothing and go first.

Every join is on a cell, a node or a side; nothing is gathered by line or face but sums. Rounds grow with the logarithm of
the longest boundary. Coordinates are whole numbers of the grid, below 2^30, so nodes are compared exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators import lines as L
from geoloom.operators import spatial_join as J
from geoloom.sources.store import written

GRID, CELL = 0.01, 16.0
#: Pixels are moved by this much of their size, so that no line on the grid runs along a pixel's border.
_OFF = {"x": 1.3e-7, "y": 2.9e-7}
_MOST = 1 << 30


@dataclass(frozen=True)
class Arrangement:
    """edges (eid, ux, uy, vx, vy, in grid units, u before v); sources (eid, sid) of their lines."""

    edges: DataFrame
    sources: DataFrame
    grid: float


@dataclass(frozen=True)
class Faces:
    """faces (face, area, perimeter of the outer boundary, holes); sides (hid, eid, ox, oy, dx, dy, ring, face): a side has its face on
    its left, null for the outside; ring is the cycle that it is in."""

    faces: DataFrame
    sides: DataFrame
    grid: float


def _pixel(v: Column, axis: str) -> Column:
    return F.floor(v + 0.5 + _OFF[axis]).cast("long")


def _checked(whole: Column) -> Column:
    return F.when(F.abs(whole) < _MOST, whole).otherwise(F.raise_error(F.lit("coordinates have to be numbers below 2^30 grid units")))


def noded(segments: DataFrame, grid: float = GRID, cell: float = CELL) -> Arrangement:
    """Edges of the arrangement of segments (sid, ax, ay, bx, by)."""
    size = cell / grid
    ends = {c: _checked(_pixel(F.col(c) / grid, c[1])).alias(c) for c in ("ax", "ay", "bx", "by")}
    segs = written(segments.select("sid", *ends.values()).where("ax <> bx or ay <> by").select("sid", *(F.col(c).cast("double").alias(c) for c in ends)))
    a = segs.select(F.col("sid").alias("a_id"), F.lit(0).alias("a_seg"), "ax", "ay", "bx", "by")
    b = segs.select(F.col("sid").alias("b_id"), F.lit(0).alias("b_seg"), *(F.col(p).alias(q) for p, q in zip(("ax", "ay", "bx", "by"), ("cx", "cy", "dx", "dy"))))
    met = J.crossings(a, b, size).where("a_id < b_id")
    side = lambda px, py: (F.col("dx") - F.col("cx")) * (F.col(py) - F.col("cy")) - (F.col("dy") - F.col("cy")) * (F.col(px) - F.col("cx"))
    t = F.try_divide(side("ax", "ay"), side("ax", "ay") - side("bx", "by"))
    at = lambda p, q, axis: _pixel(F.col(p) + t * (F.col(q) - F.col(p)), axis)
    hot = met.select(at("ax", "bx", "x").alias("x"), at("ay", "by", "y").alias("y"))
    for x, y in (("ax", "ay"), ("bx", "by")):
        hot = hot.unionByName(segs.select(F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y")))
    hot = hot.distinct().select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    low, high = (lambda c: F.col(c) - 0.5 - _OFF[c]), (lambda c: F.col(c) + 0.5 - _OFF[c])
    t0, t1 = L.clip_range(low("x"), low("y"), high("x"), high("y"))
    through = J.near_segments(hot, segs, 0.75, size).withColumn("t0", t0).withColumn("t1", t1).where("t0 <= t1")
    w = Window.partitionBy("sid").orderBy("t0", "t1", "x", "y")
    whole = lambda c: c.cast("long")
    steps = through.select("sid", whole(F.col("x")).alias("px"), whole(F.col("y")).alias("py"), whole(F.lead("x").over(w)).alias("qx"), whole(F.lead("y").over(w)).alias("qy")).where("qx is not null")
    p, q = F.struct("px", "py"), F.struct("qx", "qy")
    first, last = F.least(p, q.cast("struct<px:bigint,py:bigint>")), F.greatest(p, q.cast("struct<px:bigint,py:bigint>"))
    pieces = written(steps.select("sid", first.alias("u"), last.alias("v")).select("sid", F.col("u.px").alias("ux"), F.col("u.py").alias("uy"), F.col("v.px").alias("vx"), F.col("v.py").alias("vy")))
    key = ["ux", "uy", "vx", "vy"]
    edges = written(pieces.select(*key).distinct().withColumn("eid", F.monotonically_increasing_id()))
    sources = written(pieces.join(edges, key).select("eid", "sid").distinct())
    return Arrangement(edges, sources, grid)


def _sides(edges: DataFrame) -> DataFrame:
    """Both sides of each edge, from o to d: hid is twice the edge's number, plus one against its direction."""
    one = lambda k, o, d: F.struct((F.col("eid") * 2 + k).alias("hid"), F.col(f"{o}x").alias("ox"), F.col(f"{o}y").alias("oy"), F.col(f"{d}x").alias("dx"), F.col(f"{d}y").alias("dy"))
    return edges.select("eid", F.explode(F.array(one(0, "u", "v"), one(1, "v", "u"))).alias("s")).select("eid", "s.*")


def cycles(sides: DataFrame) -> DataFrame:
    """(hid, ring): the cycle of sides that has one face to its left, named by its least side."""
    angle = F.atan2((F.col("dy") - F.col("oy")).cast("double"), (F.col("dx") - F.col("ox")).cast("double"))
    around = Window.partitionBy("ox", "oy").orderBy("angle", "hid")
    turned = sides.withColumn("angle", angle).select("hid", F.coalesce(F.lag("hid").over(around), F.last("hid").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("then"))
    state = written(turned.select(F.col("hid").bitwiseXOR(F.lit(1)).alias("hid"), F.col("then").alias("next"), F.col("hid").bitwiseXOR(F.lit(1)).alias("ring")))
    while True:
        ahead = state.select(F.col("hid").alias("next"), F.col("next").alias("then"), F.col("ring").alias("low"))
        state = written(state.join(ahead, "next").select("hid", F.col("then").alias("next"), F.least("ring", "low").alias("ring"), (F.col("low") < F.col("ring")).alias("moved")))
        if state.where("moved").isEmpty():
            return state.select("hid", "ring")


def pruned(edges: DataFrame) -> DataFrame:
    """Edges with a face of their own on either side."""
    label = cycles(_sides(edges))
    same = label.groupBy(F.shiftright("hid", 1).alias("eid"), "ring").agg(F.count("*").alias("n")).where("n = 2")
    return written(edges.join(same, "eid", "left_anti"))


def _below(points: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """(ring, hid): the side that faces up of the nearest edge straight below each point (ring, x, y), where there is one.

    Cells are searched downwards, twice as many each round, until the first hit; a point of a third of all pays for its own column only.
    """
    cells = written(J.segment_cells(edges.where("ux < vx"), "ux", "uy", "vx", "vy", size))
    lowest = cells.agg(F.min("__gy")).first()[0]
    todo = written(J.point_cell(points, size=size).withColumnsRenamed({"__gx": "gx", "__gy": "gy"}))
    found, reach, step = None, 0, 1
    slope = F.try_divide(F.col("vy") - F.col("uy"), F.col("vx") - F.col("ux"))
    while lowest is not None and not todo.isEmpty():
        asked = todo.withColumn("__gy", F.explode(F.sequence(F.col("gy") - (reach + step - 1), F.col("gy") - reach))).withColumn("__gx", F.col("gx"))
        at = F.col("uy") + (F.col("x") - F.col("ux")) * slope
        hits = asked.join(cells, ["__gx", "__gy"]).where("ux <= x and x < vx").withColumn("at", at).where((F.col("at") < F.col("y")) & (F.floor(F.col("at") / size) == F.col("__gy")))
        top = written(hits.groupBy("ring").agg(F.max_by("eid", F.struct("at", slope.alias("slope"))).alias("eid")).select("ring", (F.col("eid") * 2).alias("hid")))
        found = top if found is None else found.unionByName(top)
        reach, step = reach + step, step * 2
        todo = written(todo.join(top, "ring", "left_anti").where(F.col("gy") - reach >= lowest))
    return found if found is not None else points.select("ring", F.lit(None).cast("long").alias("hid")).limit(0)


def faces(arrangement: Arrangement, cell: float = CELL) -> Faces:
    """Bounded faces and the sides around them."""
    grid = arrangement.grid
    edges = pruned(arrangement.edges)
    sides = written(_sides(edges))
    named = written(sides.join(cycles(sides), "hid"))
    turn = (F.col("ox") * F.col("dy") - F.col("dx") * F.col("oy")).cast("decimal(38,0)")
    rings = written(named.groupBy("ring").agg((F.sum(turn).cast("double") * (grid * grid / 2)).alias("area"), (F.sum(F.hypot((F.col("dx") - F.col("ox")).cast("double"), (F.col("dy") - F.col("oy")).cast("double"))) * grid).alias("length"), F.min(F.struct("ox", "oy")).alias("p")))
    inner = rings.where("area < 0").select("ring", F.col("p.ox").cast("double").alias("x"), F.col("p.oy").cast("double").alias("y"))
    around = _below(inner, edges, cell / grid).join(named.select("hid", F.col("ring").alias("up")), "hid").select("ring", "up")
    turned = inner.select(F.col("ring").alias("up")).withColumn("again", F.lit(True))
    open_ = written(around.join(turned, "up", "left").select("ring", "up", F.coalesce("again", F.lit(False)).alias("again")))
    while not open_.where("again").isEmpty():  # around a ring lies another one's outside: it has that one's face
        further = open_.select(F.col("ring").alias("up"), F.col("up").alias("then"), F.col("again").alias("more"))
        open_ = written(open_.join(further.withColumn("known", F.lit(True)), "up", "left").select("ring", F.when(F.col("again"), F.col("then")).otherwise(F.col("up")).alias("up"), F.coalesce(F.col("again") & F.col("more"), F.lit(False)).alias("again")).where("up is not null"))
    holes = open_.select("ring", F.col("up").alias("face"))
    lost = holes.join(rings.select("ring", F.col("area").alias("gone")), "ring").groupBy("face").agg(F.sum("gone").alias("gone"), F.count("*").alias("holes"))
    whole = rings.where("area > 0").select(F.col("ring").alias("face"), "area", F.col("length").alias("perimeter")).join(lost, "face", "left")
    out = written(whole.select("face", (F.col("area") + F.coalesce("gone", F.lit(0.0))).alias("area"), "perimeter", F.coalesce("holes", F.lit(0)).cast("long").alias("holes")))
    owner = rings.join(holes, "ring", "left").select("ring", F.when(F.col("area") > 0, F.col("ring")).otherwise(F.col("face")).alias("face"))
    return Faces(out, written(named.join(owner, "ring")), grid)


def inner_points(found: Faces) -> DataFrame:
    """(face, x, y): a point inside each face, in the middle of the lowest stretch that a line above its lowest node cuts out of it."""
    own = found.sides.where("face is not null").select("face", "ox", "oy", "dx", "dy")
    low = own.groupBy("face").agg(F.min("oy").alias("y0"))
    with_low = own.join(low, "face")
    second = with_low.where("oy > y0").groupBy("face").agg(F.min("oy").alias("y1"))
    y = (F.col("y0") + F.col("y1")) / 2.0
    x = F.col("ox") + F.try_divide(y - F.col("oy"), F.col("dy") - F.col("oy")) * (F.col("dx") - F.col("ox"))
    cut = with_low.join(second, "face").where((F.least("oy", "dy") < y) & (F.greatest("oy", "dy") > y)).select("face", y.alias("y"), x.alias("x"))
    nth = cut.withColumn("n", F.row_number().over(Window.partitionBy("face").orderBy("x"))).where("n <= 2")
    return nth.groupBy("face").agg((F.avg("x") * found.grid).alias("x"), (F.first("y") * found.grid).alias("y"))


def ring_segments(rings: DataFrame, ring: str = "ring") -> DataFrame:
    """(fid, ax, ay, bx, by): the sides of rings array<struct<x, y>>, closed."""
    at = F.col(ring)
    moved = F.concat(F.slice(at, 2, F.size(at)), F.slice(at, 1, 1))
    return rings.select("fid", F.explode(F.arrays_zip(at.alias("p"), moved.alias("q"))).alias("s")).select("fid", F.col("s.p.x").alias("ax"), F.col("s.p.y").alias("ay"), F.col("s.q.x").alias("bx"), F.col("s.q.y").alias("by"))


def coverage(areas: DataFrame, grid: float = GRID, cell: float = CELL) -> tuple[Faces, DataFrame]:
    """Areas (fid, rank, ring) cut into the faces of all their outlines; and (face, fid): each face's owner, the area of least rank
    (then of least fid) around a point inside. Faces that no area covers have no owner."""
    # of areas with one ring only the first can own a face
    areas = written(areas.groupBy("ring").agg(F.min(F.struct("rank", "fid")).alias("w")).select("w.fid", "w.rank", "ring"))
    segments = ring_segments(areas).withColumn("sid", F.monotonically_increasing_id())
    found = faces(noded(segments, grid, cell), cell)
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxed = areas.select("fid", "rank", "ring", F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    within = J.points_in_boxes(inner_points(found), boxed, cell).where(J.ring_contains(F.col("x"), F.col("y"), F.col("ring")))
    return found, written(within.groupBy("face").agg(F.min(F.struct("rank", "fid")).alias("w")).select("face", F.col("w.fid").alias("fid")))


def neighbours(found: Faces) -> DataFrame:
    """(eid, a, b, length): the faces on both sides of each edge (null: outside), and its length."""
    length = F.hypot((F.col("dx") - F.col("ox")).cast("double"), (F.col("dy") - F.col("oy")).cast("double")) * found.grid
    return found.sides.groupBy("eid").agg(F.max(F.when(F.col("hid") % 2 == 0, F.col("face"))).alias("a"), F.max(F.when(F.col("hid") % 2 == 1, F.col("face"))).alias("b"), F.max(length).alias("length"))
