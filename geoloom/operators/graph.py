"""Graph operators: components, snapping, chains, reachability, greedy spacing.

Loops write their state to the shared folder each round; rounds grow with the
logarithm of a component's size, or, for greedy picks, stay few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators import focal, junctions
from geoloom.operators.spatial_join import within  # noqa: F401  a test takes it away, to see that no pairs are listed
from geoloom.sources.store import written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); the component is its smallest id.

    Alternating stars: larger neighbours hook to the least id around, then smaller ones.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = written(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def labelled(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) for all ids, those without links being their own component."""
    return ids.select("id").join(components(links), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def regions(cells: DataFrame, width: int, cls: str | None = None) -> DataFrame:
    """Cells with the number of their 4-connected region (of one class): its least rr * width + cc."""
    ident = F.when((F.col("cc") >= 0) & (F.col("cc") < width), F.col("rr") * width + F.col("cc")).otherwise(F.raise_error(F.lit(f"a column outside 0 to {width - 1} would get another cell's number")))
    keys = ["rr", "cc"] + ([cls] if cls else [])
    own = cells.select(*keys).withColumn("id", ident)
    links = focal.shifted(own.withColumnRenamed("id", "a"), [(0, 1), (1, 0)]).drop("dy", "dx").join(own.withColumnRenamed("id", "b"), keys).select("a", "b")
    return own.join(labelled(own, links), "id").select(*keys, "component")


def _places_linked(places: DataFrame, cells: DataFrame, tolerance: float) -> DataFrame:
    """(id, component): cells (id, gx, gy) whose places (gx, gy, x, y) lie within the tolerance of each other, directly or in a row.

    A cell's outermost places answer for most of its neighbours. Only cells that no row of these joins compare all their places, and of one's places
    those that the other's box is in reach of.
    """
    c = F.col
    p = F.struct("x", "y")
    keys = (c("x"), c("y"), c("x") + c("y"), c("x") - c("y"))
    tips = places.groupBy("gx", "gy").agg(F.array_distinct(F.array(*(pick(p, k) for k in keys for pick in (F.min_by, F.max_by)))).alias("tips"))
    cells = written(cells.join(tips, ["gx", "gy"]).select("id", "gx", "gy", "tips"))
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(3) for dy in range(-2, 3) if (dx, dy) > (0, 0)))
    d2 = lambda a, b: (a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2
    near = F.exists("tips", lambda a: F.exists("other", lambda b: d2(a, b) <= tolerance * tolerance))
    ahead = cells.select(c("id").alias("a"), "tips", "gx", "gy", F.explode(steps).alias("s")).select("a", "tips", (c("gx") + c("s.dx")).alias("gx"), (c("gy") + c("s.dy")).alias("gy"))
    end = lambda pick, t, k: pick(F.transform(t, lambda q: q[k]))
    box = lambda t, n: [end(pick, t, k).alias(f"{n}{k}{m}") for k in "xy" for m, pick in enumerate((F.array_min, F.array_max))]
    pairs = written(ahead.join(cells.select("gx", "gy", c("id").alias("b"), c("tips").alias("other")), ["gx", "gy"]).select("a", "b", near.alias("near"), *box("other", "b")))
    links = pairs.where("near").select("a", "b")
    label = written(labelled(cells, links))
    named = pairs.where("not near").join(label.toDF("a", "la"), "a").join(label.toDF("b", "lb"), "b").where("la <> lb").drop("near", "la", "lb")
    named = written(named)
    if named.isEmpty():
        return label
    at = written(places.join(cells.select("gx", "gy", "id"), ["gx", "gy"]).select("id", "x", "y"))
    off = lambda k: F.greatest(F.lit(0.0), c(f"b{k}0") - c(k), c(k) - c(f"b{k}1"))
    reach = (off("x") ** 2 + off("y") ** 2) <= tolerance * tolerance * 1.000001
    tried = named.join(at.withColumnRenamed("id", "a"), "a").where(reach).select("a", "b", "x", "y").join(at.toDF("b", "rx", "ry"), "b")
    more = written(tried.where((c("x") - c("rx")) ** 2 + (c("y") - c("ry")) ** 2 <= tolerance * tolerance).select("a", "b").distinct())
    return label if more.isEmpty() else labelled(cells, links.unionByName(more))


def snapped(ends: DataFrame, tolerance: float) -> DataFrame:
    """(id, node, x, y): ends within the tolerance of each other, directly or in a row, share a node at their mean.

    No pairs are listed: the ends of a cell, whose diagonal is a little shorter than the tolerance, share a node at any rate, so it is cells that are
    linked. Ends without a place are nodes of their own.
    """
    side = tolerance * 0.7071
    lost = F.col("x").isNull() | F.col("y").isNull() | F.isnan(F.col("x").cast("double")) | F.isnan(F.col("y").cast("double"))
    cell = [F.when(~lost, F.floor(F.col(k) / side)).alias(f"g{k}") for k in "xy"]
    ends = written(ends.select("id", "x", "y", *cell))
    own = ends.where("gx is not null")
    cells = own.groupBy("gx", "gy").agg(F.min("id").alias("id"))
    nodes = _places_linked(own.select("gx", "gy", "x", "y").distinct(), cells, tolerance)
    of = written(cells.join(nodes, "id").select("gx", "gy", "component"))
    placed = ends.join(of, ["gx", "gy"], "left").select("id", "x", "y", F.coalesce("component", "id").alias("component"))
    mean = placed.groupBy("component").agg(F.avg("x").alias("nx"), F.avg("y").alias("ny"), F.count("*").alias("degree"))
    return placed.join(mean, "component").select("id", F.col("component").alias("node"), F.col("nx").alias("x"), F.col("ny").alias("y"), "degree")


def reachable(ids: DataFrame, links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Ids in components that hold a seed."""
    label = labelled(ids, links)
    live = label.join(seeds.select("id"), "id", "left_semi").select("component").distinct()
    return label.join(live, "component", "left_semi").select("id")


def chained(pieces: DataFrame) -> DataFrame:
    """Line pieces (id, a, b: end nodes) joined through nodes that exactly two ends meet at; (id, chain)."""
    ends = pieces.select("id", F.explode(F.array("a", "b")).alias("node"))
    through = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("n = 2 and a <> b")
    return labelled(pieces, through.select("a", "b")).select("id", F.col("component").alias("chain"))


def ranked(links: DataFrame) -> DataFrame:
    """List ranking by pointer jumping: links (id, next), null at an end; gives (id, rank): steps to the end."""
    state = written(links.select("id", "next", F.when(F.col("next").isNull(), 0).otherwise(1).alias("rank")))
    while not state.where("next is not null").isEmpty():
        ahead = state.select(F.col("id").alias("i"), F.col("next").alias("n2"), F.col("rank").alias("r2"))
        state = written(state.join(ahead, state["next"] == ahead["i"], "left").select("id", F.col("n2").alias("next"), (F.col("rank") + F.coalesce("r2", F.lit(0))).alias("rank")))
    return state.select("id", "rank")


def taken_in_order(ids: DataFrame, blocked_by: DataFrame) -> DataFrame:
    """Ids kept when taken one by one in an order: ``blocked_by`` (id, j) says that j comes first and, if kept, drops id.

    Each round keeps the ids that no undecided one blocks, and drops those that a kept one blocks: the same set.
    """
    pairs = written(blocked_by.select("id", "j").distinct())
    kept, undecided = None, written(ids.select("id"))
    while not undecided.isEmpty():
        waiting = pairs.join(undecided.select(F.col("id").alias("j")), "j", "left_semi").select("id").distinct()
        first = written(undecided.join(waiting, "id", "left_anti"))
        kept = first if kept is None else kept.unionByName(first)
        gone = pairs.join(first.select(F.col("id").alias("j")), "j", "left_semi").select("id").distinct()
        undecided = written(undecided.join(first, "id", "left_anti").join(gone, "id", "left_anti"))
    return ids.select("id").limit(0) if kept is None else kept


def spaced(points: DataFrame, distance: float, by: str | None = None, open_end: bool = False) -> DataFrame:
    """Ids kept when points (id, x, y, score) are taken best first with a least spacing, for each ``by`` if given; with ``open_end`` points just
    ``distance`` apart don't block each other. Points without a place block none.

    Pairs are never listed: a kept point covers its cell whole, so a round takes the cells' best points that none of the cells in reach betters,
    and drops what they block. The best point of all is always one of them; rounds are few, and each reads what the one before left.
    """
    side = distance * 0.7071  # a cell's diagonal is a little shorter than the distance, so what is in reach lies two cells off at most
    group = [by] if by else []
    cell = [*group, "gx", "gy"]
    lost = F.col("x").isNull() | F.col("y").isNull() | F.isnan(F.col("x").cast("double")) | F.isnan(F.col("y").cast("double"))
    order = F.struct((-F.col("score")).alias("s"), F.col("id").alias("i"))
    every = points.select("id", *group, "x", "y", order.alias("o"), lost.alias("lost"))
    kept = every.where("lost").select("id")
    left = written(every.where("not lost").select("id", *group, "x", "y", "o", F.floor(F.col("x") / side).alias("gx"), F.floor(F.col("y") / side).alias("gy")))
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-2, 3) for dy in range(-2, 3)))
    around = lambda df, *also: df.withColumn("__s", F.explode(steps)).select(*group, (F.col("gx") + F.col("__s.dx")).alias("gx"), (F.col("gy") + F.col("__s.dy")).alias("gy"), *also)
    rounds = 0
    while not left.isEmpty():
        best = written(left.groupBy(*cell).agg(F.min(F.struct("o", "id", "x", "y")).alias("b")).select(*cell, "b.*"))
        least = around(best, "o").groupBy(*cell).agg(F.min("o").alias("least"))
        fresh = best.join(least, cell).where(F.col("o") == F.col("least"))
        reach = written(around(fresh, "id", F.col("x").alias("rx"), F.col("y").alias("ry"), (F.col("__s.dx") == 0).alias("mx"), (F.col("__s.dy") == 0).alias("my")))
        kept = kept.unionByName(reach.where("mx and my").select("id"))
        d2 = (F.col("x") - F.col("rx")) ** 2 + (F.col("y") - F.col("ry")) ** 2
        l, r = left.alias("l"), reach.drop("id").alias("r")  # noqa: E741
        same = (d2 < distance * distance) if open_end else (d2 <= distance * distance)
        for c in cell:
            same &= F.col(f"l.{c}") == F.col(f"r.{c}")
        left = written(l.join(r, same, "left_anti"))
        rounds += 1
        if rounds % 8 == 0:  # the plan stays short
            kept = written(kept)
    return kept


def propagated(ids: DataFrame, links: DataFrame, flagged: DataFrame, passes: DataFrame) -> DataFrame:
    """Ids that a flag reaches over links whose both ends let it pass (or are flagged)."""
    open_ids = passes.select("id").unionByName(flagged.select("id")).distinct()
    inner = links.join(open_ids.select(F.col("id").alias("a")), "a", "left_semi").join(open_ids.select(F.col("id").alias("b")), "b", "left_semi")
    return reachable(open_ids, inner, flagged)


def straightest(arms: DataFrame) -> DataFrame:
    """Pairs of arms (node, arm, bearing) of a node that continue each other best: mutual least turn, at most 45 degrees."""
    return junctions.by_node(arms.withColumn("line", F.col("arm")), junctions.best_pairs)


def paired(arms: DataFrame) -> DataFrame:
    """Pairs (node, a, b, turn) of arms (node, arm, line, bearing; null for none) picked straightest first, each arm once, at most 45 degrees.

    Where a node has two arms only, they pair at any angle; arms of one line don't pair.
    """
    return written(junctions.by_node(arms, junctions.picked_pairs))


def matched(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, cost) picked cheapest first, each end once: every round takes those that are best for both ends, the same as one by one."""
    left, kept = written(pairs.select("a", "b", "cost")), None
    while kept is None or not left.isEmpty():
        best = left.select(F.explode(F.array("a", "b")).alias("end"), F.struct("cost", "a", "b").alias("p")).groupBy("end").agg(F.min("p").alias("p"))
        fresh = written(best.groupBy("p").agg(F.count("*").alias("n")).where("n = 2").select("p.a", "p.b", "p.cost"))
        used = fresh.select(F.explode(F.array("a", "b")).alias("used"))
        kept = fresh if kept is None else kept.unionByName(fresh)
        left = written(left.join(used.withColumnRenamed("used", "a"), "a", "left_anti").join(used.withColumnRenamed("used", "b"), "b", "left_anti").select("a", "b", "cost"))
    return kept


def strokes(arms: DataFrame) -> DataFrame:
    """(line, stroke): lines that run on through the pairs of their arms; a stroke is named by its least line."""
    arms = written(arms.select("node", "arm", "line", "bearing"))
    line = arms.select("arm", "line")
    links = paired(arms).join(line.toDF("a", "la"), "a").join(line.toDF("b", "lb"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    return labelled(line.select(F.col("line").alias("id")).distinct(), links).select(F.col("id").alias("line"), F.col("component").alias("stroke"))
