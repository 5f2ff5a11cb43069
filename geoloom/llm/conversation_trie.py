"""The prefix trie of conversations, its subtrees summed along an Euler tour.

A node is a distinct sequence of first turns. Nodes come from one aggregate over (depth, key), the key being the
exclusive or, over the turns so far, of two 60-bit hashes (SHA-256) of place, role and text: so keys are running values
that a scan gives in blocks, and no conversation, however long, is walked in one task. At 10^11 prefixes two would share
both hashes with a chance of 10^-14.

Each node has an enter and an exit arc; the tour goes from a node's enter arc through its children to its exit arc. It is
ranked in two levels. Subtrees of few turns (``CHUNK``), with the same parent and bucket, follow each other in the tour;
each such chunk ranks its own arcs by pointer jumping in memory. The list of chunks and of the arcs of the nodes above them
is ranked by pointer jumping over tables, a round for each doubling; a chunk counts as many arcs as it has. An arc's place
is its chunk's place and its rank within. Prefix sums at these places, again a scan in blocks, give a subtree's leaves and
savings as the difference between its exit and its enter arc. A hot prefix is split into buckets of children; it holds no
chunk together.

The digest of a node's ends is a single SHA-256 over their ids in order, which no two tasks can share: ids travel in packed
runs, sorted, and one task streams the runs of a node through the hash, with one batch in memory.

Defined results: rows without conv_id are left out; a null role or text is empty; turns follow their number, null first,
equal ones their role and then the text's digest; rows that repeat stay turns; c % 20 has the sign of c; a
conversation whose turns all give way to an absent head is turnless and ends at the root; sums beyond 63 bits count as
the largest number; texts of any length are read once and travel as digests; an empty table has no root and yields no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.store import ship_package, written

WORDS = r"[^\x20\x09-\x0D]+"
#: Turns of a chunk, about; and places in a block of a scan.
CHUNK, BLOCK = 1 << 15, 1 << 16
#: Ids in a packed run, at most.
RUN = 256
#: Conversations that share a head, and the turns a head has at most.
FAMILY, HEADS = 20, 4

NODE = ["depth", "k1", "k2"]
_TOUR = pa.schema([("id", pa.int64()), ("enter", pa.int64()), ("exit", pa.int64())])
_DIGEST = pa.schema([("id", pa.int64()), ("ends_sha256", pa.string())])


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with n, their number from 1 on within ``key``. Rows are dealt by ranges of key and order, so a large key takes many tasks."""
    rows = rows.withColumn("__id", F.monotonically_increasing_id())
    dealt = written(rows.repartitionByRange(key, *order, "__id").withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy(key, "__part").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(key, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(key, "__part").orderBy(*order, "__id"))
    return dealt.join(before, [key, "__part"]).withColumn("n", F.col("__before") + own).drop("__id", "__part", "__before")


def running(rows: DataFrame, keys: list[str], place: str, values: dict[str, str], block: int) -> DataFrame:
    """``rows`` with each value in ``values`` (column: sum or bit_xor) made running along the places 0, 1, 2... of each key, block by block."""
    cut = rows.withColumn("__block", F.floor(F.col(place) / block))
    agg = {c: getattr(F, how) for c, how in values.items()}
    totals = cut.groupBy(*keys, "__block").agg(*(f(c).alias(c) for c, f in agg.items()))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "__block", *(F.coalesce(f(c).over(earlier), F.lit(0)).alias(f"__{c}") for c, f in agg.items()))
    w = Window.partitionBy(*keys, "__block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    both = lambda c: F.col(f"__{c}").bitwiseXOR(agg[c](c).over(w)) if values[c] == "bit_xor" else F.col(f"__{c}") + agg[c](c).over(w)
    out = cut.join(before, [*keys, "__block"])
    return out.select(*(both(c).alias(c) if c in values else F.col(c) for c in rows.columns))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation's turns (conv, len, place from 1, digest, words) after its head was taken from its family's first; and all (conv, len)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"))
    own = written(numbered(rows, "conv", ["turn", "role", "digest"]).select("conv", "n", "digest", "words"))
    lens = own.groupBy("conv").agg(F.max("n").alias("own_len"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    base = lens.select(F.col("conv").alias("base"), F.col("own_len").alias("base_len"))
    convs = lens.withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % FAMILY).join(base, "base", "left")
    convs = convs.withColumn("head", F.least("h", F.coalesce("base_len", F.lit(0).cast("long"))))
    convs = written(convs.select("conv", "base", "h", "head", (F.col("head") + F.greatest(F.col("own_len") - F.col("h"), F.lit(0))).alias("len")))
    first = own.where(F.col("n") < HEADS).select(F.col("conv").alias("base"), F.col("n").alias("place"), "digest", "words")
    heads = convs.where("head > 0").withColumn("place", F.explode(F.sequence(F.lit(1).cast("long"), F.col("head")))).join(first, ["base", "place"])
    tails = own.join(convs, "conv").where("n > h").withColumn("place", F.col("head") + F.col("n") - F.col("h"))
    columns = ["conv", "len", "place", "digest", "words"]
    return heads.select(*columns).unionByName(tails.select(*columns)), convs.select("conv", "len")


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, len, depth, k1, k2, g1, g2, words): the key of each prefix, and what its last turn adds to it."""
    name = F.sha2(F.concat(F.concat(F.col("place").cast("string"), F.lit(":")).cast("binary"), F.col("digest")), 256)
    part = lambda at: F.conv(F.substring(name, at, 15), 16, 10).cast("long")
    rows = written(turns.select("conv", "len", F.col("place").alias("depth"), part(1).alias("g1"), part(16).alias("g2"), "words"))
    return running(rows.withColumns({"k1": F.col("g1"), "k2": F.col("g2")}), ["conv"], "depth", {"k1": "bit_xor", "k2": "bit_xor"}, block)


def trie_nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(id, depth, k1, k2, conv_id, n_convs, n_children, weight, saved, parent, parent_conv_id), written. The weight is the number of turns from here on in all members, and so no less than the nodes below."""
    weight = lambda c: F.sum((F.col("len") - c + 1).cast("decimal(38,0)")).alias("weight")
    up = lambda k, g: F.max(F.col(k).bitwiseXOR(F.col(g)))
    inner = rows.groupBy(*NODE).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), up("k1", "g1").alias("p1"), up("k2", "g2").alias("p2"), weight(F.col("depth")))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), weight(zero)).where("n_convs > 0").select(*(zero.alias(c) for c in NODE), "conv_id", "n_convs", zero.alias("words"), *(F.lit(None).cast("long").alias(c) for c in ("p1", "p2")), "weight")
    nodes = written(inner.unionByName(root).withColumn("id", F.monotonically_increasing_id()))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = nodes.where("depth > 0").join(parents, ["depth", "p1", "p2"])
    linked = written(below.select("id", "parent", "parent_conv_id"))
    children = linked.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    saved = (F.col("n_convs") - 1).cast("decimal(19,0)") * F.col("words").cast("decimal(18,0)")
    whole = nodes.join(linked, "id", "left").join(children, "id", "left")
    return written(whole.select("id", *NODE, "conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "weight", saved.cast("decimal(38,0)").alias("saved"), "parent", "parent_conv_id"))


def tour_of(parent: np.ndarray) -> np.ndarray:
    """The next arc of each, -1 at the end: arcs 2i (enter) and 2i + 1 (exit) of node i; a parent of -1 is none, and such nodes follow each other."""
    n = len(parent)
    following = np.empty(2 * n, np.int64)
    following[::2] = np.arange(n) * 2 + 1
    following[1::2] = np.where(parent < 0, -1, parent * 2 + 1)
    order = np.argsort(parent, kind="stable")
    sorted_parent = parent[order]
    same = sorted_parent[1:] == sorted_parent[:-1]
    following[order[:-1][same] * 2 + 1] = order[1:][same] * 2
    first = np.concatenate((np.ones(min(n, 1), bool), ~same)) & (sorted_parent >= 0)
    following[sorted_parent[first] * 2] = order[first] * 2
    return following


def list_ranks(following: np.ndarray) -> np.ndarray:
    """Each element's number from the start of its list, by pointer jumping."""
    here = np.arange(len(following))
    to = np.where(following < 0, here, following)
    steps = (following >= 0).astype(np.int64)
    while (steps[to] > 0).any():
        steps, to = steps + steps[to], to[to]
    return len(following) - 1 - steps


def _chunk_ranks(chunk: pa.Table) -> pa.Table:
    ids, parent = np.sort(chunk["id"].to_numpy()), chunk["parent"].to_numpy()[np.argsort(chunk["id"].to_numpy())]
    at = np.minimum(np.searchsorted(ids, parent), len(ids) - 1)
    ranks = list_ranks(tour_of(np.where(ids[at] == parent, at, -1)))
    return pa.table([ids, ranks[::2], ranks[1::2]], schema=_TOUR)


def places_behind(items: DataFrame) -> DataFrame:
    """(item, behind): how many arcs there are from each item (item, next, arcs) to the end of the list, by pointer jumping over tables."""
    state = written(items.select("item", "next", F.col("arcs").alias("behind")))
    while not state.where("next is not null").isEmpty():
        ahead = state.select(F.col("item").alias("next"), F.col("next").alias("then"), F.col("behind").alias("more"))
        state = written(state.join(ahead, "next", "left").select("item", F.col("then").alias("next"), (F.col("behind") + F.coalesce("more", F.lit(0))).alias("behind")))
    return state.select("item", "behind")


def tour_places(nodes: DataFrame, rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(id, enter, exit): the places of each node's arcs in the tour."""
    heavy = written(nodes.where((F.col("weight") > chunk) | (F.col("depth") == 0)))
    above = heavy.where("depth > 0").select(*NODE, F.col("id").alias("h"), "weight")
    path = rows.select("conv", *NODE).join(above, NODE, "left")
    top = path.groupBy("conv").agg(F.max_by(F.struct("h", "weight"), F.when(F.col("h").isNotNull(), F.col("depth"))).alias("above"), F.min(F.when(F.col("h").isNull(), F.struct(*NODE))).alias("light"))
    root = heavy.where("depth = 0").first()
    if root is None:
        return nodes.select("id", *(F.lit(0).cast("long").alias(c) for c in ("enter", "exit")))
    light = nodes.where((F.col("weight") <= chunk) & (F.col("depth") > 0)).select("id", "parent", F.col("conv_id").alias("conv")).join(top, "conv")
    owner = light.withColumn("h", F.coalesce("above.h", F.lit(root.id))).withColumn("parts", F.ceil(F.coalesce("above.weight", F.lit(root.weight)) / chunk).cast("long"))
    dealt = written(owner.select("id", "parent", "h", F.pmod(F.xxhash64("light"), F.greatest("parts", F.lit(1))).alias("bucket")))
    within = dealt.groupBy("h", "bucket").applyInArrow(_chunk_ranks, "id long, enter long, exit long")
    # the list of chunks and heavy arcs: what stands below a heavy node, in order
    enter, leave = lambda c: F.concat(F.lit("e"), F.col(c).cast("string")), lambda c: F.concat(F.lit("x"), F.col(c).cast("string"))
    name = F.concat(F.lit("c"), F.col("h").cast("string"), F.lit(":"), F.col("bucket").cast("string"))
    chunks = dealt.groupBy("h", "bucket").agg((F.count("*") * 2).alias("arcs")).select("h", name.alias("first"), name.alias("last"), "arcs")
    inner = heavy.where("depth > 0").select(F.col("parent").alias("h"), enter("id").alias("first"), leave("id").alias("last"), F.lit(1).cast("long").alias("arcs"))
    below = written(chunks.unionByName(inner))
    order = Window.partitionBy("h").orderBy("first")
    after = below.select(F.col("last").alias("item"), F.coalesce(F.lead("first").over(order), leave("h")).alias("next"), "arcs")
    opening = heavy.select(F.col("id").alias("h")).join(below.groupBy("h").agg(F.min("first").alias("first")), "h", "left")
    opening = opening.select(enter("h").alias("item"), F.coalesce("first", leave("h")).alias("next"), F.lit(1).cast("long").alias("arcs"))
    closing = heavy.where("depth = 0").select(leave("id").alias("item"), F.lit(None).cast("string").alias("next"), F.lit(1).cast("long").alias("arcs"))
    behind = places_behind(after.unionByName(opening).unionByName(closing))
    place = behind.select("item", (F.lit(behind.agg(F.max("behind")).first()[0]) - F.col("behind")).alias("at"))
    trunk = heavy.select("id", enter("id").alias("e"), leave("id").alias("x")).join(place.toDF("e", "enter"), "e").join(place.toDF("x", "exit"), "x").select("id", "enter", "exit")
    ranked = within.join(dealt.select("id", name.alias("item")), "id").join(place, "item").select("id", (F.col("at") + F.col("enter")).alias("enter"), (F.col("at") + F.col("exit")).alias("exit"))
    return trunk.unionByName(ranked)


def subtree_sums(nodes: DataFrame, places: DataFrame, values: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """(id, each value summed over the node's subtree): prefix sums at the node's exit arc, less those before its enter arc."""
    own = nodes.select("id", *(c.cast("decimal(38,0)").alias(k) for k, c in values.items())).join(places, "id")
    arc = lambda side, sign: F.struct(F.col(side).alias("place"), F.lit(sign).alias("sign"), *((F.col(k) if sign < 0 else F.lit(0).cast("decimal(38,0)")).alias(k) for k in values))
    arcs = written(own.select("id", F.explode(F.array(arc("enter", -1), arc("exit", 1))).alias("a")).select("id", "a.*", *(F.col(f"a.{k}").alias(f"own_{k}") for k in values)))
    summed = running(arcs, [], "place", dict.fromkeys(values, "sum"), block)
    # at the enter arc a value is in the sum already
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    return summed.groupBy("id").agg(*(F.least(F.sum(F.when(F.col("sign") > 0, F.col(k)).otherwise(F.col(f"own_{k}") - F.col(k))), most).cast("long").alias(k) for k in values))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a node over its runs, which come in order."""
    node, digest = None, hashlib.sha256()
    for batch in batches:
        done = []
        for i, run in zip(batch["id"].to_pylist(), batch["ids"].to_pylist()):
            if i != node:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = i, hashlib.sha256(run.encode())
            else:
                digest.update(b"," + run.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], schema=_DIGEST)
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], schema=_DIGEST)


def end_digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256): SHA-256 of the ascending ids, comma between, of the conversations (id, conv) that end at a node."""
    runs = written(ends.groupBy("id", F.floor(F.col("conv") / RUN).alias("run")).agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")))
    count = runs.groupBy("id").agg(F.count("*").alias("n"))
    one = runs.join(count.where("n = 1"), "id", "left_semi").select("id", F.sha2("ids", 256).alias("ends_sha256"))
    many = runs.join(count.where("n > 1"), "id", "left_semi").repartition("id").sortWithinPartitions("id", "run")
    return one.unionByName(many.select("id", "ids").mapInArrow(_streamed, "id long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """A row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ship_package(conversations.sparkSession)
    turns, convs = rebuilt(conversations)
    rows = written(prefixes(turns, block))
    nodes = trie_nodes(rows, convs)
    places = tour_places(nodes, rows, chunk)
    sums = subtree_sums(nodes, places, {"n_leaves": (F.col("n_children") == 0).cast("int"), "saved_tokens": F.col("saved")}, block)
    zero = F.lit(0).cast("long")
    ends = rows.where("depth = len").select("conv", *NODE).unionByName(convs.where("len = 0").select("conv", *(zero.alias(c) for c in NODE)))
    digests = end_digests(ends.join(nodes.select("id", *NODE), NODE).select("id", "conv"))
    out = nodes.join(sums, "id").join(digests, "id", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
