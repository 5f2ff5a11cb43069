"""Mixing sources to target weights, in DataFrame and SQL functions only.

Each source's documents are dealt by hash into blocks, whose order is a hash
permutation. A target of r times the source takes every block floor(r) times
and then whole blocks in permuted order; in the one block where the target
falls, documents follow in hash order, and the last one gives its first words
only. So a source meets its target to the word. A source has ``BLOCKS`` blocks
at most, so that the tree stays small; the block that is cut is itself ordered
in ``STRETCHES`` stretches of hashes, whose sums name the one stretch that a
task has to put in order (of 10**11 documents, some thousand).

Block copies are the quota that a splitting tree deals out: a node's shards are
halved, and each half's share of every source is a multivariate hypergeometric
draw, made item by item from hashed uniforms. Each leaf then owns its own
stretch of each source's permuted blocks, disjoint from all others, and orders
its documents by hash.

Defined results: a null text has no words; a null source is a source of its
own, last in order; sources without words have target 0; repeated rows are
drawn together, each with its own words, and of those where a target falls the
last gives a part; a text of any length is one document; ties of hash follow
the id; an empty table yields no rows. Other columns are ignored by ``mix``;
``mixed_documents`` and ``mixed_rows`` pass them on, and a column of theirs
whose name is taken gets underscores behind its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.store import written

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
#: Documents in a block, about, and blocks of a source at most.
BLOCK_ROWS, BLOCKS = 256, 4096
#: Stretches of hashes in the block where a target falls.
STRETCHES = 4096


def _uniform(*cols) -> Column:
    """In [0, 1), from a hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size, docs) with ``target``: shares by weight 1, 2, 3 in turn, full at ``most`` times the size.

    Sources fill up in the order of most * size / weight, so whether one is full
    follows from sums over those before it.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("weight", ((F.row_number().over(in_order) - 1) % 3 + 1).cast("double"))
    full = (F.lit(most) * F.col("source_size")).cast("double")
    by_fill = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum(full).over(before), F.lit(0.0))
    rate = left / F.sum("weight").over(after)
    is_full = full <= rate * F.col("weight")
    marked = weighed.select("*", full.alias("full"), is_full.alias("is_full"))
    all_rows = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    open_rate = (F.sum(F.col("source_size").cast("double")).over(all_rows) - F.sum(F.when(F.col("is_full"), F.col("full")).otherwise(0.0)).over(all_rows)) / F.sum(F.when(F.col("is_full"), 0.0).otherwise(F.col("weight"))).over(all_rows)
    return marked.select("source", "source_size", "docs", F.when(F.col("is_full"), F.col("full")).otherwise(open_rate * F.col("weight")).alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col)).alias("hash"),
        )
    )


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """A row per document: source facts, its block, the block's permuted place, and ``copies``."""
    rows = _sized(docs, id_col, text_col, source_col, seed)
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    sources = sources.withColumn("blocks", F.least(F.lit(BLOCKS), F.greatest(F.lit(1), F.floor(F.col("docs") / BLOCK_ROWS))).cast("int"))
    sources = sources.withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    sources = written(sources.withColumn("rest", F.floor(F.col("target") + 0.5 - F.col("rounds") * F.col("source_size")).cast("long")))
    dealt = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumn("block", F.pmod(F.xxhash64("hash"), F.col("blocks")).cast("int"))
    blocks = dealt.groupBy("source", "block").agg(F.sum("size").alias("block_size"), F.first("rest").alias("rest"))
    permuted = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "source", "block"), "block")
    blocks = blocks.select("source", "block", "rest", "block_size", F.row_number().over(permuted).alias("place"), F.sum("block_size").over(permuted.rowsBetween(Window.unboundedPreceding, 0)).alias("reach"))
    blocks = written(blocks.withColumn("state", F.when(F.col("reach") <= F.col("rest"), "whole").when(F.col("reach") - F.col("block_size") < F.col("rest"), "cut").otherwise("out")))
    b = blocks.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "place", "state", (F.col("rest") - (F.col("reach") - F.col("block_size"))).alias("room"))
    dealt = dealt.join(b, dealt["source"].eqNullSafe(b["b_source"]) & (dealt["block"] == b["b_block"])).drop("b_source", "b_block")
    # one block a source at most is cut: its documents follow in hash order, the last of them in part
    cut = written(dealt.where("state = 'cut'").withColumn("stretch", F.shiftright("hash", 64 - STRETCHES.bit_length() + 1)))
    sums = cut.groupBy("source", "stretch").agg(F.sum("size").alias("stretch_size"))
    up_to = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("b_source"), F.col("stretch").alias("b_stretch"), "stretch_size", F.coalesce(F.sum("stretch_size").over(up_to), F.lit(0)).alias("ahead"))
    cut = cut.join(sums, cut["source"].eqNullSafe(sums["b_source"]) & (cut["stretch"] == sums["b_stretch"])).withColumn("room", F.col("room") - F.col("ahead"))
    falls = (F.col("room") > 0) & (F.col("room") < F.col("stretch_size"))
    order = Window.partitionBy("source", "stretch").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(order), F.lit(0))
    last = cut.where(falls).withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("room") - before)))
    cut = cut.where(~falls).withColumn("part", F.when(F.col("room") > 0, F.col("size")).otherwise(F.lit(0))).unionByName(last)
    rest = dealt.where("state <> 'cut'").withColumn("part", F.when(F.col("state") == "whole", F.col("size")).otherwise(0))
    columns = ["doc_id", "source", "size", "hash", "source_size", "target", "blocks", "rounds", "block", "place", "state", F.col("part").cast("long").alias("part")]
    every = rest.select(*columns).unionByName(cut.select(*columns))
    return every.withColumn("copies", (F.col("rounds") + ((F.col("part") > 0) | (F.col("state") == "whole")).cast("int")))


def split_tree(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(shard, source, start, quota): how many of each source's items every shard owns, and from which place on.

    ``quotas`` has (source, quota). The tree's nodes are rows; each level halves
    them, so its depth is the logarithm of ``shards``.
    """
    item = F.struct(F.col("source").alias("source"), F.col("quota").cast("long").alias("quota"))
    nodes = quotas.agg(F.array_sort(F.collect_list(item)).alias("items"), F.sum("quota").cast("long").alias("total")).select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "items", F.coalesce("total", F.lit(0)).cast("long").alias("total"))
    width = shards
    while width > 1:
        half = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        room = F.floor(F.col("total") * (half - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")

        def one_source(acc, x):
            def draw(a, i):
                left = _uniform(F.lit(seed), F.col("lo"), F.col("hi"), x["source"], i) * a["total"] < a["room"]
                return F.struct((a["took"] + left.cast("long")).alias("took"), (a["room"] - left.cast("long")).alias("room"), (a["total"] - 1).alias("total"))

            first = F.struct(F.lit(0).cast("long").alias("took"), acc["room"].alias("room"), acc["total"].alias("total"))
            end = F.aggregate(F.when(x["quota"] > 0, F.sequence(F.lit(1).cast("long"), x["quota"])).otherwise(F.array().cast("array<bigint>")), first, draw)
            return F.struct(end["room"].alias("room"), end["total"].alias("total"), F.concat(acc["out"], F.array(end["took"])).alias("out"))

        begin = F.struct(room.alias("room"), F.col("total").alias("total"), F.array().cast("array<bigint>").alias("out"))
        drawn = nodes.withColumn("half", half).withColumn("room", room).withColumn("left", F.aggregate("items", begin, one_source)["out"])
        part = lambda sign: F.zip_with("items", "left", lambda x, n: F.struct(x["source"].alias("source"), (n if sign else x["quota"] - n).alias("quota")))
        halves = F.array(
            F.struct(F.col("lo").alias("lo"), F.col("half").alias("hi"), part(True).alias("items"), F.col("room").alias("total")),
            F.struct(F.col("half").alias("lo"), F.col("hi").alias("hi"), part(False).alias("items"), (F.col("total") - F.col("room")).alias("total")),
        )
        stay = F.array(F.struct("lo", "hi", "items", "total"))
        nodes = written(drawn.select(F.explode(F.when(F.col("hi") - F.col("lo") > 1, halves).otherwise(stay)).alias("n")).select("n.*"))
        width = -(-width // 2)
    leaves = nodes.select(F.col("lo").alias("shard"), F.explode("items").alias("i")).select("shard", "i.source", "i.quota")
    so_far = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.select("shard", "source", F.coalesce(F.sum("quota").over(so_far), F.lit(0)).alias("start"), "quota")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 16, seed: int = 7, with_source: bool = False) -> DataFrame:
    """One row per document: size, source_size, target, taken, copies (the last may be a part), and ``shards``, the output shard of each copy."""
    plan = written(_plan(docs, id_col, text_col, source_col, seed))
    # items: each block once a round, then the blocks of the last, partial round
    last = plan.where("state <> 'out'").groupBy("source").agg(F.max("place").alias("last"))
    sizes = plan.groupBy("source").agg(F.max("blocks").alias("blocks"), F.max("rounds").alias("rounds"))
    quotas = sizes.join(last, sizes["source"].eqNullSafe(last["source"]), "left").select(sizes["source"], (F.col("blocks").cast("long") * F.col("rounds") + F.coalesce("last", F.lit(0))).alias("quota"))
    leaves = split_tree(quotas, shards, seed).where("quota > 0").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("start", "shard"))).alias("starts"))
    leaves = leaves.withColumnRenamed("source", "l_source")
    joined = plan.join(leaves, plan["source"].eqNullSafe(leaves["l_source"]), "left")
    item = lambda k: (F.col("place") - 1 + k * F.col("blocks")).cast("long")
    owner = lambda k: F.element_at(F.filter("starts", lambda s: s["start"] <= item(k)), -1)["shard"]
    of_copy = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), owner)).otherwise(F.array().cast("array<int>"))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("rounds") + F.col("part")).alias("taken"), "copies", of_copy.alias("shards"), "hash", *["source"] * with_source)


def _free(name: str, docs: DataFrame) -> str:
    """``name``, with underscores behind it until ``docs`` has no such column."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 16, seed: int = 7) -> DataFrame:
    """``docs``' rows with what the mix takes of each: mix_words, mix_copies, mix_shards (the output shard of each copy) and mix_order."""
    key = ["__id", "__source", "__size"]
    alike = Window.partitionBy(*key)
    drawn = mix(docs, id_col, text_col, source_col, shards, seed, with_source=True)
    drawn = drawn.select(F.col("doc_id").alias("__id"), F.coalesce("source", F.lit("\0")).alias("__source"), F.col("size").alias("__size"), "taken", "copies", "shards", "hash")
    drawn = drawn.withColumn("__nth", F.row_number().over(alike.orderBy(F.desc("taken"))))
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    own = docs.select("*", F.col(id_col).alias("__id"), F.coalesce(F.col(source_col).cast("string"), F.lit("\0")).alias("__source"), words.alias("__size"))
    own = own.withColumn("__nth", F.row_number().over(alike.orderBy(F.xxhash64(text_col))))
    same = F.col("o.__id").eqNullSafe(F.col("d.__id"))
    for c in (*key[1:], "__nth"):
        same = same & (F.col(f"o.{c}") == F.col(f"d.{c}"))
    names = [_free(f"mix_{c}", docs) for c in ("words", "copies", "shards", "order")]
    return own.alias("o").join(drawn.alias("d"), same).select(*(F.col(f"o.`{c}`") for c in docs.columns), *(F.col(f"d.{c}").alias(n) for c, n in zip(("taken", "copies", "shards", "hash"), names)))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 16, seed: int = 7, splits: int = 8) -> DataFrame:
    """The mix itself: ``docs``' rows, once a copy, with ``mix_shard``, ``mix_words``, the number of first words that the copy gives, and ``mix_order``.

    Each shard is dealt into ``splits`` partitions by ``mix_order`` and shuffled locally: partitions are in that order.
    """
    drawn = mixed_documents(docs, id_col, text_col, source_col, shards, seed)
    taken, copies, places, order = drawn.columns[-4:]
    shard, words, place = (_free(f"mix_{c}", docs) for c in ("shard", "words", "order"))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = drawn.where(F.col(copies) > 0).select(*docs.columns, F.col(taken).alias("__taken"), F.posexplode(places).alias("__copy", shard), size.alias("__size"))
    rows = rows.withColumn(words, F.least(F.col("__size"), F.col("__taken") - F.col("__copy") * F.col("__size"))).withColumn(place, F.xxhash64(F.lit(seed), F.col(id_col), "__copy", shard))
    rows = rows.select(*docs.columns, shard, words, place)
    return rows.repartition(shards * splits, F.col(shard), F.pmod(place, F.lit(splits))).sortWithinPartitions(shard, place)
