"""N-gram Jaccard join by prefix trees.

Shards ask for each shingle in how many documents it occurs. A document links
only if enough of its shingles recur, so most stop here. The global order is
rare shingles first; two linked sets share a shingle among the first few of
each (their prefix). Sets of like size that share one there form candidate
clusters, which are cut from the table of shingles without making pairs. In a
cluster, ordered sets stand in a prefix tree that each set walks through,
sharing partial overlaps and pruned by what can still come; a walk passes over
sets that already belong to its component. Clusters that do not fit into one
tree are joined block by block.

Defined results: a null or empty text has no shingles and is alone; a text
with fewer words than a shingle is one shingle; equal sets are linked; rows
that share an id stay rows; a null id joins components but never names one;
an empty table yields no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm import kernels as K
from geoloom.llm import shards as S
from geoloom.llm.set_trie import spanning_links
from geoloom.llm.store import written
from geoloom.operators.graph import components

KEY_BITS = 30
#: Shingles in one block of a cluster.
BLOCK_SHINGLES = 4 << 20


def _sets(texts: K.Texts, n: int) -> list[np.ndarray]:
    """Each text's distinct shingles, as hashes."""
    words = K.Words(texts, lower=True)
    grams = K.word_grams(words.hash, n)
    out = []
    for a, b in zip(words.first, words.first[1:]):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(K.word_grams(words.hash[a:b], int(b - a)) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _keys(shingles: np.ndarray, buckets: int) -> np.ndarray:
    return ((shingles >> np.uint64(34)) % np.uint64(buckets) << np.uint64(KEY_BITS)) | (shingles & np.uint64((1 << KEY_BITS) - 1))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, block_shingles: int = BLOCK_SHINGLES, **sizes) -> DataFrame:
    """One row per document: n_shingles, and component_id, the smallest id reachable by links.

    Two documents link when 100 * intersection >= percent * union.
    """
    dealt = S.deal(docs, id_col, text_col, whole_ids=False, **sizes)
    buckets = dealt.buckets

    def send(table: pa.Table) -> pa.Table:
        sets = _sets(K.Texts(table), words)
        key = np.sort(_keys(np.concatenate(sets), buckets))
        at = K.starts_of(key)
        count = np.minimum(np.diff(np.append(at, len(key))), 255).astype(np.uint8)
        key, shard = key[at], table.column("shard")[0].as_py()
        limits = S.split_by_bucket(key, buckets, KEY_BITS)
        return S.message_table([{"bucket": b, "shard": shard, "a": K.pack_sorted(key[i:j] & np.uint64((1 << KEY_BITS) - 1)), "b": count[i:j].tobytes()} for b, (i, j) in enumerate(zip(limits, limits[1:])) if j > i])

    def answer(table: pa.Table) -> pa.Table:
        rows = list(S.rows_of(table))
        keys = [K.unpack_sorted(r["a"]) for r in rows]
        limits = np.cumsum([0, *map(len, keys)])
        count = np.concatenate([np.frombuffer(r["b"], np.uint8) for r in rows])
        packed = np.sort((np.concatenate(keys).astype(np.uint64) << np.uint64(33)) | np.arange(limits[-1], dtype=np.uint64))
        key, back = packed >> np.uint64(33), (packed & np.uint64((1 << 33) - 1)).astype(np.int64)
        at = K.starts_of(key)
        total = np.add.reduceat(count[back].astype(np.int64), at)
        rank = np.searchsorted([2, 9, 129], total, side="right").astype(np.uint8)  # once; a few; some; many
        reply = np.empty(limits[-1], dtype=np.uint8)
        reply[back] = np.repeat(rank, np.diff(np.append(at, len(key))))
        return S.message_table([{"bucket": r["bucket"], "shard": r["shard"], "a": K.bits(np.stack((reply[i:j] >> 1, reply[i:j] & 1)).reshape(-1))} for r, i, j in zip(rows, limits, limits[1:])])

    def narrow(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = K.Texts(table)
        sets = _sets(texts, words)
        every = np.concatenate(sets)
        key = _keys(every, buckets)
        entries = np.unique(key)
        limits = S.split_by_bucket(entries, buckets, KEY_BITS)
        rank = np.zeros(len(entries), dtype=np.uint64)
        for r in S.rows_of(answers):
            i, j = limits[r["bucket"]], limits[r["bucket"] + 1]
            both = K.unbits(r["a"], 2 * (j - i)).astype(np.uint64)
            rank[i:j] = both[: j - i] * np.uint64(2) + both[j - i :]
        rank = rank[np.searchsorted(entries, key)]
        token = (rank << np.uint64(62)) | (every >> np.uint64(2))
        size = np.array([len(x) for x in sets], dtype=np.int64)
        at = np.concatenate(([0], np.cumsum(size)))
        mixed = np.concatenate(([0], np.cumsum(K.splitmix(every)))).astype(np.uint64)
        digest = K.splitmix(mixed[at[1:]] - mixed[at[:-1]] + size.astype(np.uint64)).view(np.int64)
        recurs = np.diff(np.concatenate(([0], np.cumsum(rank > 0)))[at])
        need = -(-percent * size // 100)
        prefix = np.where((size > 0) & (recurs >= need), recurs - need + 1, 0)
        tokens = [np.sort(token[at[i] : at[i + 1]])[size[i] - recurs[i] :].tobytes() if prefix[i] else None for i in range(len(sets))]
        return pa.table({"doc_id": texts.ids(), "n": pa.array(size), "digest": pa.array(digest), "prefix": pa.array(prefix), "tokens": pa.array(tokens, pa.binary())})

    asked = S.at_buckets(dealt, S.from_shards(dealt, send), answer)
    sets = written(S.with_answers(dealt, asked, narrow, "doc_id long, n long, digest long, prefix long, tokens binary"))
    links = _cluster_links(sets.where("tokens is not null"), percent, block_shingles)
    found = components(links)
    labelled = sets.select("doc_id", "n", "digest").join(found.withColumnRenamed("id", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    names = labelled.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members"))
    # components of one row need no second look at the table
    return labelled.join(names.where("members > 1").drop("members"), "component", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _cluster_links(sets: DataFrame, percent: int, block_shingles: int) -> DataFrame:
    """Links (a, b) between digests that join each component of all links."""

    def heads(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            n, prefix = t.column("n").to_numpy(), t.column("prefix").to_numpy()
            tokens = [np.frombuffer(x, np.int64, count=p) for x, p in zip(t.column("tokens").to_pylist(), prefix)]
            band = np.floor(np.log(np.maximum(n, 1)) / (math.log(100 / percent) * 1.0001) if percent < 100 else n).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64)),
                pa.array(np.repeat(band, prefix)),
                pa.array(np.repeat(t.column("digest").to_numpy(), prefix)),
            ], names=["token", "band", "digest"])

    head = sets.select("n", "prefix", "digest", "tokens").mapInArrow(heads, "token long, band int, digest long")
    leaders = written(head.groupBy("token", "band").agg(F.min("digest").alias("least"), F.max("digest").alias("most")))
    own = head.join(leaders.where("least <> most"), ["token", "band"]).where("digest <> least").select(F.col("digest").alias("a"), F.col("least").alias("b")).distinct()
    above = leaders.select("token", (F.col("band") + 1).alias("band"), F.col("least").alias("a"))
    near = leaders.join(above, ["token", "band"]).where("a <> least").select("a", F.col("least").alias("b")).distinct()
    clusters = components(own.unionByName(near)).withColumnRenamed("id", "digest").withColumnRenamed("component", "cluster")
    members = sets.select("digest", "n", "tokens").join(clusters, "digest").groupBy("cluster", "digest").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    members = written(members)
    blocks = members.groupBy("cluster").agg(F.ceil(F.sum(F.octet_length("tokens")) / (8 * block_shingles)).cast("int").alias("blocks"), F.count("*").alias("sets")).where("sets > 1")
    spread = (
        members.join(blocks, "cluster")
        .withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "digest", "n", "tokens")
    )

    def join(table: pa.Table) -> pa.Table:
        digest, n = table.column("digest").to_numpy(), table.column("n").to_numpy()
        tokens = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        values, back, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        place = np.empty(len(values), dtype=np.int64)
        place[np.lexsort((values, -count))] = np.arange(len(values))  # what most sets share comes first, so paths are shared
        numbered = np.split(place[back], np.cumsum([len(x) for x in tokens])[:-1])
        side = None if i == j else (table.column("block").to_numpy() == i).astype(int)
        found = spanning_links([np.sort(x) for x in numbered], n, percent, side)
        return pa.table({"a": pa.array([digest[x] for x, _ in found], pa.int64()), "b": pa.array([digest[y] for _, y in found], pa.int64())})

    return spread.groupBy("cluster", "i", "j").applyInArrow(join, "a long, b long")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, **sizes) -> DataFrame:
    """``docs`` with one document of each component: the one of the smallest id .

    All rows of that id stay, as do texts without shingles and rows with a null id, which cannot be told apart.
    """
    found = jaccard_components(docs, id_col, text_col, words, percent, **sizes)
    gone = found.where((F.col("n_shingles") > 0) & (F.col("doc_id") != F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(gone, docs[id_col] == gone["__id"], "left_anti")
