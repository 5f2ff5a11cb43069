"""Texts dealt into shards of bounded size, and the exchange of small messages between them.

Operators that look for repetition ask, for each small unit of every text
(a window, a shingle, an n-gram), something about the whole corpus. A shard
sends its distinct units once, sorted and packed, to buckets; a bucket answers
each shard in the order in which the shard sent. So a unit that occurs a
million times costs one entry a shard, no group of copies meets in one task,
and answers are a bit or a number per distinct unit. Texts are shuffled once:
each round groups by the same key, and Spark reuses that exchange.

A shard has a message for each bucket at most, so messages grow with the square
of the input until they hold one unit each. From 64 GB on, shards and buckets
therefore grow with the square root of the input, up to eight times; messages
then stay in proportion to it up to 4 TB. Tasks hold few shards each, whatever
the session's shuffle partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.store import ship_package

MESSAGE = "bucket int, shard long, a binary, b binary, c binary, d binary"
_MESSAGE = pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), *((x, pa.binary()) for x in "abcd")])

#: Bytes of text in a shard, and in what a bucket answers for. Both bound a task's memory.
SHARD_BYTES = 6 << 20
BUCKET_BYTES = 12 << 20
#: From which input on both grow, and how far.
GROW_FROM, GROW_MOST = 64 << 30, 8
#: Bytes of text that a task works through, shard by shard; grows like shards, and further.
TASK_BYTES, TASKS_MOST = 16 << 20, 100_000


@dataclass(frozen=True)
class Dealt:
    rows: DataFrame  # shard, doc_id, body, where they are read
    texts: DataFrame  # the same, shuffled to their shards
    shards: int
    buckets: int
    bucket_tasks: int


def _tasks(count: int, each: int, grow: float) -> int:
    return max(1, min(TASKS_MOST, -(-count // max(1, int(TASK_BYTES * grow / each)))))


def deal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES, also: dict[str, Column] | None = None, whole_ids: bool = True) -> Dealt:
    """Deals texts by a hash of their ids; rows that share an id meet in one shard if ``whole_ids``.

    Otherwise text and input partition are part of the hash, so rows with a null or repeated id spread, even if
    they share their text too: a shard gets no more than one input partition's of these. ``also``: more columns
    that come along.
    """
    ship_package(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    grow = min(float(GROW_MOST), max(1.0, math.sqrt(total / GROW_FROM)))
    shard_bytes, bucket_bytes = int(shard_bytes * grow), int(bucket_bytes * grow)
    shards, buckets = max(24, -(-total // shard_bytes)), max(8, -(-total // bucket_bytes))
    key = [F.col(id_col)] if whole_ids else [F.col(id_col), F.col(text_col), F.spark_partition_id()]
    rows = docs.select(
        F.pmod(F.xxhash64(*key), F.lit(shards)).alias("shard"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"),
        *(c.alias(k) for k, c in (also or {}).items()),
    )
    return Dealt(rows, rows.repartition(_tasks(shards, shard_bytes, grow), "shard"), shards, buckets, _tasks(buckets, bucket_bytes, grow))


def message_table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist([{"a": None, "b": None, "c": None, "d": None} | r for r in rows], schema=_MESSAGE)


def from_shards(dealt: Dealt, work: Callable[[pa.Table], list[dict]], schema: str = MESSAGE) -> DataFrame:
    return dealt.texts.groupBy("shard").applyInArrow(work, schema)


def at_buckets(dealt: Dealt, messages: DataFrame, work: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return messages.repartition(dealt.bucket_tasks, "bucket").groupBy("bucket").applyInArrow(work, MESSAGE)


def with_answers(dealt: Dealt, answers: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str = MESSAGE) -> DataFrame:
    return dealt.texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(work, schema)


def rows_of(table: pa.Table) -> Iterator[dict]:
    """Messages in the order of (bucket, shard)."""
    yield from sorted(table.to_pylist(), key=lambda r: (r["bucket"], r["shard"]))


def split_by_bucket(sorted_keys: np.ndarray, buckets: int, shift: int) -> np.ndarray:
    """Limits of each bucket in keys that carry it above ``shift`` bits."""
    return np.searchsorted(sorted_keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(shift))
