"""Exact dedup by progressive refinement, in DataFrame functions only.

One scan turns each text into a few bytes: length, a hash of its beginning, and
its full digest, so no text is shuffled. Then groups are refined: by length; rows
that share theirs by the beginning's hash; rows that still share theirs by the
full digest. Counts are summed before they are shuffled, so a group of copies
of any size costs one row per task.

Defined results: a null text is empty, and equal to other empty ones; of equal
texts the largest id stays, a null id only if there is no other; of rows with
equal id and text one stays; an empty table yields no rows. Columns of other
names pass through ``drop_copies``; names starting with ``__`` are taken.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.store import written

PREFIX = 64


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    body = lower_ascii(F.coalesce(F.col(text_col), F.lit("")))
    return written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).alias("size"),
            F.xxhash64(lower_ascii(F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, PREFIX))).alias("head"),
            F.sha2(body, 256).alias("digest"),
        )
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = fingerprints(docs, id_col, text_col)
    by_size = rows.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size")
    left = rows.join(by_size, "size", "left_semi")
    by_head = left.groupBy("size", "head").agg(F.count("*").alias("n")).where("n > 1").select("size", "head")
    left = left.join(by_head, ["size", "head"], "left_semi")
    groups = left.groupBy("size", "head", "digest").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("n")).where("n > 1")
    return rows.join(groups, ["size", "head", "digest"], "left").select(
        "doc_id",
        F.when(F.col("keep").isNotNull(), F.col("keep.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("keep").isNull() | (F.col("keep.row") == F.col("row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts.

    What stays is decided on narrow rows; texts are shuffled once, by id and digest, so copies of one text spread.
    """
    key = lambda i, digest: F.concat_ws(":", digest, F.col(i).cast("string")).alias("__key")
    kept = exact_groups(docs, id_col, text_col).where("kept").select(key("doc_id", F.col("text_sha256")))
    own = docs.withColumn("__key", key(id_col, F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), 256)))
    left = own.join(kept, "__key", "left_semi")
    same = Window.partitionBy("__key").orderBy(F.col(text_col))
    return left.withColumn("__nth", F.row_number().over(same)).where("__nth = 1").select(*docs.columns)
