"""Odd tables through every stage: nulls, empty tables, repeated rows, clashing names, long texts."""

import collections

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from geoloom.llm import exact_dedup, mixing, toxicity
from geoloom.llm.store import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tox_score string, mix_words string, mix_shards int, shard string, body string, n long"
REST = ("own", "w", 3, "s", "b", 9)


def odd(spark):
    long = " ".join(f"long{k % 977} tail{k % 31}" for k in range(60_000))
    texts = [(None, "a null id of some few words"), (1, None), (2, ""), (3, "  \n"), (4, "one"), (5, long), (6, "One more text, twice the same"), (6, "One more text, twice the same"), (7, "one more text, twice the same"), (8, "x" * 3000)]
    return spark.createDataFrame([(i, t, "en", None if i == 4 else "web", 1, *REST) for i, t in texts], SCHEMA)


def test_every_stage_takes_odd_rows(spark, sf):
    docs = odd(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf))
        assert docs.columns[: len(columns)] == columns, name
        assert all(tuple(r)[5:11] == REST for r in docs.collect()), name
    kept = collections.Counter(r.doc_id for r in docs.collect())
    assert kept == collections.Counter([None, 2, 3, 4, 5, 7, 8])
    assert docs.columns[len(columns) :] == ["mix_words_", "mix_copies", "mix_shards_", "mix_order"]


def test_every_stage_takes_an_empty_table(spark, sf):
    docs = odd(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name


def test_drop_copies_with_clashing_names(spark):
    docs = odd(spark).withColumn("row", F.lit(1)).withColumn("size", F.lit(2)).withColumn("digest", F.lit("d"))
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert collections.Counter(r.doc_id for r in left.collect()) == collections.Counter([None, 2, 3, 4, 5, 7, 8])


@pytest.mark.parametrize("rows", [1, 40])
def test_mixed_rows_give_the_words_that_the_mix_takes(spark, rows):
    """Repeated ids and rows included."""
    docs = spark.createDataFrame([(k % 7 if k % 3 else None, "w " * (k % 11), "ab"[k % 2], "k") for k in range(rows)] * 2, "doc_id long, text string, source string, mix_order string")
    taken = sum(r.taken for r in mixing.mix(docs).collect())
    out = mixing.mixed_rows(docs)
    assert out.columns == ["doc_id", "text", "source", "mix_order", "mix_shard", "mix_words", "mix_order_"]
    assert sum(r.mix_words for r in out.collect()) == taken
    assert sum(r.mix_words for r in mixing.mixed_documents(docs).collect()) == taken
    parts = out.withColumn("p", F.spark_partition_id()).collect()
    for a, b in zip(parts, parts[1:]):
        assert a.p != b.p or (a.mix_shard, a.mix_order_) <= (b.mix_shard, b.mix_order_)


def test_cut_block_in_stretches(spark, monkeypatch):
    """How finely a block is cut does not change what is taken."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 13).cast("int")).alias("text"), F.lit(None).cast("string").alias("lang"), F.when(F.col("id") % 5 < 3, "a").otherwise("b").alias("source"))
    got = []
    for n in (1, 16, 4096):
        monkeypatch.setattr(mixing, "STRETCHES", n)
        got.append(sorted((r.doc_id, r.taken) for r in mixing.mix(docs).collect()))
    assert got[0] == got[1] == got[2]


def test_score_beside_a_column_of_its_name(spark, sf):
    docs = odd(spark).withColumn("tox_evidence", F.lit(1))
    out = toxicity.score(docs, spark.read.parquet(f"{sf}/labels.parquet"), F.lit(True), keep=docs.columns)
    assert out.columns[-3:] == ["tox_evidence", "tox_score_", "tox_evidence_"] and out.count() == 10
