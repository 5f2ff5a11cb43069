"""A training corpus from ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept: toxic documents go, of exact copies one stays, of near copies (5-word
shingles, Jaccard 0.8) one stays, documents with benchmark items go, and the
rest is mixed to target weights by source. A document comes out once, with the
number of its copies and their shards, so texts are not multiplied;
``mixing.mixed_rows`` gives the copies themselves, shard by shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import decontaminate, exact_dedup, jaccard_join, mixing, toxicity
from geoloom.llm.store import written

#: Rejected at this score and above.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, labels, F.lit(True), keep=docs.columns, with_evidence=False)
    return scored.where(F.col(scored.columns[-1]) < TOXIC).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, texts included, with the words that the mix takes of each, its copies, and the output shard of each copy."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("source_mixing", mix_sources),
]

#: Nearest-neighbour scores, set joins and hashed draws have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
