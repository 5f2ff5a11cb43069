"""The dealt operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import byte_bpe, chat_format, conversation_trie, decontaminate, exact_dedup, jaccard_join, license_scan, mixing, ppm, substring_dedup, suffix_dedup, toxicity, vector_codes


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_documents(spark, sf_dir), with_text=False)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat_format.conversations_as_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat_format.link_tool_calls(calls, results, chat_format.CONVERSATION_TOOLS, chat_format.CONVERSATION_REFERENCES)


def op5_chat_formatting_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of any role, each user's turn after the one before it; op5_chat_formatting follows its SQL twin."""
    return chat_format.format_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(_documents(spark, sf_dir), labels, fold != 0)
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"), F.col("tox_evidence").alias("evidence"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_documents(spark, sf_dir), words=3, percent=90)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return ppm.score(_documents(spark, sf_dir), held_out)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_documents(spark, sf_dir), with_text=False)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).drop("hash")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    words = byte_bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rows = _documents(spark, sf_dir).select("doc_id", byte_bpe.encode(F.col("text"), words).alias("ids"))
    digits = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2(byte_bpe.decode(F.col("ids"), words), 256).alias("decoded_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    code = F.concat(*(F.format_string("%02x", F.col("entries")[p]) for p in range(vector_codes.PARTS)))
    rows = vector_codes.with_label_errors(codes.rows)
    return rows.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(vector_codes.codebooks_sha256(codes.codebooks)).alias("codebooks_sha256"))


def _vector_codes_sql(rounds: int = 6) -> str:
    """Lloyd's rounds as a chain of tables: books b0, b1... and assignments a0, a1..."""
    distance = "CAST(list_sum(list_transform(range(1, 9), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT)"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT vec_id, p, x, e, {distance} AS d FROM parts JOIN b{k} USING (p)) GROUP BY vec_id, p)")
        if k < rounds:
            new = f"SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM a{k}, range(1, 9) r(i) GROUP BY p, e, i) GROUP BY p, e"
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, o.c) AS c FROM b{k} o LEFT JOIN ({new}) m USING (p, e))")
    return f"""
        WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (SELECT vec_id, p, v[p * 8 + 1:p * 8 + 8] AS x FROM kept, range(0, 8) r(p)),
        b0 AS MATERIALIZED (SELECT p, e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) t WHERE e < 16),
        {", ".join(steps)},
        codes AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
        named AS (SELECT sha256(string_agg(CAST(c[i] AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b{rounds}, range(1, 9) r(i))
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes JOIN kept USING (vec_id), named
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_array_dedup, op2_benchmark_decontamination, op3_exact_dedup, op4_license_scan, op5_chat_formatting, op5_chat_formatting_whole, op6_toxicity, op7_ngram_jaccard_join, op8_lm_scoring, op9_substring_dedup, op10_source_mixing, op11_conversation_trie, op12_byte_bpe, op13_vector_codes)}
ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
          doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
        FROM t
    """,
    "op5_chat_formatting": """
        WITH asked AS (SELECT conv_id, turn, text, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations WHERE role = 'user'),
        answers AS (SELECT conv_id, turn - 1 AS asked_turn, turn AS answer_turn, text AS content FROM conversations WHERE role = 'assistant')
        SELECT conv_id, conv_id || ':' || coalesce(turn, asked_turn) AS call_id, CAST(CASE WHEN turn IS NULL THEN NULL WHEN turn > first THEN 1 ELSE 0 END AS INTEGER) AS level, turn, answer_turn,
          CASE WHEN turn IS NOT NULL THEN 'reply' END AS name, answer_turn IS NOT NULL AS linked,
          CASE WHEN turn IS NULL THEN 'orphan' WHEN answer_turn IS NULL THEN 'unanswered' END AS problem,
          CASE WHEN turn IS NOT NULL THEN '{"arguments":{"after":"' || CASE WHEN turn > first THEN '$' || conv_id || ':' || first ELSE '' END || '","prompt":' || CAST(to_json(text) AS VARCHAR)
            || ',"words":' || len(regexp_extract_all(text, '\\S+')) || '},"id":"' || conv_id || ':' || turn || '","name":"reply","role":"call"}' END AS call_json,
          CASE WHEN answer_turn IS NOT NULL THEN '{"content":' || CAST(to_json(content) AS VARCHAR) || ',"id":"' || conv_id || ':' || asked_turn || '","role":"result"}' END AS result_json
        FROM (SELECT coalesce(q.conv_id, a.conv_id) AS conv_id, q.turn, q.text, q.first, a.asked_turn, a.answer_turn, a.content FROM asked q FULL JOIN answers a ON q.conv_id = a.conv_id AND q.turn = a.asked_turn) j
    """,
    # the exclusive ors are a CRC-32 over the digits of conv_id, bit by bit
    "op11_conversation_trie": """
        WITH own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS n, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS said FROM conversations WHERE conv_id IS NOT NULL),
        crc AS (SELECT c, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: ascii(d)::BIGINT)),
            lambda a, d: list_reduce(list_prepend(xor(a, d), range(8)), lambda b, i: xor(b >> 1, 3988292384 * (b & 1)))) AS v FROM (SELECT DISTINCT c FROM own)),
        heads AS (SELECT c, xor(v, 4294967295) % 4 AS h FROM crc),
        turns AS (SELECT q.c, o.n, o.said FROM heads q JOIN own o ON o.c = q.c - q.c % 20 AND o.n <= q.h UNION ALL SELECT o.c, o.n + 1000000, o.said FROM own o JOIN heads q ON o.c = q.c AND o.n > q.h),
        whole AS (SELECT q.c, coalesce(list(t.said ORDER BY t.n) FILTER (t.n IS NOT NULL), []) AS seq FROM heads q LEFT JOIN turns t ON t.c = q.c GROUP BY q.c),
        rows AS MATERIALIZED (SELECT c, d, len(seq) AS len, seq[1:d] AS key FROM whole, LATERAL (SELECT unnest(range(0, len(seq) + 1)) AS d)),
        nodes AS MATERIALIZED (SELECT d, key, min(c) AS rep, count(*) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = len), '')) AS ends_sha256,
            CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(key[d].t, '[^\\x20\\x09-\\x0D]+')) END AS saved FROM rows GROUP BY d, key),
        family AS MATERIALIZED (SELECT n.d, n.key, n.rep, n.n, n.ends_sha256, n.saved, p.rep AS parent FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.key = n.key[1:n.d - 1]),
        children AS (SELECT d - 1 AS d, parent AS rep, count(*) AS k FROM family WHERE d > 0 GROUP BY 1, 2),
        below AS (SELECT r.d, r.key, count(*) FILTER (k.k IS NULL) AS leaves, sum(f.saved) AS saved FROM family f LEFT JOIN children k ON k.d = f.d AND k.rep = f.rep JOIN rows r ON r.c = f.rep AND r.d <= f.d GROUP BY r.d, r.key)
        SELECT f.rep AS conv_id, CAST(f.d AS BIGINT) AS depth, f.parent AS parent_conv_id, f.n AS n_convs, coalesce(k.k, 0) AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, f.ends_sha256
        FROM family f JOIN below b ON b.d = f.d AND b.key = f.key LEFT JOIN children k ON k.d = f.d AND k.rep = f.rep
    """,
    "op13_vector_codes": _vector_codes_sql(),
}
