"""Scoring, classification, contamination, licences, chats and mixing."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from geoloom.llm import chat_format, decontaminate, license_scan, mixing, ppm, queries, toxicity
from tests.oracle import assert_same


def brute_ppm(train, texts, depth=ppm.ORDER):
    tries = [collections.defaultdict(collections.Counter) for _ in range(depth + 1)]
    for b in train:
        s = [0xFE] * depth + list(b) + [0xFF]
        for i in range(depth, len(s)):
            for k in range(depth, -1, -1):
                seen = s[i] in tries[k][tuple(s[i - k : i])]
                tries[k][tuple(s[i - k : i])][s[i]] += 1
                if seen:
                    break
    for b in texts:
        s, total = [0xFE] * depth + list(b) + [0xFF], 0.0
        for i in range(depth, len(s)):
            excluded, done = set(), False
            for k in range(depth, -1, -1):
                c = tries[k].get(tuple(s[i - k : i])) or {}
                rest = {x: n for x, n in c.items() if x not in excluded}
                if not rest:
                    continue
                n = sum(rest.values())
                if s[i] in rest:
                    total += math.log10((rest[s[i]] - 0.5) / n)
                    done = True
                    break
                total += math.log10(0.5 * len(rest) / n)
                excluded |= set(c)
            if not done:
                total -= math.log10(255 - len(excluded))
        yield total


def test_ppm(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()] + [(70001, None), (70002, ""), (70002, "ÿ odd Ж")]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in ppm.score(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, shard_bytes=30_000).collect():
        got[r.doc_id].append(r)
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())) + [None]
    count = collections.Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(count.values()), len(count)
    scores = brute_ppm([(t or "").encode() for i, t in rows if not held(i)], [(t or "").encode() for _, t in rows])
    for (i, t), s in zip(rows, scores):
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(t))
        assert any(abs(r.score - s) < 1e-3 and abs(r.base_score - base) < 1e-6 and r.n_tokens == len(words(t)) and r.n_known == sum(count[w] > 0 for w in words(t)) and r.train_tokens == n and r.held_out == held(i) for r in got[i])


def test_near_is_exact_and_scores_help(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    index, share = toxicity.build(docs, labels, fold != 0)
    assert 0 < share < 0.5
    import numpy as np

    dense = np.zeros((len(index.label), len(index.vocabulary)))
    for f in range(len(index.vocabulary)):
        i, j = index.limits[f, 0], index.limits[f, -1]
        dense[index.example[i:j], f] = index.weight[i:j]
    rng = np.random.default_rng(0)
    for _ in range(40):
        feature = np.sort(rng.choice(len(index.vocabulary), min(5, len(index.vocabulary)), replace=False))
        weight = rng.random(len(feature))
        weight /= np.linalg.norm(weight)
        cosine = dense[:, feature] @ weight
        found, score = index.near(feature, weight, 7)
        assert np.allclose(score, np.sort(cosine[cosine > 0])[::-1][:7]) and np.allclose(cosine[found], score)
    scored = toxicity.score(docs, labels, fold != 0).join(labels.where(fold == 0), "doc_id").collect()
    right = sum((r.tox_score >= 0.5) == bool(r.toxic) for r in scored) / len(scored)
    assert right > 0.9 and all(0 <= r.tox_score <= 1 for r in scored)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None), (1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 1), (1, None)], "doc_id long, toxic int")
    assert [r.tox_score for r in toxicity.score(docs, none, F.lit(True)).collect()] == [0.0] * 3
    assert [r.tox_score for r in toxicity.score(docs, one, F.lit(True), keep=["doc_id", "text"]).collect()] == [1.0] * 3


def test_contamination(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    plain = lambda s: " ".join(re.findall(r"\w+", s.lower()))
    items = {r.item_id: plain(r.text) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, s in items.items() if f" {s} " in f" {plain(r.text)} "}
    got = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= want
    assert decontaminate.drop_contaminated(docs, bench).count() == docs.count() - len({r.doc_id for r in got})


def test_reparameterised(spark):
    q = "If {} has {} apples and buys {} kg more apples, how many apples does {} have in total now?"
    docs = spark.createDataFrame([(1, "So: " + q.format("Bob", 5, 7, "Bob")), (2, q.format("Bob", 5, 7, "Eve")), (3, "nothing of the sort here at all, really"), (4, None), (None, q.format("Alice", 12, 3, "Alice").upper())], "doc_id long, text string")
    bench = spark.createDataFrame([(1, q.format("Alice", 12, 3, "Alice")), (2, None), (3, ""), (4, "two words")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 1): "reparameterised", (None, 1): "exact"}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_licences(spark, sf):
    known, want = license_scan.known_digests(), collections.Counter()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in docs.collect():
        for unit in [*r.text.split("\n"), *([r.text] if "\n" in r.text else [])]:
            licence = known.get(hashlib.sha256(license_scan.canonical(unit).encode()).hexdigest())
            want[r.doc_id, licence] += 1 if licence else 0
    assert {(r.doc_id, r.licence): r.units for r in license_scan.scan(docs).collect()} == {k: n for k, n in want.items() if n}
    odd = spark.createDataFrame([(1, "MIT Licence\n\nCopyright (c) 2020 Foo\n\n" + license_scan.TEXTS["MIT"]), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.licence, r.whole) for r in license_scan.scan(odd).collect()] == [(1, "MIT", True)]


def test_chats(spark, sf, duck):
    assert_same(queries.op5_chat_formatting(spark, sf), duck.sql(queries.ORACLE_SQL["op5_chat_formatting"]))
    calls = spark.createDataFrame(
        [(1, "a", 0, "f", '{"y":2,"x":"q"}'), (1, "b", 1, "f", '{"x":"$a","y":1.5}'), (1, "c", 2, "f", '{"x":"$d","y":1}'), (1, "d", 3, "f", '{"x":"$c","y":1}'), (1, "a", 5, "f", "{}"), (2, "a", 0, "g", "{}"), (2, "e", 0, "f", "[1]"), (3, "a", 0, "h", "{}"), (3, None, 1, "g", None)],
        "conv_id long, call_id string, turn long, name string, arguments string",
    )
    results = spark.createDataFrame([(1, "a", 1, "ok"), (1, "zz", 1, "or"), (2, "a", 1, None)], "conv_id long, call_id string, turn long, content string")
    rows = {(r.conv_id, r.call_id, r.turn): r for r in chat_format.link_tool_calls(calls, results, {"f": {"x": "string", "y": "integer"}, "g": {}}).collect()}
    assert {k: r.problem for k, r in rows.items()} == {(1, "a", 0): None, (1, "a", 5): "duplicate", (1, "b", 1): "arguments: y", (1, "c", 2): "circle", (1, "d", 3): "circle", (1, "zz", None): "orphan", (2, "a", 0): None, (2, "e", 0): "not an object", (3, "a", 0): "unknown tool", (3, None, 1): "not an object"}
    assert rows[1, "a", 0].call_json == '{"arguments":{"x":"q","y":2},"id":"a","name":"f","role":"call"}' and rows[2, "a", 0].result_json == '{"content":null,"id":"a","role":"result"}'
    assert rows[1, "b", 1].level == 1


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight, total, full = {s: k % 3 + 1 for k, s in enumerate(order)}, sum(sizes.values()), set()
    while True:
        rest, weights = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / weights for s in order}
        more = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not more:
            return target
        full |= more


@pytest.mark.parametrize("skew", [False, True])
def test_mixing(spark, sf, skew):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")).alias("source"))
    if skew:
        docs = docs.unionByName(spark.createDataFrame([(10**6, "two words", "z1"), (10**6 + 1, None, "z2"), (10**6 + 2, "a b c", None), (10**6 + 2, "a b c", None)], "doc_id long, text string, source string"))
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()]
    sizes, taken = collections.Counter(), collections.Counter()
    for _, s, n in rows:
        sizes[s] += n
    target = brute_targets(sizes)
    got = mixing.mix(docs).collect()
    source = {i: s for i, s, _ in rows}
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, n) for i, _, n in rows)
    for r in got:
        assert abs(r.target - target[source[r.doc_id]]) < 1e-6 and r.source_size == sizes[source[r.doc_id]] and 0 <= r.taken <= 3 * r.size and len(r.shards) == r.copies
        taken[source[r.doc_id]] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1
    assert sum(r.mix_words for r in mixing.mixed_rows(docs.where("doc_id < 1000000")).collect()) == sum(r.taken for r in mixing.mix(docs.where("doc_id < 1000000")).collect())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([("a", 37), ("b", 5), (None, 11), ("z", 0)], "source string, quota long")
    leaves = mixing.split_tree(quotas, 6, seed=3).collect()
    by, width = collections.Counter(), collections.Counter()
    for r in leaves:
        by[r.source] += r.quota
        width[r.shard] += r.quota
    assert by == {"a": 37, "b": 5, None: 11, "z": 0} and max(width.values()) - min(width.values()) <= 3
    for s in by:
        parts = sorted((r.start, r.quota) for r in leaves if r.source == s)
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
