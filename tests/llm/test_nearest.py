"""Toxicity scores against a plain reading of the method, and on tables with odd rows."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import queries, toxicity


def fold(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in "".join(chr(ord(c) + 32) if "À" <= c <= "Þ" and c != "×" else c for c in text or "").encode())


def bag(text):
    out = collections.Counter()
    for w in re.findall(rb"[A-Za-z\x80-\xff]+", fold(text)):
        out[w] += 1
        for n in (4, 5, 6):
            if len(w) > n:
                out[n, w[:n]] += 1
    return out


def logit(p):
    p = min(max(p, 1e-3), 1 - 1e-3)
    return math.log(p / (1 - p))


def brute(docs, examples, share):
    """``examples``: (text, label)."""
    bags, labels = [bag(t) for t, _ in examples], [y for _, y in examples]
    n, toxic = len(examples), sum(labels)
    both, with_label = collections.Counter(), collections.Counter()
    for b, y in zip(bags, labels):
        both.update(b.keys())
        with_label.update(b.keys() if y else ())
    idf = {}
    for f, k in both.items():
        e1, e0 = k * toxic / n, k * (n - toxic) / n
        if k >= 4 and (with_label[f] - e1) ** 2 / e1 + (k - with_label[f] - e0) ** 2 / e0 >= 6.635:
            idf[f] = math.log((1 + n) / (1 + k)) + 1e-9

    def vector(b):
        v = {f: (1 + math.log(c)) * idf[f] for f, c in b.items() if f in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {f: x / norm for f, x in v.items()} if v else {}

    vectors = [vector(b) for b in bags]

    def vote(v, but=None):
        cos = sorted(((sum(x * w.get(f, 0) for f, x in v.items()), y) for k, (w, y) in enumerate(zip(vectors, labels)) if k != but), key=lambda c: -c[0])
        near = [(c * c, y) for c, y in cos[:15] if c > 0]
        return (sum(w * y for w, y in near) + 0.1 * toxic / n) / (sum(w for w, _ in near) + 0.1)

    x = [logit(vote(v, k)) for k, v in enumerate(vectors)]
    weight = {1: share * n / toxic, 0: (1 - share) * n / (n - toxic)}
    a, b = 1.0, 0.0
    for _ in range(200):  # damped Newton steps of the weighted likelihood with a weak pull to a = 1, b = 0
        p = [1 / (1 + math.exp(-(a * u + b))) for u in x]
        g = [a - 1, 0.01 * b]
        h = [[1.0, 0.0], [0.0, 0.01]]
        for u, q, y in zip(x, p, labels):
            g[0] += weight[y] * (q - y) * u
            g[1] += weight[y] * (q - y)
            for i, s in enumerate((u, 1)):
                for j, t in enumerate((u, 1)):
                    h[i][j] += weight[y] * q * (1 - q) * s * t
        step = np.linalg.solve(h, g)
        a, b = a - 0.5 * step[0], b - 0.5 * step[1]
    return [1 / (1 + math.exp(-(a * logit(vote(vector(bag(t)))) + b))) for t in docs]


def test_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("toxic is not null").collect()}
    docs = [(r.doc_id, r.text) for r in rows if len(r.text or "") < 3000][:400]
    known = [(i, labels[i]) for i, _ in docs if i in labels]
    text = dict(docs)
    want = brute([t for _, t in docs], [(text[i], y) for i, y in known], sum(y for _, y in known) / len(known))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.tox_score for r in toxicity.score(df, spark.createDataFrame(known, "doc_id long, toxic int"), F.lit(True)).collect()}
    assert [got[i] for i, _ in docs] == pytest.approx(want, abs=2e-3)
    assert len(set(np.round(want, 3))) > 5


def test_odd_rows(spark, tmp_path):
    bad, good = "you vile rotten fool vermin number {}", "a calm meadow under morning light number {}"
    rows = [(k, (bad if k % 2 else good).format(k)) for k in range(60)]
    docs = rows + [(None, bad.format(7)), (None, None), (61, ""), (62, None), (1, rows[1][1]), (63, good.format(1) + " word" * 200_000)]
    labels = [(k, k % 2) for k in range(60)] + [(3, 0), (None, 1), (5, None)]
    spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score int, held_out int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op6_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs)
    assert all(0 <= r.score <= 1 and r.held_out is not None and r.predicted == int(r.score >= 0.5) for r in got)
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add(round(r.score, 9))
    assert len(by[1]) == 1 and by[61] == by[62] and min(by[1]) > 0.5 > max(by[2] | by[63])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(empty, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True)).count() == 0
