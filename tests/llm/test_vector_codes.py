"""Vector codes against plain loops over Python's integers."""

import collections
import hashlib
import math

import numpy as np
import pytest

from geoloom.llm import queries, vector_codes

INF = float("inf")


def brute(rows, parts=8, entries=16, rounds=6):
    """(id, label, entries, error) of each kept row, and the codebooks."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], []
    lengths = collections.Counter(len(v) for _, v, _ in kept)
    n = max(lengths, key=lambda k: (lengths[k], k))
    kept = [r for r in kept if len(r[1]) == n]
    cut = [p * n // parts for p in range(parts + 1)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][cut[p] : cut[p + 1]] for r in first] for p in range(parts)]

    def assign(p, v):
        d = [sum((a - b) ** 2 for a, b in zip(v[cut[p] : cut[p + 1]], e)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for _, v, _ in kept:
                groups[assign(p, v)[0]].append(v[cut[p] : cut[p + 1]])
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    found = [(i, lab, [assign(p, v) for p in range(parts)]) for i, v, lab in kept]
    return [(i, lab, tuple(e for e, _ in a), sum(d for _, d in a)) for i, lab, a in found], books


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def check(spark, rows, **how):
    want, books = brute(rows, **{k: v for k, v in how.items() if k != "members"})
    got = vector_codes.compress(table(spark, rows), **how)
    assert collections.Counter((r.id, r.label, tuple(r.entries), r.error) for r in got.rows.collect()) == collections.Counter(want)
    assert [b.tolist() for b in got.codebooks] == books or not want
    return got


def test_query(spark, sf):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, books = brute(rows)
    by = collections.Counter()
    for _, lab, _, err in want:
        by[lab] += err
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = queries.op13_vector_codes(spark, sf).collect()
    assert collections.Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == collections.Counter((i, "".join(f"{e:02x}" for e in code), err, by[lab], sha) for i, lab, code, err in want)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i) % 90, [float(x) for x in rng.normal(size=16)], None if i % 7 == 0 else int(i) % 3) for i in range(120)]
    rows += [(None, rows[0][1], 1), (3, None, 1), (4, [], None), (5, [1.0] * 15 + [None], 2), (6, [1.0] * 15 + [INF], 2), (7, [float("nan")] * 16, 2), (8, [1.0] * 9, 0)]
    rows += [(1000 + i, [0.5] * 16, 9) for i in range(400)] + [(9, [-0.00001] * 16, None)]
    got = check(spark, rows, members=64)
    assert sum(got.moved) > 0
    names = table(spark, rows[:40]).withColumnRenamed("label", "row").withColumnRenamed("vec_id", "entry").selectExpr("*", "1 as id", "2 as error", "3 as comps", "4 as p")
    assert vector_codes.compress(names, id_col="entry", label_col="row").rows.count() == 40


@pytest.mark.parametrize("how", [dict(parts=3, entries=4, rounds=2), dict(parts=8, entries=16, rounds=0), dict(parts=5, entries=40, rounds=3)])
def test_other_sizes(spark, how):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, size=11) / 8], i % 2) for i in range(30)]
    check(spark, rows, **how)


def test_empty_and_few(spark):
    assert vector_codes.with_label_errors(vector_codes.compress(table(spark, [])).rows).count() == 0
    check(spark, [(2, [0.1] * 8, 1), (1, [0.3] * 8, None)])


def test_largest_numbers(spark):
    rows = [(1, [3e38] * 64, 1), (2, [-3e38] * 64, 1), (3, [0.0] * 64, 1), (4, [1e300] * 64, 1)]
    got = vector_codes.compress(table(spark, rows), entries=2)
    most = vector_codes.limit_of(64)
    assert most == 1 << 27 and {r.id: r.error for r in got.rows.collect()}[3] <= 64 * (2 * most) ** 2
    assert all(r.label_error > 0 for r in vector_codes.with_label_errors(got.rows).collect())


def test_members_that_stay_do_not_move(spark, sf):
    got = vector_codes.compress(spark.read.parquet(f"{sf}/embeddings.parquet"))
    assert len(got.moved) == vector_codes.ROUNDS - 1 and all(m < 8 * 500 / 2 for m in got.moved)
