"""Stretches of constant width against a plain scan, over batches and tasks."""

import random
import statistics

from geoloom.operators import width_runs as W

R = W.Rules()
SCHEMA = "line_id long, k long, width double"


def split(v):
    out, start, off = [], 0, 0
    for k in range(1, len(v)):
        if abs(v[k] - statistics.median(v[start:k])) > R.tolerance:
            off += 1
            if off == 2:
                out.append((start, k - 2))
                start, off = k - 1, 0
        else:
            off = 0
    return [*out, (start, len(v) - 1)]


def brute(rows):
    lines = {}
    for i, k, w in rows:
        if i is not None and k is not None:
            lines.setdefault(i, {})[k] = w or 0.0
    out = set()
    for i, at in lines.items():
        wide = sorted(k for k, w in at.items() if w >= R.least)
        runs = []
        for k in wide:
            if runs and k - runs[-1][-1] - 1 <= R.gap:
                runs[-1].append(k)
            else:
                runs.append([k])
        for run in runs:
            v = [at.get(k, 0.0) for k in range(run[0], run[-1] + 1)]
            done = []
            for a, b in split(v):
                m = statistics.median(v[a : b + 1])
                if done and abs(done[-1][2] - m) <= R.merge:
                    a = done.pop()[0]
                    m = statistics.median(v[a : b + 1])
                done.append((a, b, m))
            for a, b, m in done:
                share = sum(abs(w - m) <= 1.0 for w in v[a : b + 1]) / (b + 1 - a)
                if (b - a) * R.step >= R.run and m >= R.least and share >= R.share:
                    out.add((i, run[0] + a, run[0] + b, round(m, 9), round(share, 9)))
    return out


def rounded(df):
    return {(r[0], r[1], r[2], round(r[3], 9), round(r[4], 9)) for r in df.collect()}


def test_against_scan(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        k = rng.randrange(-5, 5)
        for _ in range(rng.randrange(1, 14)):
            level = rng.choice([0.0, 0.5, 2.0, 4.0, 5.5, 9.0])
            for _ in range(rng.randrange(1, 30)):
                if rng.random() > 0.04:
                    rows.append((i, k, None if rng.random() < 0.02 else max(0.0, level + rng.gauss(0, 0.4))))
                k += 1
    rows += [(None, 1, 5.0), (7, None, 5.0)] + [(99, k, 3.0) for k in range(5000)]
    want = brute(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        assert rounded(W.constant_widths(spark.createDataFrame(rows, SCHEMA))) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(want) > 60 and (99, 0, 4999, 3.0, 1.0) in want
    assert W.constant_widths(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, sf):
    from geoloom.plans import tidying as Q

    rows = [tuple(r) for r in Q.bay_stations(spark, sf).collect()]
    got = rounded(Q.win12_constant_widths(spark, sf))
    assert got == brute(rows) and len(got) > 10
