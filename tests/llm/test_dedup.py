"""Deduplication against brute force on small tables, with the odd cases: nulls, empty and long texts, ties, repeated rows."""

import collections
import hashlib
import re

import numpy as np
import pytest

from geoloom.llm import exact_dedup, jaccard_join, substring_dedup, suffix_array, suffix_dedup
from tests.oracle import assert_same

WORD = rb"[^\x20\x09-\x0D]+"
ODD = [(None, "a b c d e f g h i j k l m n o p q " * 3), (900001, None), (900002, ""), (900003, " \n\t "), (900004, "one"), (900005, "one two"), (900006, "ab" * 400), (900007, "ab" * 300), (900008, "w " * 200), (900009, "x" * 99), (900010, "x" * 100), (900010, "x" * 100)]


def rows_of(spark, sf, n=120):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(n).collect()]
    long = " ".join(t for _, t in docs[:25])
    return docs + ODD + [(910000, long), (910001, long + " tail"), (910002, docs[3][1])]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "other") for i, t in rows], "doc_id long, text string, shard string")


def least(i):
    return -(1 << 63) if i is None else i


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for n in (60, 900):
        t = rng.integers(97, 99, n).astype(np.uint8)
        t = np.concatenate((t, t[: n // 2], np.full(30, 97, np.uint8)))
        b, sa = t.tobytes(), suffix_array.suffix_array(t, 4 * n)
        assert list(sa) == sorted(range(len(t)), key=lambda i: b[i:])
        lcp = suffix_array.common_prefixes(t, sa, 10**6)
        for k in range(1, len(sa)):
            x, y = b[sa[k] :], b[sa[k - 1] :]
            m = next((j for j in range(min(len(x), len(y))) if x[j] != y[j]), min(len(x), len(y)))
            assert lcp[k] == m


def test_suffix_dedup(spark, sf):
    rows = sorted(rows_of(spark, sf), key=lambda r: (least(r[0]), r[1] or ""))
    seen, want = set(), collections.Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen.add(b[p : p + 100])
        spans = sum(1 for q in range(len(b)) if gone[q] and (q == 0 or not gone[q - 1]))
        want[i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()] += 1
    got = collections.Counter(tuple(r)[:5] for r in suffix_dedup.remove_repeats(table(spark, rows), shard_bytes=20_000).collect())
    assert got == want


def test_slices_merge_across_arrays():
    """An anchor whose slices need many arrays gives what one array gives."""
    rng = np.random.default_rng(5)
    core = rng.integers(97, 123, 40).astype(np.uint8)
    texts = [np.concatenate((rng.integers(97, 99, 70).astype(np.uint8), core, rng.integers(97, 99, 58).astype(np.uint8))) for _ in range(40)]
    texts += [texts[3], np.concatenate((texts[4][:120], texts[5][120:]))]
    n = len(texts)
    heads = np.stack((np.full(n, 7), np.array([hash(t.tobytes()) for t in texts]), np.arange(n), np.zeros(n, int), np.array([len(t) for t in texts]))).astype(np.int64)
    whole = suffix_dedup.merge_slices(heads, np.concatenate(texts), 100)
    assert whole.any() and (suffix_dedup.merge_slices(heads, np.concatenate(texts), 100, array_bytes=400) == whole).all()


def test_fixed_blocks(spark, sf):
    rows = rows_of(spark, sf)
    words = [(i, re.findall(WORD, (t or "").encode())) for i, t in rows]
    first = {}
    for i, w in words:
        for p in range(len(w) - 12):
            k = tuple(w[p : p + 13])
            first[k] = min(first.get(k, least(i)), least(i))
    want = collections.Counter()
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < least(i):
                gone[p : p + 13] = [True] * 13
        want[i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()] += 1
    got = substring_dedup.remove_repeats(table(spark, rows), shard_bytes=20_000).collect()
    assert collections.Counter(tuple(r)[:4] for r in got) == want
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(table(spark, rows), window=12, block=7)


@pytest.mark.parametrize("n, percent, block", [(3, 90, 4 << 20), (5, 80, 4 << 20), (3, 60, 200)])
def test_jaccard(spark, sf, n, percent, block):
    rows = [r for r in rows_of(spark, sf) if r[0] is not None]
    lower = lambda t: re.findall(WORD, bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    sets = []
    for i, t in rows:
        w = lower(t)
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, s) in enumerate(sets):
        for b in range(a):
            common = len(s & sets[b][1])
            if common and 100 * common >= percent * len(s | sets[b][1]):
                parent[find(a)] = find(b)
    names = {}
    for k, (i, s) in enumerate(sets):
        names[find(k)] = min(names.get(find(k), i), i)
    want = collections.Counter((i, len(s), names[find(k)]) for k, (i, s) in enumerate(sets))
    got = jaccard_join.jaccard_components(table(spark, rows), words=n, percent=percent, block_shingles=block, shard_bytes=20_000)
    assert collections.Counter(map(tuple, got.collect())) == want


def test_jaccard_with_null_id(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (None, "z y x w v"), (9, None)]
    got = collections.Counter(map(tuple, jaccard_join.jaccard_components(table(spark, rows), words=3, percent=90).collect()))
    assert got == collections.Counter([(None, 4, 4), (4, 4, 4), (None, 3, None), (9, 0, 9)])
    assert jaccard_join.drop_near_copies(table(spark, [*rows, (5, "a b c d e f")])).count() == 4


def test_exact(spark, sf, duck):
    from geoloom.llm import queries

    assert_same(queries.op3_exact_dedup(spark, sf), duck.sql(queries.ORACLE_SQL["op3_exact_dedup"]))
    rows = [(1, "Ab"), (2, "aB"), (3, None), (None, ""), (5, "Ä"), (6, "ä"), (7, "x"), (7, "X"), (None, "q"), (None, "Q")]
    got = sorted(exact_dedup.exact_groups(table(spark, rows)).collect(), key=str)
    by = collections.defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    assert all(sum(r.kept for r in g) == 1 and all(r.group_size == len(g) for r in g) for g in by.values())
    assert {(r.doc_id, r.keep_id) for r in got} == {(1, 2), (2, 2), (3, 3), (None, 3), (5, 5), (6, 6), (7, 7), (None, None)}
    assert exact_dedup.drop_copies(table(spark, rows)).count() == 6


def test_empty_tables(spark):
    empty = table(spark, [])
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert exact_dedup.exact_groups(empty).count() == 0
