"""Equality does not hang on patterns of bytes that cancel out in a polynomial hash."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import decontaminate, jaccard_join, kernels, ppm, substring_dedup, suffix_dedup

TAIL = " a b c d e f g h i j k l"


def pattern(n):
    """A word of n letters and the same with both letters swapped."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("xy"[b] for b in bits), "".join("yx"[b] for b in bits)


@pytest.fixture(scope="module")
def pairs(spark):
    rows = []
    for k, n in enumerate((64, 504, 512, 1024, 2048)):
        one, other = pattern(n)
        rows += [(10 * k + 1, f"{one}{TAIL}{k}"), (10 * k + 2, f"{other}{TAIL}{k}")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_slices_hash():
    rng = np.random.default_rng(3)
    b = rng.integers(97, 99, 5000).astype(np.uint8)
    start = np.sort(rng.integers(0, 4000, 300))
    end = start + rng.integers(0, 900, 300)
    for lane in (0, 1):
        h = kernels.slices_hash(b, start, end, lane)
        names = [b[i:j].tobytes() for i, j in zip(start, end)]
        assert len(set(zip(names, h.tolist()))) == len(set(names)) == len(set(h.tolist()))
    for n in (8, 64, 512, 1024, 4096):
        one, other = (np.frombuffer(x.encode(), np.uint8) for x in pattern(n))
        both = np.concatenate((one, other))
        h = kernels.slices_hash(both, np.array([0, n]), np.array([n, 2 * n]))
        assert h[0] != h[1]


def test_same_bytes():
    b = np.frombuffer(b"abcabcabd", np.uint8)
    got = kernels.same_bytes(b, np.array([0, 0, 2]), np.array([3, 6, 5]), np.array([3, 3, 0]), most=2)
    assert got.tolist() == [True, False, True]


def test_no_word_is_cut(pairs):
    assert {r.n_removed for r in substring_dedup.remove_repeats(pairs).collect()} == {0}


def test_no_byte_is_cut(spark):
    one, other = pattern(64)
    rows = [(1, one * 2 + "-" * 50), (2, other * 2 + "-" * 50)]
    assert {r.n_removed for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def test_equal_hashes_are_compared():
    """Slices with one hash and other bytes are told apart."""
    texts = [np.frombuffer(t, np.uint8) for t in (b"a" * 120, b"b" * 120, b"a" * 120)]
    heads = np.array([[7, 7, 7], [1, 1, 1], [1, 2, 3], [0, 0, 0], [120, 120, 120]])
    gone = suffix_dedup.merge_slices(heads, np.concatenate(texts), 100).reshape(3, -1)
    assert gone[0, 1:].all() and not gone[0, 0] and gone[1, 1:].all() and not gone[1, 0] and gone[2].all()


def test_strangers_are_not_linked(pairs):
    rows = jaccard_join.jaccard_components(pairs, words=13, percent=90).collect()
    assert all(r.component_id == r.doc_id for r in rows)


def test_words_are_counted_apart(pairs):
    rows = {r.doc_id: r for r in ppm.score(pairs, F.col("doc_id") % 10 == 2).collect()}
    for i, r in rows.items():
        assert r.n_known == (14 if i % 10 == 1 else 13)


def test_items_are_told_apart(spark, pairs):
    items = pairs.where("doc_id % 10 = 1").withColumnRenamed("doc_id", "item_id")
    got = {(r.doc_id, r.item_id): r.windows for r in decontaminate.contaminated(pairs, items).collect() if r.doc_id // 10 == r.item_id // 10}
    assert all(n == (8 if i == j else 7) for (i, j), n in got.items())
