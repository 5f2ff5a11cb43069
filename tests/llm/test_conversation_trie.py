"""The prefix trie against a walk over plain lists."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from geoloom.llm import conversation_trie as trie
from geoloom.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), role, digest, text))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        seqs[c] = own.get(base, [])[:h] + v[h:]
    members = collections.defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[tuple(seqs[c][:d])].append(c)
    out = {}
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        gain = (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += gain
    for k, m in members.items():
        ends = ",".join(str(c) for c in m if len(seqs[c]) == len(k))
        out[k] = (m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest())
    return collections.Counter(out.values())


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def invented(seed, n=160, kinds=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(0, 7))):
            rows.append((c, t, ["user", "assistant", None][int(rng.integers(0, 3)) if t > 2 else t % 2], f"w{rng.integers(0, kinds)} x" if rng.random() > 0.1 else None))
    return rows


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert collections.Counter(tuple(r) for r in queries.op11_conversation_trie(spark, sf).collect()) == brute(rows)


@pytest.mark.parametrize("chunk, block", [(1, 3), (9, 7), (60, 1 << 16)])
def test_chunks_and_blocks(spark, chunk, block):
    rows = invented(chunk)
    got = trie.prefix_trie(table(spark, rows), chunk, block)
    assert collections.Counter(map(tuple, got.collect())) == brute(rows)


def test_odd_rows(spark):
    rows = [*invented(7, 40, 2), (None, 0, "user", "lost"), (-5, 0, "user", "a"), (-25, 1, "user", "b"), (-20, 0, "user", "c"), (500, None, "user", "null first"), (500, 0, "user", "z")]
    rows += [(501, 3, "user", "tie b"), (501, 3, "assistant", "tie a"), (501, 3, "user", "tie b"), (501, 3, None, None), (502, 0, "", ""), (503, 0, None, None)]
    rows += [(1000 + i, t, "user", f"same {t}") for i in range(600) for t in range(2)]
    rows += [(2000, t, "user", f"long {t % 3}") for t in range(300)]
    odd = table(spark, rows).selectExpr("*", "'q' as id", "1 as n", "2 as depth", "3 as place", "4 as conv", "5 as h")
    got = trie.prefix_trie(odd, chunk=50, block=16)
    assert collections.Counter(map(tuple, got.collect())) == brute(rows)


def test_empty_and_turnless(spark):
    assert trie.prefix_trie(table(spark, [])).count() == 0
    alone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(alone, 0, "user", "goes, its head is absent")]
    assert [tuple(r)[:7] for r in trie.prefix_trie(table(spark, rows)).collect()] == [(alone, 0, None, 1, 0, 1, 0)]
    assert collections.Counter(map(tuple, trie.prefix_trie(table(spark, rows)).collect())) == brute(rows)


def test_ranks_of_lists_and_tours():
    rng = np.random.default_rng(2)
    order = rng.permutation(50)
    following = np.full(50, -1)
    following[order[:-1]] = order[1:]
    assert (trie.list_ranks(following)[order] == np.arange(50)).all()
    parent = np.array([-1, 0, 0, 1, -1, 4, 1])
    want = [0, 2 * 1, 2 * 3, 2 * 3 + 1, 2 * 6, 2 * 6 + 1, 2 * 1 + 1, 2 * 2, 2 * 2 + 1, 1, 2 * 4, 2 * 5, 2 * 5 + 1, 2 * 4 + 1]
    assert list(np.argsort(trie.list_ranks(trie.tour_of(parent)))) == want
