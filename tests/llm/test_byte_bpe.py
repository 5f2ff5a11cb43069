"""Encoding against the merge rule itself, against whole texts, and there and back."""

import collections
import hashlib

import public_tokenizers as P
import pytest
import regex
from pyspark.sql import functions as F

from geoloom.llm import byte_bpe, queries

FILE = P.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "  a", "a  ", "\n\n\tx", "it's we'LL 'sss ''s", "Ä ö 漢字、かな", "a\x1cb\x85c  d", "<|endoftext|>", "3.14x9 !!'s", "👩‍👩‍👧 x", "ﬁ١٢٣"]
LONG = ["ab " * 50_000, "x" * 200_000, " " * 100_000 + "y", "y" + "\n" * 100_000, "a" + " \t" * 60_000 + "b " * 9, "漢" * 100_000, "w1!" * 60_000, "'s" * 50_000]


def merged(piece: bytes, ranks) -> list[int]:
    """Always the pair of least rank, the first of these."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        least = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
        if parts[least] + parts[least + 1] not in ranks:
            break
        parts[least : least + 2] = [parts[least] + parts[least + 1]]
    return [ranks[x] for x in parts]


def brute(text: str, ranks) -> list[int]:
    return [i for m in regex.findall(P.PATTERN, text) for i in ([ranks[m.encode()]] if m.encode() in ranks else merged(m.encode(), ranks))]


@pytest.fixture(scope="module")
def words(spark):
    return byte_bpe.vocabulary(spark, FILE, P.PATTERN)


def test_query_follows_the_merge_rule(spark, sf):
    ranks = byte_bpe.ranks_of(FILE)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op12_byte_bpe(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in got:
        ids = brute(docs[r.doc_id], ranks)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(docs[r.doc_id].encode()))


@pytest.mark.parametrize("size", [1, 7, 1 << 16])
def test_pieces_do_not_change_ids(spark, words, size):
    coder = byte_bpe.encoding(words.file, words.pattern)
    texts = [*(t for t in ODD if t), *(LONG if size > 7 else [])]
    for t in texts:
        cut = list(byte_bpe.pieces(t, size))
        assert "".join(p for p, _ in cut) == t
        assert byte_bpe.ids_of(coder, t, size) == coder.encode_ordinary(t), t[:40]
        assert size < 7 or max(len(p) for p, _ in cut) <= max(2 * size, len(t) if t[0] in "x漢" else 0, 120_000)


def test_more_blanks_than_the_library_takes(spark, words):
    coder = byte_bpe.encoding(words.file, words.pattern)
    text = "word" + " " * 1_500_000 + "next"
    assert coder.decode_bytes(byte_bpe.ids_of(coder, text)).decode() == text
    assert byte_bpe.ids_of(coder, text)[-1] == coder.encode_ordinary(" next")[-1]


def test_odd_rows_and_names(spark, words):
    rows = [(i, t, "ids", b"body") for i, t in enumerate([*ODD, *LONG])] + [(None, "twice", "x", None), (None, "twice", "x", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids binary")
    got = table.withColumn("found", byte_bpe.encode(F.col("text"), words)).withColumn("back", byte_bpe.decode(F.col("found"), words))
    assert got.columns == ["doc_id", "text", "decoded", "ids", "found", "back"]
    out = collections.Counter((r.doc_id, r.text, bytes(r.back)) for r in got.collect())
    assert out == collections.Counter((i, t, (t or "").encode()) for i, t, *_ in rows)
    assert got.where("text is null or text = ''").select(F.max(F.size("found"))).first()[0] == 0
    assert table.limit(0).select(byte_bpe.encode(F.col("text"), words)).count() == 0


def test_bytes_that_are_no_text(spark, words):
    row = spark.range(1).select(byte_bpe.encode(F.lit(b"a\xff\xfeb"), words).alias("ids"), byte_bpe.decode(F.lit(None).cast("array<int>"), words).alias("none")).first()
    coder = byte_bpe.encoding(words.file, words.pattern)
    assert row.ids == coder.encode_ordinary("a��b") and row.none is None
    assert spark.range(1).select(byte_bpe.decode(F.array(F.lit(row.ids[1])), words).alias("b")).first().b == coder.decode_bytes([row.ids[1]])
