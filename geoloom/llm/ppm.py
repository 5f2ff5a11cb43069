"""Language-model scoring by prediction by partial matching.

The model is a byte-context trie of ``ORDER`` bytes: counts of every context
and next byte (and of the end of a text) over all training texts. A byte's
probability comes from the longest context that has it; each shorter context
costs an escape (method D: half a count of each distinct successor), and
successors that a longer context already offered are excluded from the shorter
ones. Counts follow update exclusion: a shorter context counts a byte once for
each one-byte-longer context that has it.

A shard sends its distinct n-grams with their training counts to the bucket of
the two bytes before the predicted one; there the whole subtree of longer
contexts meets, and each n-gram's log probability goes back. Contexts of one
and no byte have at most 256 * 256 counts; Spark adds these up beforehand.

The base score is an add-one unigram model over words; word counts travel the
same way.

Defined results: a null text is empty, and has its end alone; rows with a null
id hash as the empty string and yield null ids; an empty table yields no rows;
with no training text every byte is equally likely. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm import kernels as K
from geoloom.llm import shards as S
from geoloom.llm.store import written

ORDER = 5
#: Bytes that UTF-8 never has: before a text, and its end.
START, END = 0xFE, 0xFF
_HIGH = np.uint64(0xFF)
_ROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_counts", pa.float64()), ("score", pa.float64()), ("total", pa.bool_())])


def _stream(texts: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """All texts with START bytes before and one END after each, and each predicted byte's place."""
    n, size = len(texts), np.diff(texts.at)
    out = np.full(len(texts.bytes) + n * (ORDER + 1), START, dtype=np.uint8)
    begin = texts.at[:-1] + np.arange(n) * (ORDER + 1) + ORDER
    text = np.repeat(np.arange(n), size + 1)
    place = np.arange(len(text)) + (text + 1) * ORDER
    out[place] = END
    own = np.arange(len(texts.bytes)) + np.repeat(begin - texts.at[:-1], size)
    out[own] = texts.bytes
    return out, place


def _grams(stream: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The contexts, nearest byte first, then the byte: one number each."""
    out = np.zeros(len(stream) - ORDER, dtype=np.uint64)
    for back in range(1, ORDER + 1):
        out <<= np.uint64(8)
        out |= stream[ORDER - back : len(stream) - back]
    out <<= np.uint64(8)
    out |= stream[ORDER:]
    return out[place - ORDER]


def _held_out(texts: K.Texts, table: pa.Table) -> np.ndarray:
    """By text; the shard's rows carry the flag."""
    return np.asarray(table.column("held_out").combine_chunks())[texts.row].astype(bool)


def _parts(texts: K.Texts) -> list[tuple[int, int]]:
    """Ranges of texts of bounded size, whose numbers fit beside an n-gram into 64 bits."""
    out, i = [], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(texts.at, texts.at[i] + K.PIECE_BYTES, side="right")) - 1)
        j = min(j, i + (1 << (64 - 8 * (ORDER + 1))))
        out.append((i, j))
        i = j
    return out


class _Part:
    """N-grams of a range of texts, sorted, with the text of each."""

    def __init__(self, texts: K.Texts, lo: int, hi: int):
        some = object.__new__(K.Texts)
        some.id, some.bytes, some.at = texts.id[lo:hi], texts.bytes[texts.at[lo] : texts.at[hi]], texts.at[lo : hi + 1] - texts.at[lo]
        stream, place = _stream(some)
        text = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(some.at) + 1)
        shift = np.uint64(64 - 8 * (ORDER + 1))
        both = np.sort((_grams(stream, place) << shift) | text)
        self.text = (both & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int32)
        gram = both >> shift
        del both
        self.at = K.starts_of(gram)
        self.gram = gram[self.at]
        self.size = np.diff(np.append(self.at, len(gram)))


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """One row per document: held_out, n_tokens, n_known, train_tokens, base_score and score; learns from rows where ``held_out`` is false."""
    sizes = {"shard_bytes": 8 << 20} | sizes
    dealt = S.deal(docs, id_col, text_col, also={"held_out": F.coalesce(held_out, F.lit(False))}, whole_ids=False, **sizes)
    buckets = dealt.buckets
    pairs = _pair_counts(dealt.rows)

    def route(gram: np.ndarray) -> np.ndarray:
        """By the two bytes before the predicted one."""
        return K.splitmix(gram >> np.uint64(8 * (ORDER - 1))) % np.uint64(buckets)

    def entries(parts: list[_Part], held: np.ndarray, ranges: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Distinct n-grams of all parts in the order of (bucket, n-gram), training counts, and each part's places in them."""
        known = parts[0].gram if len(parts) == 1 else np.unique(np.concatenate([p.gram for p in parts]))
        count = np.zeros(len(known), dtype=np.int64)
        places = []
        for p, (lo, hi) in zip(parts, ranges):
            where = np.searchsorted(known, p.gram)
            if len(p.at):
                np.add.at(count, where, np.add.reduceat((~held[lo:hi])[p.text].astype(np.int64), p.at))
            places.append(where)
        order = np.argsort(route(known), kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        return known[order], count[order], [rank[w] for w in places]

    def words_of(texts: K.Texts) -> tuple[K.Words, np.ndarray, np.ndarray]:
        words = K.Words(texts, lower=True)
        h = words.hash >> np.uint64(1) << np.uint64(1)
        known = np.unique(np.append(h, np.zeros(1, np.uint64)))  # 0 is the end
        return words, known, np.append(np.searchsorted(known, h), 0)

    def word_limits(known: np.ndarray) -> np.ndarray:
        """Limits of the buckets, which are ranges of hashes here."""
        return np.append(np.searchsorted(known, np.array([i * (1 << 64) // buckets for i in range(buckets)], dtype=np.uint64)), len(known))

    def send(table: pa.Table) -> pa.Table:
        texts = K.Texts(table)
        held = _held_out(texts, table)
        ranges = _parts(texts)
        known, count, _ = entries([_Part(texts, lo, hi) for lo, hi in ranges], held, ranges)
        shard = table.column("shard")[0].as_py()
        limits = np.searchsorted(route(known), np.arange(buckets + 1))
        out = [{"bucket": b, "shard": shard, "a": K.planes(known[i:j]), "b": K.planes(count[i:j].astype(np.uint32))} for b, (i, j) in enumerate(zip(limits, limits[1:])) if j > i]
        words = K.Words(texts, lower=True)
        tagged = np.sort(np.append(words.hash >> np.uint64(1) << np.uint64(1) | (~held[words.text]).astype(np.uint64), (~held).astype(np.uint64)))  # 0 is the end
        at = K.starts_of(tagged >> np.uint64(1))
        known, count = tagged[at] >> np.uint64(1) << np.uint64(1), np.add.reduceat(tagged & np.uint64(1), at).astype(np.uint32)
        limits = word_limits(known)
        out += [{"bucket": b, "shard": shard, "c": K.planes(known[i:j]), "d": K.planes(count[i:j])} for b, (i, j) in enumerate(zip(limits, limits[1:])) if j > i]
        return S.message_table(out)

    def answer(table: pa.Table) -> pa.Table:
        rows, out = list(S.rows_of(table)), []
        for key, value, kind in (("a", "b", "gram"), ("c", "d", "word")):
            own = [r for r in rows if r[key] is not None]
            if not own:
                continue
            keys = [K.unplanes(r[key], np.uint64) for r in own]
            limits = np.cumsum([0, *map(len, keys)])
            known, back = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.bincount(back, weights=np.concatenate([K.unplanes(r[value], np.uint32) for r in own]), minlength=len(known)).astype(np.int64)
            if kind == "gram":
                reply = log_probabilities(known, count, pairs)[back].astype(np.float32)
                out += [{"bucket": r["bucket"], "shard": r["shard"], "a": reply[i:j].tobytes()} for r, i, j in zip(own, limits, limits[1:])]
            else:
                reply = count[back]
                out += [{"bucket": r["bucket"], "shard": r["shard"], "c": K.planes(reply[i:j])} for r, i, j in zip(own, limits, limits[1:])]
                out.append({"bucket": own[0]["bucket"], "shard": -1, "d": np.array([count.sum(), (count > 0).sum()], dtype=np.int64).tobytes()})
        return S.message_table(out)

    def add_up(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:  # the group of the buckets' totals
            both = np.sum([np.frombuffer(r["d"], np.int64) for r in S.rows_of(answers)], axis=0)
            row = {"doc_id": None, "held_out": None, "n_tokens": int(both[0]), "n_known": int(both[1]), "log_counts": None, "score": None, "total": True}
            return pa.Table.from_pylist([row], schema=_ROW)
        texts = K.Texts(table)
        held = _held_out(texts, table)
        ranges = _parts(texts)
        parts = [_Part(texts, lo, hi) for lo, hi in ranges]
        known, _, places = entries(parts, held, ranges)
        limits = np.searchsorted(route(known), np.arange(buckets + 1))
        logs = np.zeros(len(known))
        words, kinds, inverse = words_of(texts)
        kind_limits = word_limits(kinds)
        counts = np.zeros(len(kinds), dtype=np.int64)
        for r in S.rows_of(answers):
            b = r["bucket"]
            if r["a"] is not None:
                logs[limits[b] : limits[b + 1]] = np.frombuffer(r["a"], np.float32)
            if r["c"] is not None:
                counts[kind_limits[b] : kind_limits[b + 1]] = K.unplanes(r["c"], np.int64)
        total = np.concatenate([np.bincount(p.text, weights=np.repeat(logs[w], p.size), minlength=hi - lo) for p, w, (lo, hi) in zip(parts, places, ranges)])
        end, of_word = counts[inverse[-1]], counts[inverse[:-1]]
        log_counts = np.bincount(words.text, weights=np.log10(of_word + 1.0), minlength=len(texts)) + np.log10(end + 1.0)
        return pa.table({
            "doc_id": texts.ids(),
            "held_out": pa.array(held),
            "n_tokens": pa.array(words.per_text.astype(np.int64) + 1),
            "n_known": pa.array(np.bincount(words.text, weights=of_word > 0, minlength=len(texts)).astype(np.int64) + int(end > 0)),
            "log_counts": pa.array(log_counts),
            "score": pa.array(total),
            "total": pa.array(np.zeros(len(texts), dtype=bool)),
        })

    answers = S.at_buckets(dealt, S.from_shards(dealt, send), answer)
    rows = written(S.with_answers(dealt, answers, add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double, total boolean"))
    n, kinds = rows.where("total").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_known"), F.lit(0))).first()
    return rows.where("not total").select(
        "doc_id", "held_out", "n_tokens", "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.log10(F.lit(float(n + kinds + 1)))).alias("base_score"),
        "score",
    )


def _pair_counts(texts: DataFrame) -> np.ndarray:
    """For each byte after each byte, the distinct bytes before both in training: 256 * 256 numbers at most."""

    def triples(batches):
        seen = np.zeros(1 << 24, dtype=bool)
        for batch in batches:
            for t in K.pieces(batch):
                n, size = len(t), np.diff(t.at)
                out = np.full(len(t.bytes) + 3 * n, START, dtype=np.int32)
                begin = t.at[:-1] + 3 * np.arange(n) + 2
                out[np.arange(len(t.bytes)) + np.repeat(begin - t.at[:-1], size)] = t.bytes
                out[begin + size] = END
                seen[(out[:-2] << 16) | (out[1:-1] << 8) | out[2:]] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen))], names=["triple"])

    out = np.zeros((256, 256), dtype=np.int64)
    counts = texts.where(~F.col("held_out")).select("doc_id", "body").mapInArrow(triples, "triple long").distinct().groupBy((F.col("triple") % 65536).alias("pair")).agg(F.count("*").alias("n"))
    for pair, n in counts.where((F.floor(F.col("pair") / 256) != END) & (F.col("pair") % 256 != START)).collect():
        out[pair >> 8, pair & 255] = n
    return out


def log_probabilities(gram: np.ndarray, count: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 of each n-gram's last byte after its context.

    ``gram`` is sorted and closed: all n-grams whose two nearest context bytes
    are among these are there, with their training counts (0: only asked for).
    ``pairs`` has the distinct bytes before each pair of bytes.
    """
    # per order: the distinct (context, byte) of training, their counts, and their contexts' sums
    levels = {ORDER: (gram[count > 0], count[count > 0])}
    for k in range(ORDER - 1, 1, -1):
        longer = levels[k + 1][0]
        levels[k] = np.unique((longer >> np.uint64(16) << np.uint64(8)) | (longer & _HIGH), return_counts=True)
    flat = np.arange(1 << 16, dtype=np.uint64)
    one = pairs.reshape(-1)
    levels[1] = (flat[one > 0], one[one > 0])
    zero = (pairs > 0).sum(axis=0)
    levels[0] = (np.flatnonzero(zero).astype(np.uint64), zero[zero > 0])

    def find(level: int, key: np.ndarray) -> np.ndarray:
        """Count of each (context, byte) in a level, 0 where it isn't."""
        have, n = levels[level]
        if not len(have):
            return np.zeros(len(key), dtype=np.int64)
        where = np.minimum(np.searchsorted(have, key), len(have) - 1)
        return np.where(have[where] == key, n[where], 0)

    def shorten(level: int, key: np.ndarray) -> np.ndarray:
        """(context, byte) of the level below: the farthest byte goes."""
        return (key >> np.uint64(16) << np.uint64(8)) | (key & _HIGH) if level > 1 else key & _HIGH

    out = np.zeros(len(gram))
    todo = np.arange(len(gram))
    excluded_n = np.zeros(len(gram), dtype=np.int64)  # counts, in this level, of bytes that a longer context has
    excluded_d = np.zeros(len(gram), dtype=np.int64)  # and how many those are
    for k in range(ORDER, -1, -1):
        if not len(todo):
            break
        key = ((gram[todo] >> np.uint64(8 * (ORDER - k) + 8)) << np.uint64(8)) | (gram[todo] & _HIGH)
        have, n = levels[k]
        context = have >> np.uint64(8)
        at = K.starts_of(context)
        sums = np.add.reduceat(n, at) if len(at) else np.zeros(0, np.int64)
        kinds = np.diff(np.append(at, len(have)))
        names = context[at]
        if k:
            below = find(k - 1, shorten(k, have))
            covered = np.add.reduceat(below, at) if len(at) else sums
        else:
            covered = sums
        where = np.minimum(np.searchsorted(names, key >> np.uint64(8)), max(len(names) - 1, 0))
        there = names[where] == key >> np.uint64(8) if len(names) else np.zeros(len(key), bool)
        total = np.where(there, sums[where] if len(names) else 0, 0) - excluded_n[todo]
        distinct = np.where(there, kinds[where] if len(names) else 0, 0) - excluded_d[todo]
        own = find(k, key)
        hit = own > 0
        some = distinct > 0
        out[todo[hit]] += np.log10((own[hit] - 0.5) / total[hit])
        miss = ~hit & some
        out[todo[miss]] += np.log10(0.5 * distinct[miss] / total[miss])
        excluded_n[todo] = np.where(there, covered[where] if len(names) else 0, 0)
        excluded_d[todo] = np.where(there, kinds[where] if len(names) else 0, 0)
        todo = todo[~hit]
    if len(todo):  # bytes that training never has: equal shares of what is left
        out[todo] -= np.log10(np.maximum(255 - excluded_d[todo], 1))  # all bytes but START
    return out
