"""Substring dedup by fixed-block anchors.

Every text's non-overlapping blocks of ``block`` words form an index; every
rolling window of ``block`` words probes it. A window of ``window`` words holds
one whole block of any text that also has it if ``window >= 2 * block - 1``, so
no repeat is missed. Hits extend to maximal runs of windows that recur; in
those, whole windows meet by 128 bits of hash (two lanes of mixed words; words
of over 512 bytes by BLAKE2) and the smallest document id wins. The shorter keys
before only choose candidates.

Defined results: a null text has no words; rows with a null id sort before all
ids and yield null ids; rows that share an id are one document to each other
(neither removes from the other); an empty table yields no rows; texts shorter
than a window keep all words. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geoloom.llm import kernels as K
from geoloom.llm import shards as S

KEY_BITS = 30


def _probes(words: K.Words, block: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, shortened hash) of each rolling window, and where those windows are."""
    where = np.flatnonzero(words.whole(block))
    h = K.word_grams(words.hash, block)[where] if len(where) else np.zeros(0, np.uint64)
    return ((h >> np.uint64(34)) % np.uint64(buckets) << np.uint64(KEY_BITS)) | (h & np.uint64((1 << KEY_BITS) - 1)), where


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, block: int = 7, with_text: bool = True, **sizes) -> DataFrame:
    """One row per document: n_words, n_removed, kept_sha256, and with ``with_text`` the kept text."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block: window >= 2 * block - 1")
    dealt = S.deal(docs, id_col, text_col, whole_ids=False, **sizes)
    buckets = dealt.buckets

    def send_probes(table: pa.Table) -> pa.Table:
        words = K.Words(K.Texts(table), lower=False)
        key, where = _probes(words, block, buckets)
        tagged = np.sort(key << np.uint64(1) | (words.place[where] % block == 0).astype(np.uint64))
        key = tagged >> np.uint64(1)
        at = K.starts_of(key)
        ends = np.append(at[1:], len(key)) - 1
        several, anchor = ends > at, (tagged[ends] & np.uint64(1)).astype(bool) if len(at) else np.zeros(0, bool)
        key, shard = key[at], table.column("shard")[0].as_py()
        limits = S.split_by_bucket(key, buckets, KEY_BITS)
        return S.message_table([
            {"bucket": b, "shard": shard, "a": K.pack_sorted(key[i:j] & np.uint64((1 << KEY_BITS) - 1)), "b": K.bits(several[i:j]), "c": K.bits(anchor[i:j])}
            for b, (i, j) in enumerate(zip(limits, limits[1:])) if j > i
        ])

    def answer_probes(table: pa.Table) -> pa.Table:
        rows = list(S.rows_of(table))
        keys = [K.unpack_sorted(r["a"]) for r in rows]
        limits = np.cumsum([0, *map(len, keys)])
        several = np.concatenate([K.unbits(r["b"], len(k)) for r, k in zip(rows, keys)])
        anchor = np.concatenate([K.unbits(r["c"], len(k)) for r, k in zip(rows, keys)])
        packed = np.sort((np.concatenate(keys).astype(np.uint64) << np.uint64(33)) | np.arange(limits[-1], dtype=np.uint64))
        key, back = packed >> np.uint64(33), (packed & np.uint64((1 << 33) - 1)).astype(np.int64)
        at = K.starts_of(key)
        size = np.diff(np.append(at, len(key)))
        recurs = (size > 1) | np.logical_or.reduceat(several[back], at)
        anchored = recurs & np.logical_or.reduceat(anchor[back], at)
        reply = np.empty((2, limits[-1]), dtype=bool)
        reply[0, back], reply[1, back] = np.repeat(recurs, size), np.repeat(anchored, size)
        return S.message_table([{"bucket": r["bucket"], "shard": r["shard"], "a": K.bits(reply[0, i:j]), "b": K.bits(reply[1, i:j])} for r, i, j in zip(rows, limits, limits[1:])])

    def send_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = K.Texts(table)
        words = K.Words(texts, lower=False)
        key, where = _probes(words, block, buckets)
        entries = np.unique(key)
        limits = S.split_by_bucket(entries, buckets, KEY_BITS)
        flags = np.zeros((2, len(entries)), dtype=bool)
        for r in S.rows_of(answers):
            i, j = limits[r["bucket"]], limits[r["bucket"] + 1]
            flags[0, i:j], flags[1, i:j] = K.unbits(r["a"], j - i), K.unbits(r["b"], j - i)
        place = np.searchsorted(entries, key)
        sums = np.zeros((2, len(words) + 1), dtype=np.int32)
        for k in range(2):
            hit = np.zeros(len(words), dtype=np.int32)
            hit[where] = flags[k, place]
            np.cumsum(hit, out=sums[k, 1:])
        span = window - block + 1
        found = np.flatnonzero(words.whole(window))
        found = found[(sums[0, found + span] - sums[0, found] == span) & (sums[1, found + span] > sums[1, found])]
        mask = np.zeros(len(words), dtype=bool)
        mask[found] = True
        shard = table.column("shard")[0].as_py()
        out = [{"bucket": shard % buckets, "shard": shard, "d": K.bits(mask)}]
        if len(found):
            hashes, first = _distinct(words, found, window, buckets)
            owner = texts.id[words.text[found[first]]]
            limits = S.split_by_bucket(hashes[0], buckets, 34)
            out += [{"bucket": b, "shard": shard, "a": K.planes(hashes[1][i:j]), "b": K.planes(owner[i:j]), "c": K.planes(hashes[2][i:j])} for b, (i, j) in enumerate(zip(limits, limits[1:])) if j > i]
        return S.message_table(out)

    def answer_windows(table: pa.Table) -> pa.Table:
        rows = list(S.rows_of(table))
        out = [{"bucket": -1, "shard": r["shard"], "d": r["d"]} for r in rows if r["d"] is not None]
        rows = [r for r in rows if r["d"] is None]
        if rows:
            hashes = [K.unplanes(r["a"], np.uint64) for r in rows]
            limits = np.cumsum([0, *map(len, hashes)])
            owner = np.concatenate([K.unplanes(r["b"], np.int64) for r in rows])
            h, second = np.concatenate(hashes), np.concatenate([K.unplanes(r["c"], np.uint64) for r in rows])
            order, at = _grouped(h, second)
            least = np.minimum.reduceat(owner[order], at)
            later = np.empty(len(h), dtype=bool)
            later[order] = owner[order] > np.repeat(least, np.diff(np.append(at, len(h))))
            out += [{"bucket": r["bucket"], "shard": r["shard"], "a": K.bits(later[i:j])} for r, i, j in zip(rows, limits, limits[1:])]
        return S.message_table(out)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = K.Texts(table)
        words = K.Words(texts, lower=False)
        marks = np.zeros(len(words), dtype=bool)
        replies = list(S.rows_of(answers))
        found = np.flatnonzero(np.concatenate([K.unbits(r["d"], len(words)) for r in replies if r["bucket"] == -1] or [np.zeros(0, bool)]))
        if len(found):
            hashes, first, inverse = _distinct(words, found, window, buckets, inverse=True)
            limits = S.split_by_bucket(hashes[0], buckets, 34)
            later = np.zeros(len(first), dtype=bool)
            for r in replies:
                if r["bucket"] >= 0:
                    i, j = limits[r["bucket"]], limits[r["bucket"] + 1]
                    later[i:j] = K.unbits(r["a"], j - i)
            own = texts.id[words.text[found]]
            marks[found] = later[inverse] | (own > own[first][inverse])
        gone = K.covered(marks, window)
        kept, kept_at = _joined(texts, words, gone)
        out = {
            "doc_id": texts.ids(),
            "n_words": pa.array(words.per_text.astype(np.int64)),
            "n_removed": pa.array(np.diff(np.concatenate(([0], np.cumsum(gone, dtype=np.int64)))[words.first])),
            "kept_sha256": pa.array([hashlib.sha256(kept[i:j]).hexdigest() for i, j in zip(kept_at, kept_at[1:])], pa.string()),
        }
        if with_text:
            out["kept"] = pa.array([kept[i:j].tobytes() for i, j in zip(kept_at, kept_at[1:])], pa.binary()).cast(pa.string())
        return pa.table(out)

    probed = S.at_buckets(dealt, S.from_shards(dealt, send_probes), answer_probes)
    met = S.at_buckets(dealt, S.with_answers(dealt, probed, send_windows), answer_windows)
    return S.with_answers(dealt, met, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


def _grouped(h: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal pairs together, earlier places first, and where each group starts in it."""
    order = np.argsort(h, kind="stable")
    a, b = h[order], second[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # one lane alone does not tell these apart
        order = np.lexsort((second, h))
        a, b = h[order], second[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new)


def _distinct(words: K.Words, found: np.ndarray, window: int, buckets: int, inverse: bool = False):
    """Distinct windows among those found: bucket, hash and second hash in this order, with the first place of each."""
    h, second = K.word_grams(words.hash, window, found), K.word_grams(words.second(), window, found)
    order, at = _grouped(h, second)
    values, first = h[order][at], order[at]
    route = ((values >> np.uint64(13)) % np.uint64(buckets) << np.uint64(34)) | (values >> np.uint64(30))
    by = np.lexsort((second[first], values, route >> np.uint64(34)))
    out = ((route[by], values[by], second[first][by]), first[by])
    if not inverse:
        return out
    rank, back = np.empty(len(by), dtype=np.int64), np.empty(len(h), dtype=np.int64)
    rank[by] = np.arange(len(by))
    back[order] = np.repeat(rank, np.diff(np.append(at, len(h))))
    return *out, back


def _joined(texts: K.Texts, words: K.Words, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words joined by one space, and where each text's part begins."""
    keep = ~gone
    start, end, text = words.start[keep], words.end[keep], words.text[keep]
    later = np.zeros(len(start), dtype=bool)
    later[1:] = text[1:] == text[:-1]
    edge = np.zeros(len(texts.bytes) + 1, dtype=np.int8)
    edge[start - later] += 1  # the separator before a later word of the text comes along
    edge[end] -= 1
    mask = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    out = np.where(K.SEPARATOR[texts.bytes], np.uint8(0x20), texts.bytes)[mask]
    return out, np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[texts.at]
