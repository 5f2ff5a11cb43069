"""Substring dedup by suffix arrays.

A window is ``length`` bytes. Its anchor is the least-hashed ``GRAM`` bytes in
it, so equal windows have equal anchors at equal places, and neighbouring
windows mostly share one: a run of them travels as one slice of text. Shards
first ask which anchors recur at all; slices of the others never leave. The
rest go to the bucket of their anchor, where equal slices of other shards are
found by binary search in sorted lists; what differs is laid end to end, given
a suffix array by Larsson-Sadakane refinement and Kasai's common prefixes, and
windows that share ``length`` bytes form a class whose first member stays. An
anchor whose slices do not fit into one array is spread over several; their
distinct windows are merged by binary search in the sorted windows before.
Hashes only bring slices together: no byte goes before bytes were compared.

Defined results: a null text is empty; rows with a null id come before all
others and yield null ids; rows that share an id are ordered by their text;
an empty table yields no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geoloom.llm import kernels as K
from geoloom.llm import shards as S
from geoloom.llm.suffix_array import repeat_classes

GRAM = 32
PIECE = 1 << 17
#: Bytes in one suffix array.
ARRAY_BYTES = 2 << 20


def slices(b: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor, inside their texts: first window, end of windows, anchor's hash."""
    firsts, anchors = [], []
    for lo in range(0, max(len(b) - length + 1, 0), PIECE):
        hi = min(lo + PIECE + length - 1, len(b))
        h = K.BYTE[b[lo:hi]]
        size = 1
        while size < GRAM:
            h = (h[:-size] ^ (h[:-size] >> np.uint64(32))) * K.STEP + h[size:]
            size *= 2
        h = K.finish(h)
        low = np.uint64((1 << 19) - 1)
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width, size = length - GRAM + 1, 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if width > size:
            least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
        where = (least & low).astype(np.int64)
        change = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        firsts.append(change + lo)
        anchors.append(np.stack((where[change] + lo, h[where[change]].view(np.int64))))
    if not firsts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.concatenate(firsts)
    anchor, code = np.concatenate(anchors, axis=1)
    new = np.ones(len(first), dtype=bool)
    new[1:] = anchor[1:] != anchor[:-1]
    first, code = first[new], code[new].view(np.uint64)
    end = np.append(first[1:], len(b) - length + 1)
    # cut runs at the limits of texts: windows that would cross into the next one go
    text = np.searchsorted(at, first, side="right") - 1
    last = np.searchsorted(at, end - 1, side="right") - 1
    limit = np.maximum(at[1:] - length + 1, at[:-1])
    cross = np.flatnonzero(last > text)
    more = []
    for i in cross:  # one per text limit
        for t in range(text[i] + 1, last[i] + 1):
            s, e = at[t], min(end[i], limit[t])
            if e > s:
                more.append((s, e, i))
    end = np.minimum(end, limit[text]) if len(first) else end
    if more:
        s, e, i = np.array(more).T
        first, end, code = np.concatenate((first, s)), np.concatenate((end, e)), np.concatenate((code, code[i]))
        order = np.argsort(first, kind="stable")
        first, end, code = first[order], end[order], code[order]
    good = end > first
    return first[good], end[good], K.splitmix(code[good])


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the slices, one slice after the other."""
    total = np.concatenate(([0], np.cumsum(size)))
    return np.arange(total[-1]) + np.repeat(start - total[:-1], size)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, with_text: bool = True, **sizes) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans, kept_sha256, and with ``with_text`` the kept bytes."""
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} at least")
    dealt = S.deal(docs, id_col, text_col, **sizes)
    buckets = dealt.buckets

    def route(code: np.ndarray) -> np.ndarray:
        return (code >> np.uint64(33)) % np.uint64(buckets)

    def send_anchors(table: pa.Table) -> pa.Table:
        texts = K.Texts(table)
        code = np.sort(slices(texts.bytes, texts.at, length)[2])
        at = K.starts_of(code)
        several = np.diff(np.append(at, len(code))) > 1
        code = code[at]
        to = route(code)
        shard = table.column("shard")[0].as_py()
        order = np.argsort(to, kind="stable")
        limits = np.searchsorted(to[order], np.arange(buckets + 1))
        return S.message_table([{"bucket": b, "shard": shard, "a": code[order[i:j]].tobytes(), "b": K.bits(several[order[i:j]])} for b, (i, j) in enumerate(zip(limits, limits[1:])) if j > i])

    def answer_anchors(table: pa.Table) -> pa.Table:
        rows = list(S.rows_of(table))
        codes = [np.frombuffer(r["a"], np.uint64) for r in rows]
        limits = np.cumsum([0, *map(len, codes)])
        code = np.concatenate(codes)
        several = np.concatenate([K.unbits(r["b"], len(c)) for r, c in zip(rows, codes)])
        ordered = np.sort(code)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        place = np.searchsorted(twice, code)
        recurs = several | (twice[np.minimum(place, len(twice) - 1)] == code if len(twice) else False)
        own = np.sort(code[several])
        if len(own):  # an anchor that recurs within one shard alone
            recurs |= own[np.minimum(np.searchsorted(own, code), len(own) - 1)] == code
        return S.message_table([{"bucket": r["bucket"], "shard": r["shard"], "a": K.bits(recurs[i:j])} for r, i, j in zip(rows, limits, limits[1:])])

    def send_slices(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = K.Texts(table)
        first, end, code = slices(texts.bytes, texts.at, length)
        known = np.unique(code)
        order = np.argsort(route(known), kind="stable")
        limits = np.searchsorted(route(known)[order], np.arange(buckets + 1))
        live = np.zeros(len(known), dtype=bool)
        for r in S.rows_of(answers):
            part = order[limits[r["bucket"]] : limits[r["bucket"] + 1]]
            live[part] = K.unbits(r["a"], len(part))
        pick = live[np.searchsorted(known, code)] if len(code) else np.zeros(0, bool)
        first, end, code = first[pick], end[pick], code[pick]
        size = end - first + length - 1
        same = K.slices_hash(texts.bytes, first, end + length - 1)
        order = np.lexsort((first, same, code))
        lead = np.ones(len(order), dtype=bool)
        a, b = order[1:], order[:-1]
        lead[1:] = (code[a] != code[b]) | (same[a] != same[b]) | (size[a] != size[b])
        _split_unequal(texts.bytes, first, size, order, lead)
        sent = np.zeros(len(first), dtype=bool)
        sent[order[lead]] = True
        shard = table.column("shard")[0].as_py()
        out = [{"bucket": shard % buckets, "shard": shard, "a": K.planes(first.astype(np.int64)), "b": K.planes((end - first).astype(np.int32)), "c": K.bits(sent), "d": K.planes(route(code).astype(np.int32))}]
        kept = np.flatnonzero(sent)
        to = route(code[kept]).astype(np.int64)
        order = np.argsort(to, kind="stable")
        kept = kept[order]
        limits = np.searchsorted(to[order], np.arange(buckets + 1))
        text = np.searchsorted(texts.at, first, side="right") - 1
        for b, (i, j) in enumerate(zip(limits, limits[1:])):
            if j > i:
                p = kept[i:j]
                place = (texts.copy[text[p]] << 40) | (first[p] - texts.at[text[p]])
                head = np.stack((code[p].view(np.int64), same[p].view(np.int64), texts.id[text[p]], place, size[p]))
                out.append({"bucket": b, "shard": shard, "a": b"".join(K.planes(x) for x in head), "b": texts.bytes[ragged(first[p], size[p])].tobytes()})
        return S.message_table(out)

    def answer_slices(table: pa.Table) -> pa.Table:
        rows = list(S.rows_of(table))
        out = [{"bucket": -1, "shard": r["shard"], "a": r["a"], "b": r["b"], "c": r["c"], "d": r["d"]} for r in rows if r["d"] is not None]
        rows = [r for r in rows if r["d"] is None]
        if rows:
            counts = [len(r["a"]) // 40 for r in rows]
            heads = np.concatenate([np.stack([K.unplanes(r["a"][k * 8 * n : (k + 1) * 8 * n], np.int64) for k in range(5)]) for r, n in zip(rows, counts)], axis=1)
            text = np.concatenate([np.frombuffer(r["b"], np.uint8) for r in rows])
            repeated = merge_slices(heads, text, length)
            limits = np.cumsum([0, *counts])
            windows = np.concatenate(([0], np.cumsum(heads[4] - length + 1)))
            out += [{"bucket": r["bucket"], "shard": r["shard"], "a": K.bits(repeated[windows[i] : windows[j]])} for r, i, j in zip(rows, limits, limits[1:])]
        return S.message_table(out)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = K.Texts(table)
        n = len(texts.bytes)
        edge = np.zeros(n + 1, dtype=np.int32)
        replies = list(S.rows_of(answers))
        for own in (r for r in replies if r["bucket"] == -1):
            first, size, to = K.unplanes(own["a"], np.int64), K.unplanes(own["b"], np.int32).astype(np.int64), K.unplanes(own["d"], np.int32)
            sent = K.unbits(own["c"], len(first))
            np.add.at(edge, first[~sent], 1)
            np.add.at(edge, first[~sent] + size[~sent] - 1 + length, -1)
            by = np.flatnonzero(sent)
            by = by[np.argsort(to[by], kind="stable")]
            limits = np.searchsorted(to[by], np.arange(buckets + 1))
            for r in (r for r in replies if r["bucket"] >= 0):
                p = by[limits[r["bucket"]] : limits[r["bucket"] + 1]]
                where = ragged(first[p], size[p])
                where = where[K.unbits(r["a"], len(where))]
                edge[where] += 1  # windows of different slices never start at one place
                np.add.at(edge, where + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        rise = gone.copy()
        rise[1:] &= ~gone[:-1]
        inner = texts.at[:-1][texts.at[:-1] < n]
        rise[inner] = gone[inner]
        sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[texts.at])
        removed = sums(gone)
        kept, kept_at = texts.bytes[~gone], texts.at - np.concatenate(([0], np.cumsum(removed)))
        out = {
            "doc_id": texts.ids(),
            "n_bytes": pa.array(np.diff(texts.at)),
            "n_removed": pa.array(removed),
            "n_spans": pa.array(sums(rise)),
            "kept_sha256": pa.array([hashlib.sha256(kept[i:j]).hexdigest() for i, j in zip(kept_at, kept_at[1:])], pa.string()),
        }
        if with_text:
            out["kept"] = pa.array([kept[i:j].tobytes() for i, j in zip(kept_at, kept_at[1:])], pa.binary())
        return pa.table(out)

    asked = S.at_buckets(dealt, S.from_shards(dealt, send_anchors), answer_anchors)
    met = S.at_buckets(dealt, S.with_answers(dealt, asked, send_slices), answer_slices)
    return S.with_answers(dealt, met, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def _split_unequal(text: np.ndarray, first: np.ndarray, size: np.ndarray, order: np.ndarray, lead: np.ndarray) -> None:
    """Slices that follow a lead of equal hash and size but hold other bytes become leads themselves."""
    copy = np.flatnonzero(~lead)
    if len(copy):
        of = np.maximum.accumulate(np.where(lead, np.arange(len(lead)), 0))[copy]
        lead[copy[~K.same_bytes(text, first[order[copy]], first[order[of]], size[order[copy]])]] = True


def merge_slices(heads: np.ndarray, text: np.ndarray, length: int, array_bytes: int = ARRAY_BYTES) -> np.ndarray:
    """Which windows of the slices have an equal one in a slice that comes before, by (id, place).

    ``heads`` has anchor, hash, id, place and size of each slice; their texts follow one another in ``text``.
    """
    code, same, owner, place, size = heads
    at = np.concatenate(([0], np.cumsum(size)))
    windows = size - length + 1
    first_window = np.concatenate(([0], np.cumsum(windows)))
    out = np.zeros(first_window[-1], dtype=bool)
    order = np.lexsort((place, owner, size, same, code))
    a, b = order[1:], order[:-1]
    lead = np.ones(len(order), dtype=bool)
    lead[1:] = (code[a] != code[b]) | (same[a] != same[b]) | (size[a] != size[b])
    _split_unequal(text, at[:-1], size, order, lead)
    copies = order[~lead]
    out[ragged(first_window[copies], windows[copies])] = True
    leads = order[lead]
    leads = leads[np.lexsort((place[leads], owner[leads], code[leads]))]
    group = K.starts_of(code[leads])
    crowd = np.repeat(np.diff(np.append(group, len(leads))), np.diff(np.append(group, len(leads)))) > 1
    leads = leads[crowd]
    i, before, before_code = 0, np.zeros(0, f"S{length}"), None
    sums = np.concatenate(([0], np.cumsum(size[leads])))
    while i < len(leads):
        j = max(i + 1, int(np.searchsorted(sums, sums[i] + array_bytes, side="right")) - 1)
        part = leads[i:j]
        body = text[ragged(at[part], size[part])]
        part_at = np.concatenate(([0], np.cumsum(size[part])))[:-1]
        starts = ragged(part_at, windows[part])
        target = ragged(first_window[part], windows[part])
        kind = repeat_classes(np.append(body, np.zeros(length, np.uint8)), starts, length, part_at, int(size[part].max()))
        seen = np.sort((kind.astype(np.uint64) << np.uint64(32)) | np.arange(len(kind), dtype=np.uint64))
        head = np.zeros(len(kind), dtype=bool)
        head[(seen[K.starts_of(seen >> np.uint64(32))] & np.uint64((1 << 32) - 1)).astype(np.int64)] = True
        out[target[~head]] = True
        # an anchor that goes on in the next array: its distinct windows, sorted, are searched there
        slice_of = np.repeat(np.arange(len(part)), windows[part])
        if before_code is not None and len(before):
            check = np.flatnonzero(head & (code[part][slice_of] == before_code))
            mine = _strings(body, starts[check], length)
            found = before[np.minimum(np.searchsorted(before, mine), len(before) - 1)] == mine
            out[target[check[found]]] = True
            head[check[found]] = False
        last = code[part[-1]]
        if j < len(leads) and code[leads[j]] == last:
            new = _strings(body, starts[head & (code[part][slice_of] == last)], length)
            before = np.sort(np.concatenate((before, new)) if before_code == last else new)
            before_code = last
        else:
            before, before_code = np.zeros(0, f"S{length}"), None
        i = j
    return out


def _strings(body: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    return body[starts[:, None] + np.arange(length)].reshape(-1).view(f"S{length}") if len(starts) else np.zeros(0, f"S{length}")
