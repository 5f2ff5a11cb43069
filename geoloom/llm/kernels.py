"""Vectorised helpers that run inside tasks, on one shard of texts at a time.

Hashes of slices read eight bytes a step and mix each step before the next
comes in, so no pattern of bytes cancels out; long slices are digested by
BLAKE2. Slices of equal size up to eight bytes never share a hash. Two lanes
with different beginnings make 128 bits where equality is decided by hash
alone. Sorting packs what must travel along into the low bits of the key,
because a plain sort is much faster than an argsort.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE_BYTES = 2 << 20
#: Slices from this size on are digested one by one.
LONG = 512
#: Slices hashed at a time.
SLICES = 1 << 15
NULL_ID = -(1 << 63)


def splitmix(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=U64) + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def finish(x: np.ndarray) -> np.ndarray:
    """Spreads a polynomial's low entropy over all bits; a new array."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xCA5A826395121157)
    x ^= x >> U64(32)
    return x


BYTE = splitmix(np.arange(1, 257, dtype=U64)) | U64(1)
STEP = U64(0x9DDFEA08EB382D69)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_REST = np.array([(1 << 8 * k) - 1 for k in range(8)], dtype=U64)
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


class Texts:
    """The texts of a shard, in the order of (id, text), nulls first, with an ordinal for equal ids; ``row``: their places in the table."""

    def __init__(self, table: pa.Table, with_order: bool = True):
        ids = table.column("doc_id").combine_chunks()
        self.null = np.asarray(ids.is_null())
        key = np.asarray(ids.fill_null(NULL_ID)).astype(np.int64)
        body = table.column("body").combine_chunks()
        self.row = np.arange(len(key))
        if with_order and len(key) > 1:
            order = np.argsort(key, kind="stable")
            same = np.flatnonzero(np.diff(key[order]) == 0)
            if len(same):
                order = np.array(sorted(range(len(key)), key=lambda i: (key[i], body[i].as_py())))
            body = body.take(pa.array(order))
            key, self.null = key[order], self.null[order]
            self.row = order
        self.id = key
        n = len(key)
        new = np.ones(n, dtype=bool)
        new[1:] = key[1:] != key[:-1]
        at = np.arange(n)
        self.copy = at - np.maximum.accumulate(np.where(new, at, 0)) if n else at
        _, offsets, data = body.buffers()
        where = np.frombuffer(offsets, dtype=np.int32)[body.offset : body.offset + n + 1].astype(np.int64)
        self.bytes = np.frombuffer(data, dtype=np.uint8)[where[0] : where[-1]] if data is not None and where[-1] > where[0] else np.zeros(0, np.uint8)
        self.at = where - where[0]

    def __len__(self) -> int:
        return len(self.id)

    def ids(self) -> pa.Array:
        return pa.array(self.id, mask=self.null)


def pieces(batch: pa.RecordBatch, most: int = PIECE_BYTES):
    """Parts of a batch of (doc_id, body) with at most so many bytes of text, or one row."""
    body = batch.column("body")
    sizes = np.diff(np.frombuffer(body.buffers()[1], dtype=np.int32)[body.offset : body.offset + len(body) + 1]) if len(body) else np.zeros(0, int)
    i = 0
    total = np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))
    while i < len(body):
        j = max(i + 1, int(np.searchsorted(total, total[i] + most, side="right")) - 1)
        yield Texts(pa.Table.from_batches([batch.slice(i, j - i)]), with_order=False)
        i = j


def fold_latin1(b: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capitals of Latin-1 in lower case; ASCII is folded by the hash."""
    out = b.copy()
    capital = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
    out[1:][capital] += 0x20
    return out


class Words:
    """Words of a shard: start, end, text number, place in the text, hash."""

    def __init__(self, texts: Texts, lower: bool, between: np.ndarray = SEPARATOR):
        b, at = texts.bytes, texts.at
        word = ~between[b]
        before = np.zeros(len(b), dtype=bool)
        before[1:] = word[:-1]
        inner = at[:-1][at[:-1] < len(b)]
        before[inner] = False
        self.start = np.flatnonzero(word & ~before)
        after = np.zeros(len(b), dtype=bool)
        after[:-1] = word[1:]
        after[inner[inner > 0] - 1] = False
        self.end = np.flatnonzero(word & ~after) + 1
        first = np.searchsorted(self.start, at)
        self.first = first
        self.per_text = np.diff(first)
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), self.per_text)
        self.place = np.arange(len(self.start)) - np.repeat(first[:-1], self.per_text)
        self.folded = FOLD[b] if lower else b
        self.hash = slices_hash(self.folded, self.start, self.end)

    def second(self) -> np.ndarray:
        """The words' hashes in the second lane."""
        return slices_hash(self.folded, self.start, self.end, lane=1)

    def __len__(self) -> int:
        return len(self.start)

    def whole(self, k: int) -> np.ndarray:
        """Where k words from here lie in one text."""
        return self.place + k <= np.repeat(self.per_text, self.per_text)


def slices_hash(b: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hash of each slice, worked in pieces that stay in the cache."""
    out = np.empty(len(start), dtype=U64)
    if not len(start):
        return out
    word = np.ndarray(len(b) + 1, "<u8", np.concatenate((b, np.zeros(8, np.uint8))), strides=(1,))
    for i in range(0, len(start), SLICES):
        out[i : i + SLICES] = _hashed(word, start[i : i + SLICES], end[i : i + SLICES] - start[i : i + SLICES], lane)
    for i in np.flatnonzero(end - start > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(b[start[i] : end[i]].tobytes(), digest_size=8, person=bytes([lane])).digest(), "little")
    return out


def _hashed(word: np.ndarray, at: np.ndarray, left: np.ndarray, lane: int) -> np.ndarray:
    """Hashes of slices of ``left`` bytes from ``at``; ``word`` has the eight bytes from each place."""
    out, live = splitmix(left.astype(U64) + U64(lane << 40)), None  # None: all slices
    while True:
        x = word[at]
        short = np.flatnonzero(left < 8)
        x[short] &= _REST[left[short]]
        if live is None:
            out = finish(out ^ x)
        else:
            out[live] = finish(out[live] ^ x)
        more = np.flatnonzero((left > 8) & (left <= LONG))
        if not len(more):
            return out
        live, at, left = (more if live is None else live[more]), at[more] + 8, left[more] - 8


def word_grams(hashes: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the k words from each place (all places with k words left, or those given)."""
    n = len(hashes) - k + 1
    if at is None and n <= 0:
        return np.zeros(0, dtype=U64)
    pick = (lambda j: hashes[j : j + n]) if at is None else (lambda j: hashes[at + j])
    out = pick(0).copy()
    for j in range(1, k):
        out ^= out >> U64(32)
        out *= STEP
        out += pick(j)
    return finish(out)


def same_bytes(b: np.ndarray, one: np.ndarray, other: np.ndarray, size: np.ndarray, most: int = 4 << 20) -> np.ndarray:
    """Whether slices of equal sizes hold equal bytes; compared in pieces of bounded size."""
    out = np.ones(len(one), dtype=bool)
    sums = np.concatenate(([0], np.cumsum(size)))
    i = 0
    while i < len(one):
        j = max(i + 1, int(np.searchsorted(sums, sums[i] + most, side="right")) - 1)
        step = np.arange(sums[j] - sums[i]) - np.repeat(sums[i:j] - sums[i], size[i:j])
        differ = b[np.repeat(one[i:j], size[i:j]) + step] != b[np.repeat(other[i:j], size[i:j]) + step]
        filled = np.flatnonzero(size[i:j])
        if len(filled):
            out[i + filled] = ~np.logical_or.reduceat(differ, (sums[i:j] - sums[i])[filled])
        i = j
    return out


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys as 16-bit differences; 65535 stands for a step that goes on."""
    if not len(keys):
        return b""
    step = np.diff(keys.astype(np.int64), prepend=0)
    over = step // 65535
    if not over.any():
        return step.astype(np.uint16).tobytes()
    out = np.full(int(len(keys) + over.sum()), 65535, dtype=np.uint16)
    out[np.cumsum(over + 1) - 1] = step - over * 65535
    return out.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    step = np.frombuffer(data, dtype=np.uint16)
    return np.cumsum(step.astype(np.int64))[step != 65535]


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte of equal rank, which Spark's block compression shrinks well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() if len(x) else b""


def unplanes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype) if data else np.zeros(0, dtype)


def bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool) if n else np.zeros(0, bool)


def starts_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where groups of equal neighbours start."""
    if not len(sorted_keys):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def covered(marks: np.ndarray, width: int) -> np.ndarray:
    """Places within ``width`` from a mark on; the marks' windows lie inside their texts."""
    sums = np.cumsum(marks, dtype=np.int32)
    out = sums.copy()
    out[width:] -= sums[:-width]
    return out > 0
