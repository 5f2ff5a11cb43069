"""Vector codes: each part of a vector is named by the nearest of a few entries, found by Lloyd's rounds with resident members.

Parts live with their owner, the partition of (position, entry, salt). A round hands the codebooks (a few hundred numbers,
whatever the input) to the owners; an owner compares its members, sums those that stay, and gives away only the parts whose
nearest entry has changed. Those, and one row of sums an entry and owner, are all that the next shuffle moves; owners then
update the entries from the sums of their residents and their arrivals. Members that stay are neither moved nor written
again: every round's arrivals are a table of their own, and a row of an earlier table counts for as long as no later
codebook has called it away, which its owner works out from the codebooks so far. Tables lie in the shared folder, so a
lost executor costs its tasks and no round. The salt spreads an entry that owns most of all parts over many owners.

All numbers are integers: a component x is floor(4096 x), means are rounded down, ties go to the lower entry.

Defined results: rows whose vector is null or empty, or holds a null or a number that is not finite, are left out, and so
are vectors of another length than most (the longer of equally common ones); components beyond a limit of 2^27 (for up to
128 components; sums of squares then fit 64 bits) count as that limit; a length that the parts do not divide is cut as
evenly as can be; the first codebook follows the least ids, null ids last, rows of one id by their components; with fewer
rows than entries there are as many entries as rows; rows that share an id stay rows; a sum of errors beyond 63 bits
counts as the largest number; an empty table yields no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.store import ship_package, written

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Parts for which an owner is planned, and how many owners there are at most; owners read their members in batches.
MEMBERS, OWNERS_MOST = 1 << 15, 100_000
#: Salts an owner, so that the owners of one large entry have about as much each.
SALTS = 8
#: Bytes of numbers that a batch of distances takes.
DISTANCES = 32 << 20

#: A part (n is 0, body its components) or the sums of n parts of an entry (row is null).
STATE = "p int, entry int, salt int, row long, n long, body binary"
_STATE = pa.schema([("p", pa.int32()), ("entry", pa.int32()), ("salt", pa.int32()), ("row", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
_CODE = pa.schema([("row", pa.int64()), ("p", pa.int32()), ("entry", pa.int32()), ("err", pa.int64())])

#: One array (entries, width) for each position.
Codebooks = list[np.ndarray]


@dataclass(frozen=True)
class Codes:
    """rows: id, label, entries (array<int>, by position), error; codebooks: the last; moved: parts that changed entry, by round."""

    rows: DataFrame
    codebooks: Codebooks
    moved: list[int]


def limit_of(length: int) -> int:
    """The largest component for which a sum of squared differences over a vector of this length fits 63 bits."""
    return 1 << min(27, (61 - max(1, length - 1).bit_length()) // 2)


def bounds_of(length: int, parts: int) -> list[int]:
    return [p * length // parts for p in range(parts + 1)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the nearest entry (the lowest of equally near ones) and its squared distance."""
    step = max(1, DISTANCES // (8 * max(1, book.size)))
    entry, least = np.empty(len(x), np.int32), np.empty(len(x), np.int64)
    for i in range(0, len(x), step):
        d = x[i : i + step, None, :] - book[None]
        d = np.einsum("nkw,nkw->nk", d, d)
        entry[i : i + step] = d.argmin(1)
        least[i : i + step] = d.min(1)
    return entry, least


def _parts(batch: pa.RecordBatch, dtype: type) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, rows of the batch, their numbers)."""
    p = batch["p"].to_numpy(zero_copy_only=False)
    for k in np.unique(p):
        at = np.flatnonzero(p == k)
        body = b"".join(batch["body"].take(pa.array(at)).to_pylist())
        yield int(k), at, np.frombuffer(body, dtype).reshape(len(at), -1).astype(np.int64)


def _state(p: int, entry: np.ndarray, row: np.ndarray | None, n: np.ndarray, numbers: np.ndarray, salts: int) -> pa.RecordBatch:
    numbers = np.ascontiguousarray(numbers)
    width = numbers.shape[1] * numbers.itemsize
    ends = np.arange(len(entry) + 1, dtype=np.int32) * width
    body = pa.Array.from_buffers(pa.binary(), len(entry), [None, pa.py_buffer(ends), pa.py_buffer(numbers)])
    salt = np.zeros(len(entry)) if row is None else row % salts
    columns = [pa.array(np.full(len(entry), p, np.int32)), pa.array(entry.astype(np.int32)), pa.array(salt.astype(np.int32)), pa.nulls(len(entry), pa.int64()) if row is None else pa.array(row), pa.array(n.astype(np.int64)), body]
    return pa.RecordBatch.from_arrays(columns, schema=_STATE)


class _Sums:
    """Of the members of each entry."""

    def __init__(self, books: Codebooks):
        self.sums = [np.zeros(b.shape, np.int64) for b in books]
        self.n = [np.zeros(len(b), np.int64) for b in books]

    def add(self, p: int, entry: np.ndarray, x: np.ndarray, n: np.ndarray | int = 1) -> None:
        np.add.at(self.sums[p], entry, x)
        np.add.at(self.n[p], entry, n)

    def rows(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for p, n in enumerate(self.n):
            if len(e := np.flatnonzero(n)):
                yield p, e, n[e], self.sums[p][e]


def _first_parts(books: Codebooks, bounds: list[int], salts: int) -> Callable:
    """Every vector's parts, with their nearest entry: the one shuffle that moves them all."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, x = batch["row"].to_numpy(), batch["comps"].values.to_numpy().reshape(batch.num_rows, -1)
                for p, book in enumerate(books):
                    part = np.ascontiguousarray(x[:, bounds[p] : bounds[p + 1]])
                    yield _state(p, nearest(part.astype(np.int64), book)[0], row, np.zeros(len(row)), part, salts)

    return work


def _current(batch: pa.RecordBatch, history: list[Codebooks]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts that no codebook since their arrival has called away: (position, entry, row, numbers). ``since`` is the round of arrival."""
    is_part = np.flatnonzero(batch["n"].to_numpy() == 0)
    batch = batch.take(pa.array(is_part))
    entry, row, since = (batch[c].to_numpy() for c in ("entry", "row", "since"))
    for p, at, x in _parts(batch, np.int32):
        left = np.arange(len(at))
        for t in range(1, len(history)):
            test = since[at[left]] < t
            keep = np.ones(len(left), bool)
            keep[test] = nearest(x[left[test]], history[t][p])[0] == entry[at[left[test]]]
            left = left[keep]
        yield p, entry[at[left]], row[at[left]], x[left]


def _round(history: list[Codebooks], books: Codebooks, salts: int) -> Callable:
    """What an owner gives away under ``books``, and the sums of what stays."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stay = _Sums(books)
        for batch in batches:
            for p, entry, row, x in _current(batch, history):
                new = nearest(x, books[p])[0]
                same = new == entry
                stay.add(p, entry[same], x[same])
                if not same.all():
                    yield _state(p, new[~same], row[~same], np.zeros((~same).sum()), x[~same].astype(np.int32), salts)
        for p, entry, n, sums in stay.rows():
            yield _state(p, entry, None, n, sums, salts)

    return work


def _owned_sums(books: Codebooks) -> Callable:
    """An owner's sums: those of its residents and of its arrivals."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Sums(books)
        for batch in batches:
            n, entry = batch["n"].to_numpy(), batch["entry"].to_numpy()
            for at, dtype in ((np.flatnonzero(n == 0), np.int32), (np.flatnonzero(n > 0), np.int64)):
                rows = batch.take(pa.array(at))
                for p, k, x in _parts(rows, dtype):
                    own.add(p, entry[at[k]], x, 1 if dtype is np.int32 else n[at[k]])
        for p, entry, n, sums in own.rows():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), p, np.int32)), pa.array(entry.astype(np.int32)), pa.array(n), pa.array(sums.tolist(), pa.list_(pa.int64()))], names=["p", "entry", "n", "sums"])

    return work


def _updated(arrivals: DataFrame, books: Codebooks) -> Codebooks:
    """Means of each entry's members, rounded down; what has none stays. A row an entry comes to the driver."""
    owned = arrivals.mapInArrow(_owned_sums(books), "p int, entry int, n long, sums array<long>")
    at = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")) for i in range(max(b.shape[1] for b in books))]
    new = [b.copy() for b in books]
    for r in owned.groupBy("p", "entry").agg(F.sum("n").alias("n"), F.array(*at).alias("sums")).collect():
        new[r.p][r.entry] = [int(s) // r.n for s in r.sums[: new[r.p].shape[1]]]
    return new


def _final(history: list[Codebooks], books: Codebooks) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, _, row, x in _current(batch, history):
                entry, err = nearest(x, books[p])
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.full(len(row), p, np.int32)), pa.array(entry), pa.array(err)], schema=_CODE)

    return work


def _integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int]:
    """Kept rows (row, id, label, comps), written; and the length of their vectors."""
    v = F.col(vector_col).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v")).where((F.size("v") > 0) & ~odd)
    lengths = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = lengths.n if lengths else 0
    most = float(limit_of(length))
    comps = F.transform("v", lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), x * SCALE))).cast("int"))
    return written(kept.where(F.size("v") == length).select(F.monotonically_increasing_id().alias("row"), "id", "label", comps.alias("comps"))), length


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, members: int = MEMBERS) -> Codes:
    """Codebooks by ``rounds`` of Lloyd's method for each of ``parts`` positions, and every kept row's entries under the last."""
    spark = vectors.sparkSession
    ship_package(spark)
    base, length = _integers(vectors, id_col, vector_col, label_col)
    bounds = bounds_of(length, parts)
    first = [r.comps for r in base.orderBy(F.col("id").asc_nulls_last(), "comps").select("id", "comps").limit(entries).collect()]
    books: Codebooks = [np.array([c[bounds[p] : bounds[p + 1]] for c in first], np.int64).reshape(len(first), bounds[p + 1] - bounds[p]) for p in range(parts)]
    if not first:
        none = base.select("id", "label", F.array().cast("array<int>").alias("entries"), F.lit(0).cast("long").alias("error"))
        return Codes(none, books, [])
    owners = min(OWNERS_MOST, max(spark.sparkContext.defaultParallelism, -(-base.count() * parts // members)))
    salts = SALTS * owners
    settle = lambda df: written(df.repartition(owners, "p", "entry", "salt"))
    tables = [settle(base.select("row", "comps").mapInArrow(_first_parts(books, bounds, salts), STATE))]
    history, moved = [books], []
    here = lambda: _union([t.withColumn("since", F.lit(k)) for k, t in enumerate(tables)])
    for _ in range(1, rounds):
        books = _updated(tables[-1], books)
        tables.append(settle(here().mapInArrow(_round(history, books, salts), STATE)))
        history.append(books)
        moved.append(tables[-1].where("n = 0").count())
    books = _updated(tables[-1], books) if rounds else books
    final = here().mapInArrow(_final(history, books), "row long, p int, entry int, err long")
    each = [F.max(F.when(F.col("p") == p, F.col("entry"))) for p in range(parts)]
    codes = final.groupBy("row").agg(F.array(*each).alias("entries"), F.sum("err").alias("error"))
    return Codes(base.select("row", "id", "label").join(codes, "row").drop("row"), books, moved)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def codebooks_sha256(books: Codebooks) -> str:
    """Of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.reshape(-1)).encode()).hexdigest()


def with_label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` with the error summed over equal labels; null labels are equal."""
    rows = written(rows)
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    total = rows.groupBy(F.col("label").alias("__label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    return rows.join(total, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
