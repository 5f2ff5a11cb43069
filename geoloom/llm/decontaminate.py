"""Benchmark decontamination by template windows.

Words of documents and benchmark items become templates: numbers, names and
units turn into typed placeholders, the rest into lower case without outer
punctuation. Windows of template words are hashed and hash-joined. Matches that
lie on one diagonal give an item's coverage; the words behind the placeholders
tell an exact copy from a question with other parameters: each of the item's
values must stand for one value of the document and the reverse. An item counts
if half of its windows match, or a run of ``RUN`` windows on one diagonal (13
words in a row), which finds partial quotes of long items.

Windows of the documents pass a bitmap of fixed size first, which is set from
the benchmark's windows, so only likely matches become rows; if a benchmark
outgrows it, more rows pass and the join still decides. A window that many items
share pairs with each of them.

Defined results: null or empty texts match nothing; items without words match
nothing; an item shorter than a window is one window; rows that share an id
count as one document; of diagonals with as many hits the consistent one with
most slots counts; a null id yields a null id; a text of any length is read in
one piece; empty tables yield no rows. Ids are numbers, or texts of digits.
Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm import kernels as K
from geoloom.llm.store import ship_package

WINDOW = 6
COVERAGE = 0.5
RUN = 8
#: Slots of the bitmap: at most this many numbers reach the driver, whatever the benchmark's size.
SLOTS = 1 << 20
#: Units of measure that questions use.
UNITS = (
    "mm cm m km in ft yd mi mg g kg lb oz ton tons ml l s sec min h hr hrs day days week weeks month months year years "
    "hour hours minute minutes second seconds meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches "
    "gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon gallons "
    "dollar dollars cent cents euro euros percent % $ € £ °c °f degrees mph kmh kph hz khz mhz w kw v a j kj n pa kpa"
).split()


def _hash(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    at = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    return K.slices_hash(np.frombuffer(b"".join(raw), np.uint8), at[:-1], at[1:])


NUMBER, NAME, UNIT = (np.uint64(x) for x in K.splitmix(np.array([901, 902, 903], dtype=np.uint64)))
_UNIT_HASH = np.sort(_hash(UNITS))
_EDGE = np.zeros(256, dtype=bool)
_EDGE[[*b".,;:!?\"'()[]{}"]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[*b".!?:"]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[[*b"0123456789"]] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[[*b".,/-+%$"]] = True


class Templates(K.Words):
    """Words of some texts with their template hashes, raw hashes and placeholder kinds (0: literal)."""

    def __init__(self, texts: K.Texts):
        super().__init__(texts, lower=True)
        b = texts.bytes
        start, end = self.start.copy(), self.end.copy()
        for _ in range(3):  # outer punctuation, three deep
            start += (end - start > 1) & _EDGE[b[start]]
            end -= (end - start > 1) & _EDGE[b[end - 1]]
        raw = K.slices_hash(K.fold_latin1(self.folded), start, end) if len(start) else self.hash
        digits = np.concatenate(([0], np.cumsum(_DIGIT[b], dtype=np.int32)))
        numeric = np.concatenate(([0], np.cumsum(_NUMERIC[b], dtype=np.int32)))
        number = (digits[end] > digits[start]) & (numeric[end] - numeric[start] == end - start)
        unit = _UNIT_HASH[np.minimum(np.searchsorted(_UNIT_HASH, raw), len(_UNIT_HASH) - 1)] == raw
        unit[1:] &= number[:-1] & (self.place[1:] > 0)  # a unit follows its number
        unit[:1] = False
        first = b[start] if len(start) else np.zeros(0, np.uint8)
        second = b[np.minimum(start + 1, max(len(b) - 1, 0))] if len(start) else first
        upper = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        opens = np.ones(len(start), dtype=bool)  # first of a text, a line or a sentence
        if len(start) > 1:
            lines = np.concatenate(([0], np.cumsum(b == 10, dtype=np.int32)))
            opens[1:] = _STOP[b[self.end[:-1] - 1]] | (lines[self.start[1:]] > lines[self.end[:-1]]) | (self.place[1:] == 0)
        name = upper & ~opens & ~number
        self.kind = np.where(number, 1, np.where(unit, 3, np.where(name, 2, 0))).astype(np.int8)
        self.raw = raw
        self.spelt = np.where(number, NUMBER, np.where(unit, UNIT, raw))
        self.hash = np.where(name, NAME, self.spelt)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of a size start, and their hashes; twice where names are in them."""
        where = np.flatnonzero(self.whole(size))
        names = np.concatenate(([0], np.cumsum(self.kind == 2)))
        named = where[names[where + size] > names[where]]
        return np.concatenate((where, named)), np.concatenate((K.word_grams(self.hash, size, where), K.word_grams(self.spelt, size, named))) ^ np.uint64(size)

    def slots(self, at: int, size: int, every: bool) -> list[int]:
        """Raw hashes of a window's words; unless ``every``, 0 for literals."""
        raw = self.raw[at : at + size].view(np.int64)
        return (raw if every else np.where(self.kind[at : at + size] > 0, raw, 0)).tolist()


def _windows(rows: DataFrame, sizes: list[int], bitmap: np.ndarray | None, name: str) -> DataFrame:
    """(id, place, size, window, slots) of each window; with a bitmap, of those that it may have."""

    def work(batches):
        for batch in batches:
            for texts in K.pieces(batch):
                words = Templates(texts)
                for size in sizes:
                    where, h = words.windows(size)
                    if bitmap is not None:
                        passed = (bitmap[(h % np.uint64(SLOTS) >> np.uint64(3)).astype(np.int64)] >> (h % np.uint64(8)).astype(np.uint8)) & 1
                        where, h = where[passed > 0], h[passed > 0]
                    text = words.text[where]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(texts.id[text], mask=texts.null[text]),
                            pa.array(words.place[where].astype(np.int32)),
                            pa.array(words.per_text[text].astype(np.int32)),
                            pa.array(h.view(np.int64)),
                            pa.array([words.slots(a, size, bitmap is not None) for a in where], pa.list_(pa.int64())),
                        ],
                        names=[name, "place", "n_words", "window", "slots"],
                    )

    return rows.mapInArrow(work, f"{name} long, place int, n_words int, window long, slots array<long>")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs (doc_id, item_id) with coverage, slots, changed slots and kind ('exact' or 'reparameterised')."""
    ship_package(docs.sparkSession)
    body = lambda c: F.coalesce(F.col(c), F.lit("")).cast("binary").alias("body")
    items = benchmark.select(F.col(item_col).cast("long").alias("doc_id"), body(item_text_col))
    lengths = F.least(F.size(F.filter(F.split(F.col(item_text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(window))
    sizes = sorted(r[0] for r in benchmark.where(F.col(item_text_col).isNotNull()).select(lengths).distinct().collect() if r[0] > 0)  # at most ``window`` numbers
    wanted = _windows(items, sizes or [window], None, "item_id").where(F.expr(f"size(slots) = least(n_words, {window})"))
    slots = [r[0] for r in wanted.select(F.pmod("window", F.lit(SLOTS))).distinct().collect()]  # at most SLOTS numbers
    bitmap = np.zeros(SLOTS // 8, dtype=np.uint8)
    np.bitwise_or.at(bitmap, np.array(slots, dtype=np.int64) >> 3, np.uint8(1) << (np.array(slots, dtype=np.int64) & 7).astype(np.uint8))
    probes = _windows(docs.select(F.col(id_col).cast("long").alias("doc_id"), body(text_col)), sizes or [window], bitmap, "doc_id")
    pairs = probes.select("doc_id", F.col("place").alias("at"), "window", F.col("slots").alias("found")).join(wanted.select("item_id", "place", "n_words", "window", "slots"), "window")
    diagonal = pairs.withColumn("diagonal", F.col("at") - F.col("place"))
    # placeholders of the item by their places: what they held there and what they hold here
    held = F.filter(F.transform(F.sequence(F.lit(0), F.size("slots") - 1), lambda k: F.struct((F.col("place") + k).alias("p"), F.element_at("slots", k + 1).alias("x"), F.element_at("found", k + 1).alias("y"))), lambda s: s["x"] != 0)
    by_line = diagonal.groupBy("doc_id", "item_id", "diagonal").agg(F.collect_set("place").alias("places"), F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_set(held))).alias("held"))
    xs = F.size(F.array_distinct(F.transform("held", lambda s: s["x"])))
    ys = F.size(F.array_distinct(F.transform("held", lambda s: s["y"])))
    both = F.size(F.array_distinct(F.transform("held", lambda s: F.struct(s["x"], s["y"]))))
    longest = F.aggregate(
        F.array_sort("places"),
        F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best")),
        lambda a, p: F.struct(p.alias("last"), F.when(p == a["last"] + 1, a["run"] + 1).otherwise(1).alias("run"), F.greatest(a["best"], F.when(p == a["last"] + 1, a["run"] + 1).otherwise(1)).alias("best")),
    )["best"]
    by_line = by_line.select("*", longest.alias("run"), F.size("places").alias("hits"), F.size("held").alias("slots"), F.size(F.filter("held", lambda s: s["x"] != s["y"])).alias("changed"), ((xs == both) & (ys == both)).alias("consistent"))
    best = F.max(F.struct("hits", "consistent", "slots", "changed"))
    per_item = by_line.groupBy("doc_id", "item_id").agg(best.alias("best"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("matched"), F.max("n_words").alias("n_words"), F.max(F.when(F.col("consistent"), F.col("run"))).alias("run"))
    share = F.col("matched") / F.greatest(F.lit(1), F.col("n_words") - window + 1)
    return per_item.select(
        "doc_id", "item_id", F.col("matched").cast("long").alias("windows"), share.alias("coverage"),
        F.col("best.slots").alias("slots"), F.col("best.changed").alias("changed"),
        F.when(F.col("best.changed") == 0, "exact").otherwise("reparameterised").alias("kind"),
        F.col("best.consistent").alias("consistent"), "run",
    ).where(((F.col("coverage") >= coverage) & F.col("consistent")) | (F.col("run") >= run)).drop("consistent", "run")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without those that hold a benchmark item."""
    bad = contaminated(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__id"]), "left_anti")
