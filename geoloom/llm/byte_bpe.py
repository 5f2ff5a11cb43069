"""Byte-level BPE encoding and decoding as column functions over the tiktoken library and a local rank file.

Each match of the vocabulary's pattern is merged on its own, so a text may be cut wherever a match must end and encoded
piece by piece. Long texts are cut at such places, about ``PIECE`` characters apart, before the library sees them: its
memory then follows the piece and not the text. A long run of blanks is one match (less its last blank, if something
follows) and goes to the merger directly, since the library's pattern machine gives up at a million of them.

The rank file is a parameter. It is sent to the executors by Spark (its size is that of the vocabulary), so they need no
folder of the driver's. No special tokens are known; their strings are ordinary text.

Defined results: a null text is empty and has no ids; bytes that are no UTF-8 become U+FFFD before they are encoded; rows
that share a text or an id stay rows; an empty table yields no rows; a text of any length that a row can hold is
encoded whole, and so are runs of one letter, sign or blank of any length; a null list of ids decodes to null, an id that
the file does not have is an error. As column functions they touch no other column, whatever its name.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.store import ship_package

#: Characters after which the next safe place ends a piece.
PIECE = 1 << 16
#: From how many blanks on a run is taken out of the text.
BLANKS = 4096
#: Bytes of ids or of text after which a worker hands on what it has of a batch.
SLICE = 4 << 20
#: Rows that it hands on when it decodes.
ROWS = 500

#: A match of the pattern never goes on past these places, in any version of Unicode's tables: a blank after a sign that is
#: none, the last of several blanks, and changes between letters, digits and other signs of ASCII. Contractions start with
#: an apostrophe, so a letter after one is no such place.
_SAFE = regex.compile(
    r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=\p{White_Space})(?=\p{White_Space}\P{White_Space})"
    r"|(?<=[A-Za-z])(?=[!-@\[-`{-~])|(?<=[0-9])(?=[A-Za-z!-/:-@\[-`{-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[A-Za-z0-9])"
)
_RUN = regex.compile(r"\p{White_Space}{%d,}" % BLANKS)


@dataclass(frozen=True)
class Vocabulary:
    """A rank file that Spark has sent to the executors, and the pattern of its matches."""

    file: str
    pattern: str


def vocabulary(spark: SparkSession, path: str, pattern: str) -> Vocabulary:
    ship_package(spark)
    spark.sparkContext.addFile(path)
    return Vocabulary(os.path.basename(path), pattern)


def ranks_of(path: str) -> dict[bytes, int]:
    """A line a token: its bytes in base64, a blank, its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@functools.cache
def encoding(file: str, pattern: str):
    """One encoder a worker process."""
    import tiktoken

    return tiktoken.Encoding(file, pat_str=pattern, mergeable_ranks=ranks_of(SparkFiles.get(file)), special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[tuple[str, bool]]:
    """``text`` cut at safe places; true where a piece is a run of blanks and so one match."""
    at = 0

    def cut(end: int) -> Iterator[tuple[str, bool]]:
        nonlocal at
        while end - at > size:
            m = _SAFE.search(text, at + size, end)
            stop = m.start() if m else end
            yield text[at:stop], False
            at = stop
        if at < end:
            yield text[at:end], False
        at = end

    if len(text) > size:
        for run in _RUN.finditer(text):
            yield from cut(run.start())
            at = run.end() if run.end() == len(text) else run.end() - 1
            yield text[run.start() : at], True
    yield from cut(len(text))


def ids_of(coder, text: str, size: int = PIECE) -> list[int]:
    if len(text) <= min(size, BLANKS):
        return coder.encode_ordinary(text)
    out: list[int] = []
    for piece, blank in pieces(text, size):
        out += coder._core_bpe.encode_single_piece(piece.encode()) if blank else coder.encode_ordinary(piece)
    return out


def _slices(found: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """What a batch gives, cut into lists of about ``SLICE`` bytes."""
    held, size = [], 0
    for x in found:
        held.append(x)
        size += x.nbytes
        if size >= SLICE:
            yield held
            held, size = [], 0
    yield held


def _joined(held: list[np.ndarray], dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the parts, and the parts in one."""
    return np.cumsum([0, *map(len, held)], dtype=np.int32), np.concatenate([np.empty(0, dtype), *held])


def encode(text: Column, words: Vocabulary, size: int = PIECE) -> Column:
    """array<int>: the ids of each text."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = encoding(words.file, words.pattern)
        for bodies in batches:
            for held in _slices(np.array(ids_of(coder, (b.as_py() or b"").decode(errors="replace"), size), dtype=np.int32) for b in bodies):
                ends, values = _joined(held, np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(values))

    return ids(F.coalesce(text.cast("binary"), F.lit(b"")))


def decode(ids: Column, words: Vocabulary) -> Column:
    """binary: the bytes of each list of ids. Bytes and not text, since an id can be part of a character."""

    @F.arrow_udf("binary")
    def body(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = encoding(words.file, words.pattern)
        for lists in batches:
            known = lists.is_valid().to_numpy(zero_copy_only=False)
            for at in range(0, len(lists), ROWS):
                yield pa.array([coder.decode_bytes(lists[i].as_py()) if known[i] else None for i in range(at, min(at + ROWS, len(lists)))], pa.binary())

    return body(ids)
