"""Byte-level BPE: texts to token ids and back, with the tiktoken library and a local rank file.

The library splits a text by a pattern and merges inside each match. Its pattern matcher overflows
its stack on white space of some hundred thousand characters, and a very long text would be one long
call, so long texts are cut before it sees them, only where a match ends for certain:

* between an ASCII character that is no space and an ASCII space. White space stands in a match
  either first or alone, so no match runs over that place, and the only look-ahead of the pattern
  looks from white space;
* around white space of ``RUN`` characters and more: it is one match up to its last character, which
  may belong to the next word (at the end of the text the match holds all of it). Such a match goes
  straight to the merges.

Both follow from ``PATTERN``, so another pattern needs another ``cuts``.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts above this many characters are cut.
CHUNK = 1 << 14
#: White space of this many characters is merged without the pattern.
RUN = 1 << 12
#: Rows that a worker handles at a time.
ROWS = 1024

#: Unicode's White_Space property: the space of the pattern. Fixed values.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_SPACE = re.compile(f"[{SPACE}]{{{RUN},}}")
_CUT = re.compile(r"(?<=[!-~])(?=[\t-\r ])")


def load_ranks(raw: bytes) -> dict[bytes, int]:
    """The table in a rank file: on each line a token's bytes in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def read_rank_file(path: str) -> bytes:
    """The file's bytes. It lies where the driver runs; workers get it by broadcast (about 1 MB)."""
    with open(path, "rb") as file:
        return file.read()


@functools.lru_cache(maxsize=4)
def encoding(raw: bytes, pattern: str) -> tiktoken.Encoding:
    """The library's coder, made once in each Python worker."""
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(raw), special_tokens={})


def cuts(text: str) -> Iterator[tuple[bool, str]]:
    """The text in parts that can be encoded apart; true marks white space that is one match."""
    if len(text) <= CHUNK:
        yield False, text
        return
    at = 0
    for space in _LONG_SPACE.finditer(text):
        end = space.end() - (space.end() < len(text))
        yield from ((False, part) for part in _chunks(text, at, space.start()))
        yield True, text[space.start() : end]
        at = end
    yield from ((False, part) for part in _chunks(text, at, len(text)))


def _chunks(text: str, at: int, end: int) -> Iterator[str]:
    while end - at > CHUNK and (cut := _CUT.search(text, at + CHUNK, end)):
        yield text[at : cut.start()]
        at = cut.start()
    if at < end:
        yield text[at:end]


def encode_text(coder: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of one text, as the library gives them for the text in one piece."""
    if len(text) <= CHUNK:
        return coder.encode_ordinary(text)
    ids: list[int] = []
    for is_space, part in cuts(text):
        ids += coder._encode_single_piece(part.encode()) if is_space else coder.encode_ordinary(part)
    return ids


def _with_column(df: DataFrame, name: str, kind: T.DataType, make) -> DataFrame:
    """``df`` with one more column, made by ``make(batch)`` from each Arrow batch."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {name} already; name another one for the result")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*batch.columns, make(batch)], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with the token ids of ``text`` in the array column ``ids``.

    A null text has no ids, as an empty one has. Bytes that are no UTF-8 count as U+FFFD. Repeated
    rows, nulls in other columns and any further columns pass; a column named ``ids`` is an error.
    """
    held = df.sparkSession.sparkContext.broadcast(ranks)

    def make(batch: pa.RecordBatch) -> pa.Array:
        coder = encoding(held.value, pattern)
        texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        rows = [np.array(encode_text(coder, (t.as_py() or b"").decode(errors="replace")), np.int32) for t in texts]
        ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
        return pa.ListArray.from_arrays(ends, np.concatenate([*rows, np.empty(0, np.int32)]))

    return _with_column(df, ids, T.ArrayType(T.IntegerType()), make)


def decode(df: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", raw: str = "raw") -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for in the binary column ``raw``.

    Bytes, since a token may end inside a character: any slice of ids has bytes, not all have text.
    Null ids give null, an empty array gives no bytes, and an id without a token is an error.
    """
    held = df.sparkSession.sparkContext.broadcast(ranks)

    def make(batch: pa.RecordBatch) -> pa.Array:
        coder = encoding(held.value, pattern)
        rows = batch.column(batch.schema.get_field_index(ids)).to_pylist()
        return pa.array([None if row is None else coder.decode_bytes(row) for row in rows], pa.binary())

    return _with_column(df, raw, T.BinaryType(), make)
