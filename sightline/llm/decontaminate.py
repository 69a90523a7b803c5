"""Benchmark decontamination: one Aho-Corasick automaton over the words of all test items.

The items are normalised into words, every run of ``window`` item words is a pattern (an item
of fewer words is one pattern), and one automaton over word numbers holds them all. Each text
is scanned once; what is hit is mapped back to character offsets of the original text. There
is no shuffle: the automaton's patterns are broadcast behind a check of their size, and every
Python worker builds the automaton once.

Defined results: a null or empty text has no words and no hits; an item without words gives
no pattern; equal windows of several items count for each of them; repeated document rows are
judged one by one; null item ids are left out; extra columns pass through ``scan`` unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.texts import ALNUM_LOWER, alnum_words, fresh, utf8, vacant

WINDOW = 10
#: Most bytes of benchmark text that may be broadcast; a larger set is an error, never cut.
MAX_BENCHMARK_BYTES = 64 << 20

RESULT = (
    "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, "
    "spans array<struct<start:long,end:long>>"
)

_built: dict[int, tuple] = {}


def windows(words: list[bytes], size: int) -> Iterator[tuple[bytes, ...]]:
    if words:
        for i in range(max(1, len(words) - size + 1)):
            yield tuple(words[i : i + size])


class Automaton:
    """Word numbers of the benchmark and the Aho-Corasick automaton over its windows."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            for gram in windows(alnum_words(text), window):
                key = tuple(self.number.setdefault(w, len(self.number) + 1) for w in gram)
                found.setdefault(key, set()).add(item_id)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, ids in found.items():
            self.machine.add_word(key, (len(key), frozenset(ids)))
        self.empty = not found
        if found:
            self.machine.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[bytearray, set[str]]:
        """A mark per word inside a window, and the items whose windows occur."""
        number = self.number.get
        sequence = tuple([number(w, 0) for w in words])
        mask, ids = bytearray(len(words)), set()
        if not self.empty and any(sequence):
            for last, (length, owners) in self.machine.iter(sequence):
                mask[last - length + 1 : last + 1] = b"\1" * length
                ids |= owners
        return mask, ids


def _spans(text: bytes, mask: bytearray) -> list[dict]:
    """Character offsets of the maximal runs of marked words."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(ALNUM_LOWER))]
    runs = [(at[m.start()][0], at[m.end() - 1][1]) for m in re.finditer(rb"\x01+", bytes(mask))]
    out, byte, chars = [], 0, 0
    for start, end in runs:
        chars += len(text[byte:start].decode())
        length = len(text[start:end].decode())
        out.append({"start": chars, "end": chars + length})
        byte, chars = end, chars + length
    return out


def _automaton(patterns: tuple) -> Automaton:
    """The automaton of these broadcast patterns, built once in a worker."""
    if id(patterns) not in _built:
        _built.clear()
        _built[id(patterns)] = (patterns, Automaton(*patterns))
    return _built[id(patterns)][1]


def _judge(text: bytes | None, automaton: Automaton) -> tuple:
    words = alnum_words(text) if text else []
    mask, ids = automaton.hits(words)
    hit, names = mask.count(1), sorted(ids)
    digest = hashlib.sha256(",".join(names).encode()).hexdigest()
    return len(words), hit, len(names), names, digest, _spans(text, mask) if hit else []


def benchmark_items(benchmark: DataFrame, item_id: str, text: str) -> list[tuple[str, bytes]]:
    """The items, brought to the driver only after Spark has added up their size."""
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), utf8(text).alias("t"))
    items = items.where("i is not null and t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if size > MAX_BENCHMARK_BYTES:
        raise ValueError(f"{size} bytes of benchmark text, {MAX_BENCHMARK_BYTES} can be broadcast")
    return [(r.i, bytes(r.t)) for r in items.toLocalIterator()]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    result: str = "contamination",
) -> DataFrame:
    """Every row of ``docs`` with a struct column of ``RESULT``: counts, items and spans."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (benchmark_items(benchmark, item_id, item_text), window)
    )

    @F.pandas_udf(RESULT)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(shared.value)
        names = ["n_words", "n_hit", "n_items", "items", "items_sha256", "spans"]
        for batch in batches:
            yield pd.DataFrame([_judge(t, automaton) for t in batch], columns=names)

    # Marked as not deterministic so that filters on the result do not run it twice.
    return docs.withColumn(vacant(docs.columns, result), judged.asNondeterministic()(utf8(text)))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, columns as given."""
    name = fresh(docs.columns, "contamination")
    return scan(docs, benchmark, result=name, **options).where(F.col(name)["n_hit"] == 0).drop(name)
