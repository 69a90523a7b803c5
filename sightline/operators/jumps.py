"""Greedy marks along a key: the first time, then every time at least ``gap`` after the last mark.

Each mark depends on the one before, so a plain walk needs a whole key in one task. Here the time
axis is cut into chunks of ``SPAN`` gaps. Inside a chunk every time has a jump pointer to the next
mark that would follow it; doubling the pointers tells for each place where a walk can enter the
chunk at which time it leaves. These transition tables are composed along the key: up to ``FAN``
chunks by one task, more by groups of chunks, groups of groups and so on. Then every chunk knows
where the walk enters it, and all chunks mark their times at once.

A walk enters a chunk less than a gap after the chunk's begin, or at its first time, so a table has
no more entries than a gap has different times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from sightline.session import cut_lineage

#: Gaps in a chunk, and chunks (or groups of them) that one task composes.
SPAN, FAN = 64, 1024
_FIRST = -(1 << 62)


def leaving(times: np.ndarray, gap: int) -> np.ndarray:
    """For a walk at each of the ascending times: when the mark behind the last one is due."""
    ahead = np.searchsorted(times, times + gap)
    at = np.where(ahead < len(times), ahead, np.arange(len(times)))
    while True:
        further = at[at]
        if (further == at).all():
            return times[at] + gap
        at = further


def walk(times: np.ndarray, due: int, gap: int) -> np.ndarray:
    """Places of the marks of a walk whose next mark is due at ``due``."""
    marks, at = [], int(np.searchsorted(times, due))
    while at < len(times):
        marks.append(at)
        at = int(np.searchsorted(times, times[at] + gap))
    return np.array(marks, np.int64)


def follow(entries: np.ndarray, exits: np.ndarray, due: np.ndarray) -> np.ndarray:
    """When marks are due behind a chunk, for walks that come with ``due``; without a time there, as before."""
    at = np.searchsorted(entries, due)
    return np.where(at < len(entries), exits[np.minimum(at, len(entries) - 1)], due)


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of equal ``names`` that follow each other, as one table each."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
        heads = list(zip(*columns))
        starts = [0, *(i for i in range(1, len(heads)) if heads[i] != heads[i - 1]), len(heads)]
        for a, b in zip(starts, starts[1:]):
            if held and heads[a] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = heads[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def _emit(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema.names)


def _streamed(df: DataFrame, keys: list[str], by: list[str], order: list[str], added: list[tuple[str, T.DataType]], make) -> DataFrame:
    """``make(key, table)`` gives rows for each group of ``by``; rows come sorted by ``order``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = [df.schema[k] for k in keys]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), *(T.StructField(n, t) for n, t in added)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for key, table in _groups(batches, by):
            rows.extend(make(key, table))
            if len(rows) > 4096:
                yield _emit(arrow, rows)
                rows = []
        yield _emit(arrow, rows)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


_TABLE = [("_c", T.LongType()), ("_in", T.ArrayType(T.LongType())), ("_out", T.ArrayType(T.LongType()))]
_DUE = [("_c", T.LongType()), ("_due", T.LongType())]


def _children(table: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    rows = zip(table.column("_c").to_pylist(), table.column("_in").to_pylist(), table.column("_out").to_pylist())
    return [(c, np.array(i, np.int64), np.array(o, np.int64)) for c, i, o in rows]


def _composed(tables: DataFrame, keys: list[str]) -> DataFrame:
    """Transition tables of groups of ``FAN`` chunks."""

    def make(key: tuple, table: pa.Table) -> list[tuple]:
        (_, entries, due), *rest = _children(table)
        if rest:
            # A walk that finds no time in the first chunk enters at the first time of the second.
            entries, due = np.r_[entries, rest[0][1][:1]], np.r_[due, rest[0][1][:1]]
        for _, i, o in rest:
            due = follow(i, o, due)
        return [(*key[:-1], key[-1], entries, due)]

    grouped = tables.withColumn("_g", F.floor(F.col("_c") / FAN))
    return cut_lineage(_streamed(grouped, keys, [*keys, "_g"], ["_c"], _TABLE, make))


def _dues(tables: DataFrame, keys: list[str], above: DataFrame | None) -> DataFrame:
    """When the next mark is due at each chunk; ``above`` has that for the groups (none: one group per key)."""
    top = above is None
    rows = tables.withColumn("_g", F.lit(0).cast("long") if top else F.floor(F.col("_c") / FAN)).withColumn("_due", F.lit(None).cast("long"))
    if above is not None:
        heads = above.select(*keys, F.col("_c").alias("_g"), "_due")
        rows = rows.unionByName(heads, allowMissingColumns=True)

    def make(key: tuple, table: pa.Table) -> list[tuple]:
        due = np.array([_FIRST])
        if not top:  # the row without a chunk comes first
            due = np.array([table.column("_due")[0].as_py()])
            table = table.slice(1)
        out = []
        for c, i, o in _children(table):
            out.append((*key[:-1], c, int(due[0])))
            due = follow(i, o, due)
        return out

    return _streamed(rows, keys, [*keys, "_g"], ["_c"], _DUE, make)


def marks(df: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """``keys`` and ``at`` of every mark; rows of equal time are one time. ``at`` is a whole number."""
    if gap < 1:
        raise ValueError("a gap is at least 1")
    span = SPAN * gap
    times = df.where(F.col(at).isNotNull()).select(*keys, F.col(at).cast("long").alias("_at")).withColumn("_c", F.floor(F.col("_at") / span))

    def table(key: tuple, rows: pa.Table) -> list[tuple]:
        x = np.unique(_numbers(rows.column("_at")))
        out = leaving(x, gap)
        n = int(np.searchsorted(x, key[-1] * span + gap)) + 1
        return [(*key[:-1], key[-1], x[:n], out[:n])]

    tables = [cut_lineage(_streamed(times, keys, [*keys, "_c"], ["_at"], _TABLE, table))]
    most = tables[0].groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    while most > FAN:
        tables.append(_composed(tables[-1], keys))
        most = tables[-1].groupBy(*keys).count().agg(F.max("count")).first()[0]
    due = None
    for level in reversed(tables):
        due = _dues(level, keys, due)

    def marked(key: tuple, rows: pa.Table) -> list[tuple]:
        start = rows.column("_due")[0].as_py()
        x = np.unique(_numbers(rows.slice(1).column("_at")))
        return [(*key[:-1], t) for t in x[walk(x, start, gap)].tolist()]

    both = times.unionByName(due, allowMissingColumns=True)
    kind = df.schema[at].dataType
    found = _streamed(both, keys, [*keys, "_c"], ["_at"], [("_at", T.LongType())], marked)
    return found.select(*keys, F.col("_at").cast(kind).alias(at))
