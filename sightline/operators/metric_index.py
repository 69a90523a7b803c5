"""Blocks of vectors that are near each other, and which pairs of blocks can hold a similar pair.

The angle between two vectors is a metric. A few pivots are chosen among the targets; every vector
has an angle to each of them, and two vectors whose angles to one pivot differ by more than the
angle of the similarity floor are less similar than the floor. Vectors are sorted into the cell of
their nearest pivot and by their angle to it, cells are cut into blocks of a bounded size, and a
block keeps the least and the largest angle to every pivot. Pairs of blocks whose ranges lie too
far apart at any pivot are never multiplied. Nothing else is skipped, so results are exact; the
choice of pivots matters for speed only. On vectors without any clusters all angles are much alike
and few pairs are skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

#: Pivots, and the targets (of smallest hash) among which they are chosen.
PIVOTS, SAMPLE = 32, 1024
#: Rings of a cell: vectors of a ring are split by a hash only where a ring outgrows a block.
RINGS = 4096
#: Angles are compared with this tolerance, far above their rounding.
SLACK = 1e-6
_EPS = 1.1920928955078125e-07


def units(values: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Unit vectors by dimension: ``{dim: (row numbers, matrix)}``; unusable rows drop out."""
    sizes = np.fromiter((0 if v is None else len(v) for v in values), dtype=np.int64, count=len(values))
    result = {}
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        matrix = np.stack([np.asarray(values.iloc[r], dtype=np.float64) for r in rows])
        lengths = np.sqrt((matrix * matrix).sum(axis=1))
        ok = np.isfinite(matrix).all(axis=1) & (lengths > _EPS)
        if ok.any():
            result[int(size)] = (rows[ok], matrix[ok] / lengths[ok, None])
    return result


def pivots(targets: DataFrame, ids: list[str], vector: str) -> dict[int, np.ndarray]:
    """By dimension up to ``PIVOTS`` unit vectors that lie far apart, of a bounded sample."""
    drawn = targets.select(vector, F.xxhash64(*ids).alias("_h")).orderBy("_h").limit(SAMPLE)
    sample = pd.Series([r[0] for r in drawn.collect()], dtype=object)
    chosen = {}
    for dim, (_, matrix) in units(sample).items():
        at, nearest = [0], matrix @ matrix[0]
        while len(at) < min(PIVOTS, len(matrix)):
            far = int(nearest.argmin())
            if nearest[far] > 1 - 1e-12:
                break  # only copies of pivots are left
            at.append(far)
            nearest = np.maximum(nearest, matrix @ matrix[far])
        found = matrix[at]
        # A dimension with few vectors repeats its last pivot, so that all rows have as many angles.
        chosen[dim] = np.concatenate([found, np.repeat(found[-1:], PIVOTS - len(found), axis=0)])
    return chosen


def angled(df: DataFrame, vector: str, chosen: dict[int, np.ndarray]) -> DataFrame:
    """Usable rows with ``_dim``, ``_cell``, ``_ring`` and ``_angles``; none of a dimension without pivots."""
    held = df.sparkSession.sparkContext.broadcast(chosen)
    extra = [("_dim", T.IntegerType()), ("_cell", T.IntegerType()), ("_ring", T.IntegerType()), ("_angles", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(vector)).to_pandas()
            for dim, (rows, matrix) in units(values).items():
                n = len(rows)
                if dim in held.value:
                    angles = np.arccos(np.clip(matrix @ held.value[dim].T, -1.0, 1.0))
                    cell = angles.argmin(axis=1)
                    ring = (angles[np.arange(n), cell] * (RINGS / math.pi)).astype(np.int32)
                    flat = pa.array(angles.ravel())
                    nested = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * PIVOTS), flat)
                else:
                    cell, ring = np.full(n, -1), np.zeros(n, np.int32)
                    nested = pa.nulls(n, pa.list_(pa.float64()))
                kept = batch.take(pa.array(rows))
                new = [pa.array(np.full(n, dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(ring), nested]
                yield pa.RecordBatch.from_arrays([*kept.columns, *new], [*batch.schema.names, *(x for x, _ in extra)])

    return df.mapInArrow(run, schema)


def blocked(rows: DataFrame, keys: list[str], ids: list[str], size: int) -> DataFrame:
    """``angled`` rows with their ``_block``: neighbouring rings of a cell, about ``size`` rows.

    All rows of a key are one block where they are no more than ``size``.
    """
    at = [*keys, "_dim", "_cell"]
    rings = rows.groupBy(*at, "_ring").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*at).orderBy("_ring")) - F.col("_n")
    few = F.sum("_n").over(Window.partitionBy(*keys, "_dim")) <= size
    layout = rings.select(
        *at, "_ring", F.floor(before / size).alias("_run"), F.ceil(F.col("_n") / size).alias("_parts"), few.alias("_few")
    )
    part = F.pmod(F.xxhash64(*ids), F.col("_parts"))
    named = F.when(F.col("_few"), "all").otherwise(F.concat_ws(".", F.col("_cell"), F.col("_run"), part))
    return rows.join(layout, [*at, "_ring"]).withColumn("_block", named).drop("_cell", "_ring", "_run", "_parts", "_few")


def bounds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per block the least and the largest angle to every pivot."""
    ends = [F.array(*(f(F.col("_angles")[j]) for j in range(PIVOTS))) for f in (F.min, F.max)]
    return rows.groupBy(*keys, "_dim", "_block").agg(ends[0].alias("_low"), ends[1].alias("_high"))


def block_pairs(left: DataFrame, right: DataFrame, keys: list[str], floor: float | None) -> DataFrame:
    """``keys, _dim, _lb, _rb, reachable`` of all pairs of blocks that have the keys in common."""
    a = bounds(left, keys).withColumnsRenamed({"_block": "_lb", "_low": "_la", "_high": "_ha"})
    b = bounds(right, keys).withColumnsRenamed({"_block": "_rb", "_low": "_lo", "_high": "_hi"})
    limit = math.pi if floor is None else math.acos(min(1.0, max(-1.0, floor)))
    gap = f"exists(sequence(0, {PIVOTS - 1}), j -> greatest(_la[j] - _hi[j], _lo[j] - _ha[j]) > {limit + SLACK!r}D)"
    pairs = a.join(b, [*keys, "_dim"])
    return pairs.select(*keys, "_dim", "_lb", "_rb", (~F.coalesce(F.expr(gap), F.lit(False))).alias("reachable"))
