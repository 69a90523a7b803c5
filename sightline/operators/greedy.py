"""Greedy choices inside a frame: one-to-one pairs, and suppression of overlapping boxes.

Both go through the rows of a frame from the best to the worst and take what does not clash with
something taken before. A usual frame is a short array that is folded in the JVM. A frame of more
than ``DENSE`` rows is never gathered: its rows are put in order once (a distributed sort) and
chosen in rounds. In a round every row wins that is better than all rows it could clash with,
whatever frame or task these are in; then winners and the rows that clash with them leave. A row
that beats all its rivals is taken by the greedy walk too, so the rounds give its very result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline.session import cut_lineage

#: Rows of a frame up to which it is folded as one array.
DENSE = 256
#: Best rows of a cell that can win in one round; their pairs are compared.
HEADS = 32
#: Box sizes up to 2 to this power have a level of cells of their own.
LEVELS = 12


def greedy_pairs(pairs: DataFrame, keys: list[str], a: str, b: str, score: str, dense: int = DENSE) -> DataFrame:
    """One-to-one pairs of a frame taken best first; equal scores prefer the higher numbers.

    Pairs below the matching threshold must be gone already.
    """
    kind = dict(pairs.dtypes)
    rest = [c for c in pairs.columns if c not in keys]
    row = f"struct<{', '.join(f'`{c}`:{kind[c]}' for c in rest)}>"
    step = (
        f"if(array_contains(s.a, x.`{a}`) or array_contains(s.b, x.`{b}`), s, "
        f"struct(array_append(s.a, x.`{a}`) as a, array_append(s.b, x.`{b}`) as b, array_append(s.k, x) as k))"
    )
    start = f"struct(cast(array() as array<{kind[a]}>) as a, cast(array() as array<{kind[b]}>) as b, cast(array() as array<{row}>) as k)"
    fold = F.expr(f"aggregate(_items, {start}, (s, x) -> {step}).k")
    order = [F.desc(score), F.desc(a), F.desc(b)]
    return _chosen(pairs, keys, order, fold, dense, lambda live: _pair_rounds(live, keys, a, b))


def suppress(boxes: DataFrame, keys: list[str], order: list, max_iou: float, dense: int = DENSE) -> DataFrame:
    """Non-maximum suppression: drop a box that overlaps a better kept one too much."""
    kind = dict(boxes.dtypes)
    rest = [c for c in boxes.columns if c not in keys]
    row = f"struct<{', '.join(f'`{c}`:{kind[c]}' for c in rest)}>"
    clash = _clash("x.", "k.", max_iou)
    fold = F.expr(f"aggregate(_items, cast(array() as array<{row}>), (s, x) -> if(exists(s, k -> {clash}), s, array_append(s, x)))")
    return _chosen(boxes, keys, order, fold, dense, lambda live: _box_rounds(live, keys, max_iou))


def _clash(x: str, k: str, max_iou: float) -> str:
    width = f"greatest(0D, least({x}x2, {k}x2) - greatest({x}x1, {k}x1))"
    height = f"greatest(0D, least({x}y2, {k}y2) - greatest({x}y1, {k}y1))"
    union = f"(({x}x2 - {x}x1) * ({x}y2 - {x}y1) + ({k}x2 - {k}x1) * ({k}y2 - {k}y1) - {width} * {height})"
    return f"({union} > 0 and {width} * {height} / {union} > {float(max_iou)!r}D)"


def _with(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join on columns of equal names, nulls equal; columns of ``right`` that are joined on go."""
    named = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(named, condition, how).drop(*(f"_r_{c}" for c in on))


def _chosen(
    df: DataFrame, keys: list[str], order: list, fold: Column, dense: int, rounds: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Folds usual frames; ``rounds`` gives the places of the rows that crowded frames keep.

    The rank limit holds before the shuffle already, so a crowded frame is not brought together.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = df.withColumn("_rank", rank).where(F.col("_rank") <= dense + 1)
    items = F.array_sort(F.collect_list(F.struct("_rank", F.struct(*rest).alias("item"))))
    frames = first.groupBy(*keys).agg(F.transform(items, lambda x: x["item"]).alias("_items"))
    frames = frames.withColumn("_kept", F.when(F.size("_items") <= dense, fold))
    frames = cut_lineage(frames.drop("_items"))
    kept = frames.where("_kept is not null").select(*keys, F.explode("_kept").alias("_k"))
    kept = kept.select(*[F.col(c) if c in keys else F.col(f"_k.{c}").alias(c) for c in df.columns])
    crowded = frames.where("_kept is null").select(*keys)
    if crowded.isEmpty():
        return kept
    # Sorted and written, rows have numbers in their order.
    rows = cut_lineage(_with(df, crowded, keys, "left_semi").orderBy(*order))
    rows = cut_lineage(rows.withColumn("_at", F.monotonically_increasing_id()))
    return kept.unionByName(rows.join(rounds(rows), "_at", "left_semi").drop("_at"))


def _pair_rounds(rows: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """``_at`` of the pairs taken: in a round those that come first for both of their ends."""
    live, taken = rows.select(*keys, a, b, "_at"), None
    while not live.isEmpty():
        by_a, by_b = (live.groupBy(*keys, end).agg(F.min("_at").alias("_at")) for end in (a, b))
        won = cut_lineage(by_a.join(by_b.select("_at"), "_at").join(live.select("_at", b), "_at"))
        taken = won.select("_at") if taken is None else taken.union(won.select("_at"))
        for end in (a, b):
            live = _with(live, won.select(*keys, end), [*keys, end], "left_anti")
        live = cut_lineage(live)
    return taken


def _cells(live: DataFrame, max_iou: float) -> DataFrame:
    """A row for each cell of a box; boxes that clash have a cell in common.

    Boxes that overlap by ``max_iou`` have sides of a bounded ratio. A cell level fits boxes of a
    size in each direction, and a box is in the cells of its own level and of as many coarser ones
    as the ratio asks for.
    """
    ratio = -math.log2(max_iou) if 0 < max_iou < 1 else 1.0
    step = max(1, math.ceil(ratio / 2))  # sizes of a level differ by up to 2 to this power
    last_level = math.ceil(LEVELS / step)
    reach = min(last_level, math.ceil(ratio / step)) if max_iou > 0 else last_level
    for axis, low, high in (("x", "x1", "x2"), ("y", "y1", "y2")):
        size = F.greatest(F.col(high) - F.col(low), F.lit(1.0))
        own = F.least(F.floor(F.log2(size) / step), F.lit(last_level)).cast("int")
        live = live.withColumn(f"_l{axis}", F.explode(F.sequence(own, F.least(own + reach, F.lit(last_level)))))
        side = F.pow(F.lit(2.0), (F.col(f"_l{axis}") + 1) * step)
        first, last = (F.floor(F.col(c) / side).cast("long") for c in (low, high))
        live = live.withColumn(f"_c{axis}", F.explode(F.sequence(first, F.greatest(first, last))))
    return live


def _box_rounds(rows: DataFrame, keys: list[str], max_iou: float) -> DataFrame:
    """``_at`` of the boxes kept: in a round those without a better clashing box in any of their cells."""
    box = ["x1", "y1", "x2", "y2", "_at"]
    live, taken = rows.select(*keys, *(F.col(c).cast("double").alias(c) for c in box[:-1]), "_at"), None
    cell = [*keys, "_lx", "_ly", "_cx", "_cy"]
    clash = F.expr(_clash("", "_k_", max_iou))
    while not live.isEmpty():
        cells = cut_lineage(_cells(live, max_iou))
        rank = F.row_number().over(Window.partitionBy(*cell).orderBy("_at"))
        heads = cut_lineage(cells.withColumn("_rank", rank).where(F.col("_rank") <= HEADS).drop("_rank"))
        other = heads.withColumnsRenamed({c: f"_k_{c}" for c in box})
        beaten = _with(heads, other, cell, "inner").where((F.col("_k__at") < F.col("_at")) & clash).select("_at").distinct()
        # All cells of a winner must have it among their heads.
        whole = heads.groupBy("_at").agg(F.count(F.lit(1)).alias("_n")).join(
            cells.groupBy("_at").agg(F.count(F.lit(1)).alias("_n")), ["_at", "_n"]
        )
        won = cut_lineage(whole.select("_at").join(beaten, "_at", "left_anti"))
        winners = heads.join(won, "_at", "left_semi").withColumnsRenamed({c: f"_k_{c}" for c in box})
        lost = _with(cells, winners, cell, "inner").where((F.col("_k__at") < F.col("_at")) & clash).select("_at").distinct()
        taken = won if taken is None else taken.union(won)
        live = cut_lineage(live.join(won, "_at", "left_anti").join(lost, "_at", "left_anti"))
    return taken
