"""Boxes that overlap other boxes of the same frame.

A frame normally holds a handful of boxes and an equi-join on the frame is the best plan.
A frame with very many boxes would make that join quadratic in one task; such frames are
joined by grid cell instead, over *distinct* boxes, so neither a crowded frame nor a pile
of identical boxes is paired up in one place.  Both ways give the same numbers.

Crowded frames are found by a count per frame that is combined before the shuffle; usually
there are none, and the plan is the plain join alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline.functions import geometry as g
from sightline.session import cut_lineage

DENSE_FRAME = 256
LIMITLESS = 2**31 - 1
# Up to this many crowded frames are broadcast to mark their boxes.
BROADCAST_FRAMES = 50_000
CELL = 96.0
MAX_CELL = 63


def _touching(a: g.Box, b: g.Box) -> Column:
    return (a.x1 < b.x2) & (b.x1 < a.x2) & (a.y1 < b.y2) & (b.y1 < a.y2)


def _cells(low: Column, high: Column) -> Column:
    def index(v: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(MAX_CELL), F.floor(v / CELL).cast("int")))

    return F.sequence(index(low), index(high))


def _split_crowded(boxes: DataFrame, keys: list[str], dense: int) -> tuple[DataFrame, DataFrame | None]:
    """Boxes of usual groups, and those of groups with more than ``dense`` boxes, if any.

    Groups with a null key pair up with nothing and count as usual.
    """
    if dense >= LIMITLESS:
        return boxes, None
    named = boxes.select(*keys).dropna()
    crowded = cut_lineage(named.groupBy(*keys).count().where(F.col("count") > dense).select(*keys))
    n = crowded.limit(BROADCAST_FRAMES + 1).count()
    if not n:
        return boxes, None
    marks = F.broadcast(crowded) if n <= BROADCAST_FRAMES else crowded
    return boxes.join(marks, keys, "left_anti"), boxes.join(marks, keys, "left_semi")


def _by_frame(boxes: DataFrame, keys: list[str], id_col: str, ratio, needed: str) -> DataFrame:
    a = boxes.alias("a")
    b = boxes.select(*keys, id_col, "x1", "y1", "x2", "y2").alias("b")
    box_a, box_b = g.box(table="a"), g.box(table="b")
    cond = F.col(f"a.{needed}") & (F.col(f"a.{id_col}") != F.col(f"b.{id_col}"))
    for key in keys:
        cond = cond & (F.col(f"a.{key}") == F.col(f"b.{key}"))
    pairs = a.join(b, cond & _touching(box_a, box_b), "left")
    # least/greatest skip nulls, so an absent partner has to be ruled out explicitly.
    value = F.when(F.col(f"b.{id_col}").isNotNull(), ratio(box_a, box_b))
    return pairs.groupBy(*[F.col(f"a.{c}") for c in boxes.columns]).agg(
        F.coalesce(F.max(value), F.lit(0.0)).alias("overlap")
    )


def _by_cell(boxes: DataFrame, keys: list[str], id_col: str, ratio, needed: str) -> DataFrame:
    corners = ["x1", "y1", "x2", "y2"]
    shapes = boxes.groupBy(*keys, *corners).agg(
        F.min(id_col).alias("_low"), F.max(id_col).alias("_high")
    )
    placed = shapes.withColumn("_cx", F.explode(_cells(F.col("x1"), F.col("x2")))).withColumn(
        "_cy", F.explode(_cells(F.col("y1"), F.col("y2")))
    )
    box_a, box_b = g.box(table="a"), g.box(table="b")
    # A shape only pairs with itself when two different ids share it.
    other = (F.col("a._low") != F.col("b._low")) | (F.col("a._low") != F.col("b._high"))
    cond = _touching(box_a, box_b) & other
    for key in [*keys, "_cx", "_cy"]:
        cond = cond & (F.col(f"a.{key}") == F.col(f"b.{key}"))
    best = (
        placed.alias("a")
        .join(placed.alias("b"), cond)
        .groupBy(*[F.col(f"a.{c}") for c in [*keys, *corners]])
        .agg(F.max(ratio(box_a, box_b)).alias("overlap"))
    )
    full = boxes.join(best, [*keys, *corners], "left")
    return full.withColumn(
        "overlap",
        F.when(F.col(needed), F.coalesce("overlap", F.lit(0.0))).otherwise(F.lit(0.0)),
    ).select(*boxes.columns, "overlap")


def max_overlap(
    boxes: DataFrame,
    keys: list[str],
    id_col: str = "track_id",
    ratio=g.cover_ratio,
    needed: Column | None = None,
    dense: int = DENSE_FRAME,
) -> DataFrame:
    """Add ``overlap``: the largest ``ratio`` of a box with another id in its group.

    ``needed`` limits for which boxes the value is wanted (others get zero); every box
    still counts as a partner.  Boxes must be finite and unique per ``(keys, id_col)``.
    """
    marked = boxes.withColumn("_needed", F.lit(True) if needed is None else F.coalesce(needed, F.lit(False)))
    usual, busy = _split_crowded(marked, keys, dense)
    result = _by_frame(usual, keys, id_col, ratio, "_needed")
    if busy is not None:
        result = result.unionByName(_by_cell(busy, keys, id_col, ratio, "_needed"))
    return result.drop("_needed")


def touching_pairs(
    left: DataFrame, right: DataFrame | None, keys: list[str], dense: int = DENSE_FRAME
) -> DataFrame:
    """Pairs of touching boxes of one group, each once, as ``a_*`` and ``b_*`` columns.

    ``right`` has the columns of ``left``, or is None to pair a table with itself (a box
    then also meets itself).  In a crowded group boxes meet by grid cell; a pair that
    shares several cells is taken in the first one.
    """
    first = left.withColumn("_side", F.lit(1))
    stacked = first if right is None else first.unionByName(right.withColumn("_side", F.lit(2)))
    # Both sides must agree on what is crowded, so they are counted together.
    usual, crowded = _split_crowded(stacked, keys, dense)

    rest = [c for c in left.columns if c not in keys]

    def join(boxes: DataFrame, on: list[str], extra: Column | None = None) -> DataFrame:
        sides = [boxes, boxes] if right is None else [boxes.where(f"_side = {i}") for i in (1, 2)]
        a, b = (side.alias(mark) for side, mark in zip(sides, "ab"))
        cond = _touching(g.box(table="a"), g.box(table="b"))
        for key in on:
            cond = cond & (F.col(f"a.{key}") == F.col(f"b.{key}"))
        return a.join(b, cond if extra is None else cond & extra).select(
            *[F.col(f"a.{k}") for k in keys],
            *[F.col(f"{m}.{c}").alias(f"{m}_{c}") for m in "ab" for c in rest],
        )

    if crowded is None:
        return join(usual, keys)
    for axis in ("x", "y"):
        cells = _cells(F.col(f"{axis}1"), F.col(f"{axis}2"))
        crowded = crowded.withColumn(f"_{axis}", F.array_min(cells)).withColumn(f"_c{axis}", F.explode(cells))

    def first_shared(axis: str) -> Column:
        return F.col(f"a._c{axis}") == F.greatest(F.col(f"a._{axis}"), F.col(f"b._{axis}"))

    by_cell = join(crowded, [*keys, "_cx", "_cy"], first_shared("x") & first_shared("y"))
    return join(usual, keys).unionByName(by_cell)


def overlap_partners(
    boxes: DataFrame,
    keys: list[str],
    trigger: float,
    limit: int,
    id_col: str = "track_id",
    ratio=g.min_area_overlap,
    dense: int = DENSE_FRAME,
) -> DataFrame:
    """Per box its strongest partners at or above ``trigger``: ``(ratio desc, id)``.

    Only touching boxes are partners.  In a crowded group equal boxes are one shape that
    keeps its first ids only: later ids of a shape never are among the first ``limit``.
    """
    slim = boxes.select(*keys, id_col, "x1", "y1", "x2", "y2")
    usual, crowded = _split_crowded(slim, keys, dense)
    scored = _ranked_pairs(touching_pairs(usual, None, keys, LIMITLESS), keys, id_col, ratio, trigger, limit)
    if crowded is None:
        return scored
    corners = ["x1", "y1", "x2", "y2"]
    first_ids = Window.partitionBy(*keys, *corners).orderBy(id_col)
    heads = crowded.withColumn("_n", F.row_number().over(first_ids)).where(F.col("_n") <= limit + 1).drop("_n")
    shapes = heads.groupBy(*keys, *corners).agg(F.sort_array(F.collect_list(id_col)).alias("_ids"))
    # A shape meets itself too: its boxes are partners of each other.
    near = touching_pairs(shapes, None, keys, 0)
    value = ratio(g.box("a_"), g.box("b_"))
    near = near.withColumn("ratio", value).where(F.col("ratio") >= trigger)
    best = Window.partitionBy(*keys, *[f"a_{c}" for c in corners]).orderBy(F.desc("ratio"), F.col("b__ids")[0])
    # One more than the limit, as a box is not its own partner.
    near = near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= limit + 1)
    near = near.select(*keys, *[F.col(f"a_{c}").alias(c) for c in corners], "ratio", F.col("b__ids").alias("_ids"))
    found = crowded.join(near, [*keys, *corners]).withColumn("partner_id", F.explode("_ids"))
    found = found.where(F.col("partner_id") != F.col(id_col)).select(*keys, id_col, "partner_id", "ratio")
    return scored.unionByName(_top(found, keys, id_col, limit))


def _top(found: DataFrame, keys: list[str], id_col: str, limit: int) -> DataFrame:
    order = Window.partitionBy(*keys, id_col).orderBy(F.desc("ratio"), "partner_id")
    return found.withColumn("partner_rank", F.row_number().over(order)).where(F.col("partner_rank") <= limit)


def _ranked_pairs(pairs: DataFrame, keys: list[str], id_col: str, ratio, trigger: float, limit: int) -> DataFrame:
    scored = pairs.where(F.col(f"a_{id_col}") != F.col(f"b_{id_col}")).select(
        *keys,
        F.col(f"a_{id_col}").alias(id_col),
        F.col(f"b_{id_col}").alias("partner_id"),
        ratio(g.box("a_"), g.box("b_")).alias("ratio"),
    )
    return _top(scored.where(F.col("ratio") >= trigger), keys, id_col, limit)
