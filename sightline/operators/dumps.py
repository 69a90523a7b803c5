"""Comparison of two recorded runs of the same source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sightline.functions import geometry as g
from sightline.operators.overlap import DENSE_FRAME, touching_pairs
from sightline.policy import PERSON_CLASSES, DumpPolicy


def _people(df: DataFrame) -> DataFrame:
    return df.withColumn("_is_person", F.col("class_id").isin(*PERSON_CLASSES))


def frame_counts(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Person boxes per frame in either run; a frame missing on one side counts zero there.

    One aggregate over the stacked runs instead of two aggregates and a full outer join:
    the rows are shuffled once, already partially counted.
    """
    stacked = (
        _people(first).select(*keys, "_is_person", F.lit(1).alias("_run"))
        .unionByName(_people(second).select(*keys, "_is_person", F.lit(2).alias("_run")))
    )
    return stacked.groupBy(*keys).agg(
        F.count_if(F.col("_is_person") & (F.col("_run") == 1)).alias("first_boxes"),
        F.count_if(F.col("_is_person") & (F.col("_run") == 2)).alias("second_boxes"),
    )


def kept_counts(first: DataFrame, kept: Column, keys: list[str]) -> DataFrame:
    """:func:`frame_counts` where the second run is the rows of the first one that are ``kept``.

    The run is read and grouped once, so a task holds one table of its groups and not two.
    """
    marked = _people(first).select(*keys, "_is_person", kept.alias("_kept"))
    return marked.groupBy(*keys).agg(
        F.count_if("_is_person").alias("first_boxes"),
        F.count_if(F.col("_is_person") & F.col("_kept")).alias("second_boxes"),
    )


def candidate_pairs(
    first: DataFrame, second: DataFrame, keys: list[str], min_iou: float, dense: int = DENSE_FRAME
) -> DataFrame:
    """Box pairs of one frame with at least ``min_iou``; lower pairs can never match."""
    names = [*keys, "det_idx", "x1", "y1", "x2", "y2", "conf"]
    people = [_people(df).where("_is_person").select(*names) for df in (first, second)]
    pairs = touching_pairs(*people, keys, dense)
    return pairs.withColumn("iou", g.iou(g.box("a_"), g.box("b_"))).where(F.col("iou") >= min_iou)


def divergence(matched: DataFrame, policy: DumpPolicy) -> DataFrame:
    """Ratios between matched boxes and the reasons why they count as diverging."""
    a, b = g.box("a_"), g.box("b_")
    area_ratio = F.when(g.area(a) > 0.0, g.area(b) / g.area(a)).otherwise(F.lit(float("inf")))
    center = g.center_distance_ratio(a, b)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("iou") < policy.divergence_iou, "iou"),
            F.when(area_ratio > policy.divergence_area, "area_grew").when(
                area_ratio < 1.0 / policy.divergence_area, "area_shrank"
            ),
            F.when(center > policy.divergence_center, "center_shift"),
        )
    )
    return (
        matched.withColumn("width_ratio", g.width(b) / F.greatest(g.width(a), F.lit(1e-6)))
        .withColumn("height_ratio", g.height(b) / F.greatest(g.height(a), F.lit(1e-6)))
        .withColumn("area_ratio", area_ratio)
        .withColumn("center_distance", g.center_distance(a, b))
        .withColumn("center_ratio", center)
        .withColumn("confidence_difference", F.col("b_conf") - F.col("a_conf"))
        .withColumn("reasons", reasons)
        .withColumn("divergent", F.size("reasons") > 0)
    )
