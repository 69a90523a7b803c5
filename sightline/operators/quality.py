"""Ordered quality gates: the first failing reason decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sightline.functions import geometry as g, text
from sightline.operators.overlap import DENSE_FRAME, max_overlap
from sightline.policy import PlatePolicy, QualityPolicy


def parse_filter(rows: DataFrame, classes: tuple[int, ...], numbers: list[str]) -> DataFrame:
    """Keep rows of the wanted classes whose numeric columns are all finite.

    The test is explicit: Spark sorts NaN above every number, so a bare ``>=`` would let
    NaN confidences through.
    """
    keep = F.col("class_id").isin(*classes)
    for name in numbers:
        keep = keep & g.finite(F.col(name))
    return rows.where(keep)


def _limits(policies: dict[str, QualityPolicy]) -> dict[str, Column]:
    """Every limit as a column that follows the row's domain (a literal for one domain)."""
    names = (
        "min_confidence",
        "max_edge_truncation",
        "max_overlap",
        "edge_margin",
        "min_crop_width",
        "min_crop_height",
    )
    return {
        n: text.choose(F.col("_domain"), {d: F.lit(getattr(p, n)) for d, p in policies.items()})
        if len(policies) > 1
        else F.lit(getattr(next(iter(policies.values())), n))
        for n in names
    }


def _gates_before_overlap(limit: dict[str, Column]) -> Column:
    kept = g.box()
    fw, fh = F.col("frame_width").cast("double"), F.col("frame_height").cast("double")
    mx, my = fw * limit["edge_margin"], fh * limit["edge_margin"]
    on_edge = (kept.x1 <= mx) | (kept.y1 <= my) | (kept.x2 >= fw - mx) | (kept.y2 >= fh - my)
    truncation = 1.0 - F.col("_kept_area") / F.col("_raw_area")
    return (
        F.when(~g.finite(F.col("conf")) | (F.col("conf") < limit["min_confidence"]), "low_confidence")
        .when(F.col("_raw_area") <= 0.0, "invalid_bbox")
        .when(F.col("_kept_area") <= 0.0, "outside_frame")
        .when(truncation > limit["max_edge_truncation"], "edge_truncated")
        .when(on_edge, "frame_edge")
    )


def assess(
    tracks: DataFrame,
    policy: QualityPolicy | dict[str, QualityPolicy],
    keys: list[str] | None = None,
    dense: int = DENSE_FRAME,
    accept: Column | None = None,
) -> DataFrame:
    """Add ``overlap``, the integer ``crop`` and ``reason`` (null means accepted).

    ``tracks`` needs the box, ``conf``, ``class_id``, ``track_id``, ``frame_width`` and
    ``frame_height``.  Only boxes that pass the cheap gates are compared with others.
    With one policy every other class is a stranger; with a policy per domain each row is
    judged by the limits of its ``domain``, in one pass.  ``accept`` replaces all gates by
    the caller's own assessor, a condition on the columns of ``tracks`` (and ``overlap`` and
    ``crop``); boxes it refuses have the reason ``assessor``.
    """
    policies = {policy.domain: policy} if isinstance(policy, QualityPolicy) else policy
    # Strangers have no group, so they are nobody's partner and pass through in the same pass.
    keys = [*(keys or ["camera_id", "frame_index"]), "_group"]
    corners = ("x1", "y1", "x2", "y2")
    fw, fh = F.col("frame_width"), F.col("frame_height")
    rest = [c for c in tracks.columns if c not in corners]
    of_class = text.domain_of_class(F.col("class_id"))
    wanted = F.lit(next(iter(policies))) if len(policies) == 1 else F.col("domain")
    marked = tracks.withColumn("_domain", wanted)
    own = F.coalesce((of_class == F.col("_domain")) & F.col("_domain").isin(*policies), F.lit(False))
    cropped = marked.withColumn("crop", g.outer_crop(g.box(), fw, fh)).withColumn(
        "_group", F.when(own, F.col("_domain"))
    )
    limit = _limits(policies)

    # Everything that needs no partner is settled before the shuffle, in small stages: a
    # column that is used often is computed once and not pasted into every use.
    finite = cropped.withColumn("_finite", g.all_finite(*g.box()))
    raw = finite.select(
        *rest,
        "_domain",
        "_group",
        "crop",
        *[F.col(n).alias(f"raw_{n}") for n in corners],
        *[F.when(F.col("_finite"), F.col(n)).otherwise(F.lit(0.0)).alias(n) for n in corners],
    ).withColumn("_raw_area", g.area(g.box()))
    for n, side in zip(corners, (fw, fh, fw, fh)):
        raw = raw.withColumn(n, F.greatest(F.lit(0.0), F.least(side.cast("double"), F.col(n))))
    small = (F.col("crop.x2") - F.col("crop.x1") < limit["min_crop_width"]) | (
        F.col("crop.y2") - F.col("crop.y1") < limit["min_crop_height"]
    )
    prepared = (
        raw.withColumn("_kept_area", g.area(g.box()))
        .withColumn("_early", _gates_before_overlap(limit))
        .withColumn("_small", F.coalesce(small, F.lit(True)))
        .drop("_raw_area", "_kept_area")
    )
    judged = F.col("_group").isNotNull()
    boxes = max_overlap(prepared, keys, needed=judged & F.col("_early").isNull(), dense=dense)
    reason = (
        F.when(~judged, F.concat(F.lit("not_"), F.coalesce("_domain", F.lit("known"))))
        .when(F.col("_early").isNotNull(), F.col("_early"))
        .when(F.col("overlap") > limit["max_overlap"], F.concat(F.col("_domain"), F.lit("_overlap")))
        .when(F.col("_small"), "small_crop")
    )
    out = boxes.select(
        *rest, *[F.col(f"raw_{n}").alias(n) for n in corners], "overlap", "crop", judged.alias("_own"), reason.alias("reason")
    )
    if accept is not None:
        # Strangers keep their reason: the assessor is only asked about its own domain.
        refused = F.when(~F.coalesce(accept, F.lit(False)), "assessor")
        out = out.withColumn("reason", F.when(F.col("_own"), refused).otherwise(F.col("reason")))
    return out.drop("_own")


def plate_gate(observations: DataFrame, policy: PlatePolicy) -> DataFrame:
    """Keep readings that are legible: text, confidence, size inside the crop, sharpness."""
    x1 = F.greatest(F.lit(0), F.col("x1"))
    y1 = F.greatest(F.lit(0), F.col("y1"))
    x2 = F.least(F.col("crop_w"), F.col("x2"))
    y2 = F.least(F.col("crop_h"), F.col("y2"))
    return observations.withColumn("plate", text.normalize_plate(F.col("plate"))).where(
        F.col("plate").isNotNull()
        & g.finite(F.col("conf"))
        & (F.col("conf") >= policy.min_confidence)
        & (x2 - x1 >= policy.min_width)
        & (y2 - y1 >= policy.min_height)
        & g.finite(F.col("sharpness"))
        & (F.col("sharpness") >= policy.min_sharpness)
    )


def valid_scores(boxes: DataFrame, classes: tuple[int, ...], threshold: float) -> DataFrame:
    """Decoded predictions worth keeping: finite, allowed class, score, positive area."""
    b = g.box()
    return boxes.where(
        g.all_finite(*b, F.col("score"))
        & F.col("class_id").isin(*classes)
        & (F.col("score") >= threshold)
        & (b.x2 > b.x1)
        & (b.y2 > b.y1)
    )
