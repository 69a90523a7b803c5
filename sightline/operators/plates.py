"""Plate readings: parsing, voting, confirmation, late results and propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline.functions import text
from sightline.operators import scan
from sightline.policy import VEHICLE_CLASSES, PlatePolicy


def adapt_readings(rows: DataFrame, raw: Column) -> DataFrame:
    """Provider results as ``plate``, ``conf`` and box columns; incomplete ones drop out.

    Accepted JSON shapes: an object with ``plate_number`` / ``text`` / ``code``,
    ``confidence`` / ``score`` and ``bbox`` / ``box``; a list ``[plate, confidence,
    [x1, y1, x2, y2]]``; and the flat list ``[plate, confidence, x1, y1, x2, y2]``.
    """

    def first(paths: list[str], kind: str) -> Column:
        return F.coalesce(*[F.try_variant_get("_v", p, kind) for p in paths])

    flat = F.array(*[F.try_variant_get("_v", f"$[{i}]", "double") for i in range(2, 6)])
    boxes = first(["$.bbox", "$.box", "$[2]"], "array<double>")
    read = (
        rows.withColumn("_v", F.try_parse_json(raw))
        .withColumn("plate", text.normalize_plate(first(["$.plate_number", "$.text", "$.code", "$[0]"], "string")))
        .withColumn("conf", first(["$.confidence", "$.score", "$[1]"], "double"))
        .withColumn("_box", F.coalesce(boxes, flat))
        .drop("_v")
    )
    whole = (F.size("_box") == 4) & ~F.exists("_box", lambda x: x.isNull())
    kept = read.where(F.col("plate").isNotNull() & F.col("conf").isNotNull() & whole)
    corners = [F.rint(F.col("_box")[i]).cast("int").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]
    return kept.select(*rows.columns, "plate", "conf", *corners)


def best_reading(readings: DataFrame, keys: list[str]) -> DataFrame:
    """The most confident reading per group; the first one among equals."""
    rest = [c for c in readings.columns if c not in keys]
    best = readings.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(F.col("conf"), -F.col("obs_idx"))).alias("b")
    )
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest])


def vote(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Plate with the most hits; the greatest text among equals."""
    hits = readings.groupBy(*keys, "plate").agg(F.count(F.lit(1)).alias("hits"))
    return hits.groupBy(*keys).agg(
        F.max_by("plate", F.struct("hits", "plate")).alias("plate"), F.max("hits").alias("hits")
    )


def confirmations(
    readings: DataFrame,
    keys: list[str],
    policy: PlatePolicy,
    frame: str = "frame_index",
    epoch: str | None = None,
    bound: Column | None = None,
) -> DataFrame:
    """First reading that makes a plate stable, per key and epoch.

    Votes lapse when the next reading comes more than ``pending_max_age`` frames later, and
    when visibility is interrupted (another ``epoch``), so they count inside runs.  Until the
    first confirmation every plate of a run has fewer than ``hits`` votes, hence the plate
    that reaches it is the leader, and a key with a stable plate is not read again: the
    earliest such row is the whole answer.  An interruption also forgets the stable plate,
    unless the track is ``bound`` to a target: then the first one stays for good.
    """
    places = [*keys] if epoch is None else [*keys, epoch]
    runs = scan.with_runs(readings, places, frame, limits={frame: policy.pending_max_age})
    nth = Window.partitionBy(*places, "run_no", "plate").orderBy(frame)
    reached = runs.withColumn("_vote", F.row_number().over(nth)).where(F.col("_vote") == policy.hits)
    life = F.lit(None).cast("long")
    if epoch is not None:
        life = F.when(~F.coalesce(F.lit(False) if bound is None else bound, F.lit(False)), F.col(epoch).cast("long"))
    rest = [*([] if epoch is None else [epoch]), frame, "plate", "conf", "sharpness"]
    first = reached.groupBy(*keys, life.alias("_life")).agg(F.min_by(F.struct(*rest), F.col(frame)).alias("c"))
    return first.select(*keys, *[f"c.{c}" for c in rest])


TRACK = ("camera_id", "domain", "track_id")


def stale_reason(
    results: DataFrame, states: DataFrame, policy: PlatePolicy, keys: tuple[str, ...] = TRACK
) -> DataFrame:
    """Why a late result must not be used; null when it may be.

    ``states`` is the state of a track in the frame in which the result arrives
    (``class_id``, ``track_epoch``, ``target_id``, ``stable_plate``); the first reason in
    order decides.  Track numbers repeat across cameras, so ``keys`` names the track.
    """
    joined = results.join(current_state(states, keys), [*keys, "arrive_frame"], "left")
    return with_stale_reason(joined, policy)


def current_state(states: DataFrame, keys: tuple[str, ...], *more: Column) -> DataFrame:
    """State of a track in the frame in which a result may arrive."""
    return states.select(
        *keys,
        F.col("frame_index").alias("arrive_frame"),
        F.col("class_id").alias("now_class"),
        F.col("track_epoch").alias("now_epoch"),
        F.col("target_id").alias("now_target"),
        F.col("stable_plate").alias("now_plate"),
        *more,
    )


def with_stale_reason(joined: DataFrame, policy: PlatePolicy) -> DataFrame:
    """``reason`` of results that stand beside the ``current_state`` of their frame."""
    reason = (
        F.when(~F.col("task_known"), "unknown_task")
        .when(F.col("error").isNotNull(), "failed")
        .when(F.col("now_class").isNull(), "track_missing")
        .when(~F.col("now_class").isin(*VEHICLE_CLASSES), "class_changed")
        .when(F.col("arrive_frame") - F.col("submit_frame") > policy.max_result_age, "result_expired")
        .when(~F.col("now_epoch").eqNullSafe(F.col("track_epoch")), "track_epoch_changed")
        .when(
            F.col("target_id").isNotNull() & ~F.col("now_target").eqNullSafe(F.col("target_id")),
            "target_changed",
        )
        .when(
            F.col("now_plate").isNotNull()
            & ~F.col("now_plate").eqNullSafe(F.col("plate_at_submit")),
            "plate_state_changed",
        )
    )
    return joined.withColumn("reason", reason).drop("now_class", "now_epoch", "now_target", "now_plate")


def latest_only(tasks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest waiting task per slot and the number of tasks it displaced.

    Tasks of kind ``external`` are never displaced: the first one keeps its slot.
    """
    rest = [c for c in tasks.columns if c not in keys]
    item, at = F.struct(*rest), F.struct(*order)
    slots = tasks.groupBy(*keys, (F.col("kind") == "external").alias("external")).agg(
        F.max_by(item, at).alias("newest"),
        F.min_by(item, at).alias("oldest"),
        (F.count(F.lit(1)) - 1).alias("dropped"),
    )
    kept = F.when(F.col("external"), F.col("oldest")).otherwise(F.col("newest"))
    return slots.withColumn("kept", kept).select(*keys, "dropped", "kept.*")


def propagate(
    confirmed: DataFrame, bindings: DataFrame, identities: DataFrame, keys: tuple[str, ...] = TRACK
) -> tuple[DataFrame, DataFrame]:
    """Plate of each target (first known wins) and of each identity (a null is filled once).

    ``confirmed``: ``keys``, ``frame_index``, ``plate``; ``bindings``: ``keys``,
    ``target_id``, ``identity_id``, ``from_frame``, ``to_frame``.
    """
    inside = (F.col("frame_index") >= F.col("from_frame")) & (
        F.col("to_frame").isNull() | (F.col("frame_index") <= F.col("to_frame"))
    )
    seen = confirmed.join(bindings, list(keys)).where(inside)
    order = F.struct("frame_index", *keys, "plate")
    targets = seen.groupBy("target_id").agg(
        F.min_by("plate", order).alias("plate"), F.min("frame_index").alias("since_frame")
    )
    fills = seen.where(F.col("identity_id").isNotNull()).groupBy("identity_id").agg(
        F.min_by("plate", order).alias("_fill")
    )
    filled = identities.join(fills, "identity_id", "left").withColumn(
        "plate_number", F.coalesce("plate_number", "_fill")
    )
    return targets, filled.drop("_fill")


def worker_stats(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Counters of a reading worker; the rate is zero when no time has passed.

    ``tasks``: ``status`` (completed, failed, dropped or expired), ``elapsed_ms``,
    ``submitted_at`` in seconds.
    """
    done = F.col("status").isin("completed", "failed", "expired")
    span = F.max("submitted_at") - F.min("submitted_at")
    completed = F.count_if(done)
    return tasks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("submitted"),
        completed.alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "dropped").alias("dropped"),
        F.count_if(F.col("status") == "expired").alias("expired"),
        F.when(span > 0, completed / span).otherwise(0.0).alias("actual_hz"),
        F.coalesce(F.avg(F.when(done, F.col("elapsed_ms"))), F.lit(0.0)).alias("avg_ms"),
        F.coalesce(F.max(F.when(done, F.col("elapsed_ms"))), F.lit(0.0)).alias("max_ms"),
    )
