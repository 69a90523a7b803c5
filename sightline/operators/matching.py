"""Conservative one-to-one matching on scored pairs, and what follows from it.

Each target can only ever claim its own best candidate, so two claims can collide on the
candidate side only.  The greedy claim order therefore equals a ``row_number`` per
candidate, and the whole matching is a few windows without any loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline.operators import scan


def margin_match(
    pairs: DataFrame,
    keys: list[str],
    threshold: float,
    margin: float,
    support_threshold: float | None = None,
    later_wins: bool = False,
) -> DataFrame:
    """Pairs accepted by threshold, support and the margin on both sides.

    ``pairs``: ``keys``, ``target_id``, ``track_id``, ``score`` [, ``support``].  Pairs
    that are known to be below ``threshold - margin`` may be missing: they cannot be the
    second best of an accepted pair within its margin.
    """
    tie = F.desc("track_id") if later_wins else F.asc("track_id")
    per_target = Window.partitionBy(*keys, "target_id").orderBy(F.desc("score"), tie)
    per_track = Window.partitionBy(*keys, "track_id").orderBy(F.desc("score"), "target_id")
    whole = per_track.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        pairs.withColumn("_rank", F.row_number().over(per_target))
        .withColumn("_next", F.lead("score").over(per_target))
        .withColumn("_rival", F.nth_value("score", 2).over(whole))
    )
    ok = (F.col("_rank") == 1) & (F.col("score") >= threshold)
    if support_threshold is not None:
        ok = ok & (F.col("support") >= support_threshold)
    ok = ok & (F.col("_next").isNull() | (F.col("score") - F.col("_next") >= margin))
    ok = ok & (F.col("_rival").isNull() | (F.col("score") - F.col("_rival") >= margin))
    claims = ranked.where(ok).withColumn("_claim", F.row_number().over(per_track))
    return claims.where(F.col("_claim") == 1).drop("_rank", "_next", "_rival", "_claim")


def strongest_rejected(
    pairs: DataFrame, matches: DataFrame, keys: list[str], threshold: float, support_threshold: float
) -> DataFrame:
    """Best pair of every target that stayed unmatched, with the gate it failed."""
    best = pairs.groupBy(*keys, "target_id").agg(
        F.max_by(
            F.struct("track_id", "score", "support"),
            F.struct(F.col("score"), F.col("support"), -F.col("track_id")),
        ).alias("b")
    )
    left = best.join(matches.select(*keys, "target_id"), [*keys, "target_id"], "left_anti")
    reason = (
        F.when(F.col("b.score") < threshold, "centroid_threshold")
        .when(F.col("b.support") < support_threshold, "reference_support")
        .otherwise("margin")
    )
    return left.select(*keys, "target_id", "b.track_id", "b.score", "b.support", reason.alias("reason"))


def confirmation_hits(
    attempts: DataFrame,
    keys: list[str],
    partner: str,
    hits: int,
    max_age: int | None = None,
    frame: str = "frame_index",
) -> DataFrame:
    """Count consecutive attempts of a key that ended with the same partner.

    One row per attempt; a null partner is a failed attempt.  Recovery passes the target
    as key, recognition the track, because that is whose failure clears a pending pair.
    With ``max_age`` a hit that comes too late starts over.
    """
    placed = scan.with_position(attempts, keys, frame, name="_attempt")
    limits = {"_attempt": 1}
    if max_age is not None:
        limits[frame] = max_age
    runs = scan.with_runs(
        placed.where(F.col(partner).isNotNull()), [*keys, partner], order="_attempt", limits=limits
    )
    hit = F.col("_attempt") - F.col("run_start") + 1
    return (
        runs.withColumn("hit", (hit - 1) % hits + 1)
        .withColumn("confirmed", F.col("hit") == hits)
        .drop("_attempt", "run_start", "run_no")
    )


def recovery_candidates(
    tracks: DataFrame, owned: DataFrame, keys: list[str], classes: tuple[int, ...], min_age: int
) -> DataFrame:
    """Visible, old enough tracks that no active target owns."""
    eligible = tracks.where(F.col("class_id").isin(*classes) & (F.col("age") >= min_age))
    return eligible.join(owned.select(*keys), keys, "left_anti")


def recognition_candidates(
    tracks: DataFrame,
    bound: DataFrame,
    protected: DataFrame,
    cooling: DataFrame,
    keys: list[str],
    classes: tuple[int, ...],
    min_age: int,
) -> tuple[DataFrame, Column]:
    """Tracks open for recognition, marked with ``in_cooldown``.

    Returned with the condition that selects the usable ones; the others are the ones to
    count as skipped.
    """
    eligible = (
        tracks.where(F.col("class_id").isin(*classes) & (F.col("age") >= min_age))
        .join(protected.select(*keys), keys, "left_anti")
        .join(bound.select(*keys), keys, "left_anti")
    )
    until = cooling.select(*keys, "retry_until")
    marked = eligible.join(until, keys, "left").withColumn(
        "in_cooldown", F.coalesce(F.col("frame_index") < F.col("retry_until"), F.lit(False))
    )
    return marked, ~F.col("in_cooldown")


def free_identities(identities: DataFrame, bindings: DataFrame) -> DataFrame:
    """Identities that opted in and are not attached to any session target."""
    attached = bindings.select("domain", "identity_id")
    return identities.where("recognition_enabled").join(
        attached, ["domain", "identity_id"], "left_anti"
    )


def plate_conflicts(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs ruled out because both plates are known and differ."""
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))


def binding_outcomes(requests: DataFrame, bindings: DataFrame, identities: DataFrame) -> DataFrame:
    """What attaching a target to an identity would do, without doing it."""
    by_target = bindings.select("domain", "target_id", F.col("identity_id").alias("_bound_identity"))
    by_identity = bindings.select("domain", "identity_id", F.col("target_id").alias("_bound_target"))
    known = identities.select("domain", "identity_id", F.lit(True).alias("_known"))
    joined = (
        requests.join(known, ["domain", "identity_id"], "left")
        .join(by_target, ["domain", "target_id"], "left")
        .join(by_identity, ["domain", "identity_id"], "left")
    )
    outcome = (
        F.when(F.col("_known").isNull(), "unknown")
        .when(F.col("_bound_identity") == F.col("identity_id"), "idempotent")
        .when(F.col("_bound_identity").isNotNull(), "target_conflict")
        .when(F.col("_bound_target").isNotNull(), "identity_conflict")
        .otherwise("ok")
    )
    return joined.withColumn("outcome", outcome).drop("_known", "_bound_identity", "_bound_target")
