"""Inputs of the per-camera sessions, and lifecycle questions that need no fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sightline.functions import geometry as g
from sightline.operators import overlap, quality, scan, similarity
from sightline.policy import GuardPolicy, QualityPolicy
from sightline.session import cut_lineage


def session_inputs(
    tracks: DataFrame,
    embeddings: DataFrame,
    frames: DataFrame,
    identities: DataFrame,
    keys: list[str],
    gates: dict[str, QualityPolicy],
    guard: GuardPolicy,
    floor: float,
    accept: Column | None = None,
) -> DataFrame:
    """Everything a session needs to know about a track in a frame, as columns.

    ``tracks``: box, ``conf``, ``class_id``, ``domain``, frame size, ``ts``, ``plate``,
    ``command``; ``embeddings``: one vector per track and frame; ``identities``: the
    opted-in ones with ``centroid`` and ``plate_number``.  ``floor`` is the lowest score
    that can still matter (threshold minus margin).  ``accept`` replaces the quality gate
    by a caller's own condition on the columns of ``tracks``.
    """
    frame = [*keys, "frame_index"]
    one = [*frame, "domain", "track_id"]
    if accept is None:
        judged = quality.assess(tracks, gates, frame)
    else:
        judged = tracks.where(F.col("domain").isin(*gates)).withColumn("reason", F.lit(None).cast("string"))
    # Only crops that passed the gate are ever compared with anything.
    accepted = F.col("reason").isNull() if accept is None else F.coalesce(accept, F.lit(False))
    rows = judged.join(embeddings, one, "left").select(
        *one,
        "ts",
        accepted.alias("accepted"),
        F.when(accepted, F.col("embedding")).alias("embedding"),
        "x1",
        "y1",
        "x2",
        "y2",
        "plate",
        "command",
    )
    # Read twice below: for scoring and for the fold itself.
    rows = cut_lineage(rows)

    boxes = rows.where(g.valid(g.box())).select(*one, "x1", "y1", "x2", "y2")
    partners = overlap.overlap_partners(boxes, [*frame, "domain"], 0.0, guard.max_candidates - 1)
    near = partners.groupBy(*one).agg(
        F.max("ratio").alias("overlap"),
        F.transform(
            F.array_sort(
                F.collect_list(F.when(F.col("ratio") >= guard.overlap_trigger, F.struct("partner_rank", "partner_id")))
            ),
            lambda p: p["partner_id"],
        ).alias("partners"),
    )

    hits = _hits(rows.where(F.col("embedding").isNotNull()), identities, one, floor)
    counts = identities.groupBy("domain").agg(F.count(F.lit(1)).alias("n_identities"))
    rows = (
        rows.join(near, one, "left")
        .join(hits, one, "left")
        .withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    )
    domains = F.explode(F.array(*[F.lit(d) for d in gates]))
    ticks = frames.select(*frame, "ts", domains.alias("domain"))
    columns = ["accepted", "embedding", "x1", "y1", "x2", "y2", "overlap", "partners", "plate", "command"]
    columns += ["hit_ids", "hit_scores", "hit_plates"]
    whole = rows.select(*one, "ts", *columns).unionByName(ticks, allowMissingColumns=True)
    # One row per domain, so this side cannot grow with the data.
    return whole.join(F.broadcast(counts), "domain", "left").withColumn(
        "n_identities", F.coalesce("n_identities", F.lit(0))
    )


def _hits(usable: DataFrame, identities: DataFrame, one: list[str], floor: float) -> DataFrame:
    """Per crop the opted-in identities it resembles at or above ``floor``."""
    targets = identities.select("domain", F.col("identity_id").alias("target_id"), "centroid")
    rest = tuple(c for c in one if c != "domain")
    pairs = similarity.scored_pairs(usable, targets, ["domain"], floor, every=True, ids=rest)
    plates = identities.select("domain", F.col("identity_id").alias("target_id"), F.col("plate_number").alias("plate"))
    found = pairs.join(plates, ["domain", "target_id"]).groupBy(*one).agg(
        F.collect_list(F.struct("target_id", "score", "plate")).alias("h")
    )
    return found.select(
        *one,
        F.col("h.target_id").alias("hit_ids"),
        F.col("h.score").alias("hit_scores"),
        F.col("h.plate").alias("hit_plates"),
    )


def expired_targets(lost: DataFrame, retention: float, horizon: DataFrame, keys: list[str]) -> DataFrame:
    """LOST targets whose retention ran out before anything recovered them.

    ``lost``: ``lost_since``, ``recovered_at`` (null when never); ``horizon``: the last
    processed moment per key.  Recovery runs before the clean-up of a frame, so a recovery
    at the very deadline wins.  A retention of zero keeps targets for ever.
    """
    if retention <= 0:
        return lost.limit(0).withColumn("expires_at", F.col("lost_since"))
    due = lost.withColumn("expires_at", F.col("lost_since") + retention)
    late = F.col("recovered_at").isNull() | (F.col("recovered_at") > F.col("expires_at"))
    return due.where(late).join(horizon, keys).where(F.col("expires_at") <= F.col("horizon")).drop("horizon")


def state_changes(states: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Log lines from consecutive states of a target: lost, recovered, changed pending hits."""
    placed = scan.with_position(states, keys, order, name="_position")
    before = {
        f"_{c}": (lambda c: lambda w: F.lag(c).over(w))(c) for c in ("state", "track_id", "last_track_id", "pending_hits")
    }
    seen = scan.over_last_rows(placed, keys, 1, before, position="_position")
    lost = (F.col("_state") == "ACTIVE") & (F.col("state") == "LOST")
    back = (F.col("_state") == "LOST") & (F.col("state") == "ACTIVE")
    hits = (F.col("pending_hits") > 0) & ~F.col("pending_hits").eqNullSafe(F.col("_pending_hits"))
    event = (
        F.when(lost, "target_lost").when(back, "target_recovered").when(hits, "recovery_pending")
    )
    old = F.when(lost, F.coalesce("_track_id", "_last_track_id")).when(back, F.col("_last_track_id"))
    return (
        seen.withColumn("event", event)
        .withColumn("old_track_id", old)
        .where(F.col("event").isNotNull())
        .select(*keys, order, "event", "old_track_id", "track_id", "pending_hits")
    )
