"""The bounded log of identity events, its export and the activity feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sightline.functions import text

DOMAINS = ("person", "vehicle")
EVENT_TYPES = ("recognition", "recovery")


def validate(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Loggable events and rejects with the reason."""
    reason = F.when(~F.coalesce(F.col("domain").isin(*DOMAINS), F.lit(False)), "domain").when(
        ~F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False)), "event_type"
    )
    judged = events.withColumn("reason", reason)
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def newest(log: DataFrame, limit: int) -> DataFrame:
    """The last ``limit`` events: a top-k per partition and a merge, no global sort."""
    return log.orderBy(F.desc("event_id")).limit(limit)


def oldest_first(log: DataFrame) -> DataFrame:
    return log.orderBy("event_id")


def newest_first(log: DataFrame) -> DataFrame:
    return log.orderBy(F.desc("event_id"))


def export_rows(log: DataFrame) -> DataFrame:
    """Rows of the exported list with translated words; columns in file order."""
    dash = F.lit(text.DISPLAY_DASH)
    plate = F.when(F.col("domain") == "person", dash).otherwise(F.coalesce("plate_number", F.lit("NULL")))
    similarity = F.coalesce(F.format_string("%.4f", F.col("similarity")), dash)
    similarity = F.when(F.col("similarity").isNull(), dash).otherwise(similarity)
    return log.select(
        "event_id",
        "event_time",
        text.choose(F.col("domain"), text.LOG_DOMAIN_WORDS).alias("domain_word"),
        "display_id",
        text.choose(F.col("event_type"), text.LOG_EVENT_WORDS, F.col("event_type")).alias("event_word"),
        plate.alias("plate"),
        similarity.alias("similarity"),
        F.coalesce("source_label", dash).alias("source"),
    )


def feed(log: DataFrame, limit: int) -> DataFrame:
    """Newest events of the activity page, each with the number still wanting attention."""
    # The window runs over the limited rows only.
    whole = Window.partitionBy(F.lit(1))
    waiting = F.count_if(~F.col("acknowledged")).over(whole)
    return newest(log, limit).withColumn("unacknowledged", waiting)


def match_events(
    matches: DataFrame,
    bindings: DataFrame,
    plates: DataFrame,
    event_type: str,
    keys: tuple[str, ...] = ("camera_id", "domain", "track_id"),
) -> DataFrame:
    """Log rows of accepted matches; a target without an identity produces none.

    ``matches``: ``keys``, ``target_id``, ``frame_index``, ``score``,
    ``source_label``; ``bindings``: ``domain``, ``target_id``, ``identity_id``; ``plates``
    holds the stable plate of a track, one row per ``keys``.  Only vehicles carry a plate.
    """
    named = matches.join(bindings.select("domain", "target_id", "identity_id"), ["domain", "target_id"])
    known = plates.select(*keys, F.col("plate").alias("_plate"))
    joined = named.join(known, list(keys), "left")
    return joined.select(
        "domain",
        "identity_id",
        text.display_id(F.col("domain"), F.col("identity_id")).alias("display_id"),
        F.lit(event_type).alias("event_type"),
        F.col("score").alias("similarity"),
        "track_id",
        "frame_index",
        "source_label",
        F.when(F.col("domain") == "vehicle", F.col("_plate")).alias("plate_number"),
        F.lit(True).alias("requires_attention"),
    )


def retention(files: DataFrame, keep: int, scope: list[str]) -> DataFrame:
    """Managed recordings beyond the newest ``keep``: a list to delete, nothing is deleted."""
    managed = files.withColumn("_at", text.recording_time(F.col("name"))).where(F.col("_at").isNotNull())
    managed = managed.withColumn("_suffix", text.recording_suffix(F.col("name")))
    newest_last = [F.desc("_at"), F.desc("_suffix"), F.desc("name")]
    # The newest files stay; they are found by a group limit, not by sorting every folder.
    w = Window.partitionBy(*scope).orderBy(*newest_last)
    kept = (
        managed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).select(*scope, "name")
    )
    return managed.join(kept, [*scope, "name"], "left_anti").drop("_at", "_suffix")
