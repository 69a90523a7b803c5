"""Run statistics and timing summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def run_stats(frames: DataFrame, tracks: DataFrame, scope: list[str]) -> DataFrame:
    """Processed frames (one inference each) and distinct tracks per domain."""
    n = frames.groupBy(*scope).agg(F.count(F.lit(1)).alias("frames"))
    ids = tracks.select(*scope, "domain", "track_id").distinct().groupBy(*scope).agg(
        F.count_if(F.col("domain") == "person").alias("unique_person_tracks"),
        F.count_if(F.col("domain") == "vehicle").alias("unique_vehicle_tracks"),
    )
    joined = n.join(ids, scope, "left")
    return joined.select(
        *scope,
        "frames",
        F.col("frames").alias("inference_count"),
        F.coalesce("unique_person_tracks", F.lit(0)).alias("unique_person_tracks"),
        F.coalesce("unique_vehicle_tracks", F.lit(0)).alias("unique_vehicle_tracks"),
    )


def track_sketches(tracks: DataFrame, scope: list[str], precision: int = 14) -> DataFrame:
    """A mergeable sketch of the distinct tracks of each part (a run, an hour, ...) and domain.

    A theta sketch keeps up to 2**14 hashes of tracks (128 kB at most, the standard error is 0.8 %).
    Sketches of parts are united by ``united_tracks``, so a total over any parts needs no track a
    second time, and the union of parts is the sketch of all.
    """
    track = F.concat_ws("|", *[F.col(c).cast("string") for c in tracks.columns if c in ("camera_id", "track_id")])
    return tracks.groupBy(*scope, "domain").agg(F.theta_sketch_agg(track, precision).alias("sketch"))


def united_tracks(sketches: DataFrame, scope: list[str], precision: int = 14) -> DataFrame:
    """Estimated distinct tracks by domain over all parts of a scope, and the united sketch."""
    united = sketches.groupBy(*scope, "domain").agg(F.theta_union_agg("sketch", precision).alias("sketch"))
    return united.withColumn("unique_tracks", F.theta_sketch_estimate("sketch"))


def recent_unique_tracks(tracks: DataFrame, scope: list[str], order: str, window: int) -> DataFrame:
    """Distinct tracks among the last ``window`` observations of a scope.

    ``order`` is a whole number.  Counts per stretch of it tell which stretches can hold
    the last observations; only their rows are ranked, however long the scope is.
    """
    cut = tracks.withColumn("_c", F.floor(F.col(order) / window))
    counts = cut.groupBy(*scope, "_c").agg(F.count(F.lit(1)).alias("_n"))
    after = Window.partitionBy(*scope).orderBy(F.desc("_c")).rowsBetween(Window.unboundedPreceding, -1)
    tail = counts.withColumn("_later", F.coalesce(F.sum("_n").over(after), F.lit(0)))
    tail = tail.where(F.col("_later") < window).select(*scope, "_c")
    rank = Window.partitionBy(*scope).orderBy(F.desc(order))
    recent = (
        cut.join(tail, [*scope, "_c"]).withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= window)
    )
    return recent.groupBy(*scope).agg(F.countDistinct("track_id").alias("unique_tracks"))


def _mean_ms(total: Column, n: Column) -> Column:
    return F.when(n > 0, total * 1000.0 / n).otherwise(0.0)


def summary(stats: DataFrame, scope: list[str]) -> DataFrame:
    """Totals and conditional means of frame statistics, safe for empty denominators.

    ``stats``: ``frame_seconds``, ``tracking_seconds``, ``recovery_due``,
    ``recovery_candidates``, ``sweep_started``, ``sweep_completed``, ``sweep_candidates``,
    ``sweep_processed``, ``sweep_frames``, ``sweep_reid_ms``, ``retry_skipped``.  Negative
    numbers count as zero; sweep sizes count on the frame that starts the sweep, its
    length and model time on the frame that completes it.
    """

    def positive(name: str) -> Column:
        return F.greatest(F.lit(0), F.col(name))

    def only(flag: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col(flag), value)), F.lit(0))

    frame = F.greatest(F.lit(0.0), F.col("frame_seconds"))
    due = F.col("recovery_due")
    n = F.count(F.lit(1))
    total = F.sum(frame)
    return stats.groupBy(*scope).agg(
        n.alias("frames"),
        F.when(total > 0.0, n / total).otherwise(0.0).alias("average_fps"),
        _mean_ms(total, n).alias("frame_total_ms"),
        _mean_ms(F.sum(F.greatest(F.lit(0.0), F.col("tracking_seconds"))), n).alias("tracking_ms"),
        _mean_ms(F.sum(F.when(~due, frame)), F.count_if(~due)).alias("normal_frame_ms"),
        _mean_ms(F.sum(F.when(due, frame)), F.count_if(due)).alias("recovery_frame_ms"),
        (F.coalesce(F.max(F.when(due, frame)), F.lit(0.0)) * 1000.0).alias("recovery_frame_max_ms"),
        only("recovery_due", positive("recovery_candidates")).alias("recovery_candidate_count"),
        F.count_if("sweep_started").alias("sweep_started_count"),
        F.count_if("sweep_completed").alias("sweep_completed_count"),
        only("sweep_started", positive("sweep_candidates")).alias("sweep_candidate_total"),
        F.sum(positive("sweep_processed")).alias("sweep_processed_total"),
        only("sweep_completed", positive("sweep_frames")).alias("sweep_frame_total"),
        only("sweep_completed", F.greatest(F.lit(0.0), F.col("sweep_reid_ms"))).alias("sweep_reid_total_ms"),
        F.sum(positive("retry_skipped")).alias("retry_skipped_total"),
    )


def timing_report(samples: DataFrame, keys: list[str], ms: str) -> DataFrame:
    """avg / min / p50 / p95 / max per stage and the rate it allows.

    Equal samples are counted first, before the shuffle; the percentile is exact and works
    on counts.
    """
    counted = samples.withColumn("_ms", F.col(ms).cast("double")).groupBy(*keys, "_ms").agg(
        F.count(F.lit(1)).alias("_n")
    )
    q = F.expr("percentile(_ms, array(0.5, 0.95), _n)")
    mean = F.sum(F.col("_ms") * F.col("_n")) / F.sum("_n")
    stats = counted.groupBy(*keys).agg(
        F.sum("_n").alias("samples"),
        mean.alias("avg_ms"),
        F.min("_ms").alias("min_ms"),
        q.alias("_q"),
        F.max("_ms").alias("max_ms"),
    )
    return stats.select(
        *keys,
        "samples",
        "avg_ms",
        "min_ms",
        F.col("_q")[0].alias("p50_ms"),
        F.col("_q")[1].alias("p95_ms"),
        "max_ms",
        F.when(F.col("avg_ms") > 0.0, 1000.0 / F.col("avg_ms")).otherwise(0.0).alias("fps"),
    )


def target_changes(starts: DataFrame, lost: DataFrame, keys: list[str]) -> DataFrame:
    """Changes of the active and lost counts per frame and domain."""
    up = starts.select(*keys, "domain", F.lit(1).alias("active"), F.lit(0).alias("lost"))
    down = lost.select(*keys, "domain", F.lit(-1).alias("active"), F.lit(1).alias("lost"))
    changes = up.unionByName(down)

    def total(domain: str, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("domain") == domain, F.col(column))), F.lit(0))

    return changes.groupBy(*keys).agg(
        total("person", "active").alias("person_active"),
        total("person", "lost").alias("person_lost"),
        total("vehicle", "active").alias("vehicle_active"),
        total("vehicle", "lost").alias("vehicle_lost"),
    )
