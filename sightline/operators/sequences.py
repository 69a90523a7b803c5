"""Runs, ages, bounded histories and thinning along the frames of a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline.functions import geometry as g
from sightline.operators import jumps, scan
from sightline.policy import GuardPolicy
from sightline.session import cut_lineage


def track_age(tracks: DataFrame, keys: list[str], frame: str = "frame_index") -> DataFrame:
    """Add ``age`` (frames since the current uninterrupted run began) and ``epoch``."""
    runs = scan.with_runs(tracks, keys, frame)
    return (
        runs.withColumn("age", F.col(frame) - F.col("run_start") + 1)
        .withColumn("epoch", F.col("run_no"))
        .drop("run_start", "run_no")
    )


def _seen(
    tracks: DataFrame, frames: DataFrame, scope: list[str], track: str, frame: str
) -> tuple[DataFrame, DataFrame]:
    """Numbered frames, and the numbered frames of each track.

    Both are read several times below, so these narrow tables are written once instead of
    computing the tracks again for every reader.
    """
    placed = frames.select(*scope, frame)
    numbered = cut_lineage(scan.with_position(placed, scope, frame, name="_pos"))
    return numbered, cut_lineage(tracks.select(*scope, track, frame).join(numbered, [*scope, frame]))


def presence_changes(
    tracks: DataFrame, frames: DataFrame, scope: list[str], track: str = "track_id", frame: str = "frame_index"
) -> DataFrame:
    """Tracks created and ended per processed frame.

    Frames are numbered per scope, so that a frame nobody saw (not in ``frames``) does not
    interrupt a track while a processed frame without it does.
    """
    numbered, seen = _seen(tracks, frames, scope, track, frame)
    runs = scan.with_runs(seen, [*scope, track], "_pos").groupBy(*scope, track, "run_start").agg(
        F.max("_pos").alias("_last")
    )
    starts = runs.select(*scope, F.col("run_start").alias("_pos"), F.lit(1).alias("_c"), F.lit(0).alias("_e"))
    ends = runs.select(*scope, (F.col("_last") + 1).alias("_pos"), F.lit(0).alias("_c"), F.lit(1).alias("_e"))
    changes = starts.unionByName(ends).groupBy(*scope, "_pos").agg(
        F.sum("_c").alias("created"), F.sum("_e").alias("ended")
    )
    # An end after the last processed frame was never observed; the join drops it.
    return changes.join(numbered, [*scope, "_pos"]).select(*scope, frame, "created", "ended")


def lost_periods(
    tracks: DataFrame,
    frames: DataFrame,
    scope: list[str],
    grace: int,
    track: str = "track_id",
    frame: str = "frame_index",
) -> DataFrame:
    """When targets bound to a fixed track turn LOST.

    A target turns LOST on the ``grace``-th processed frame without its track; coming
    back earlier keeps it ACTIVE.  With a fixed binding there is one such moment at most:
    a LOST target stays lost until something rebinds it.
    """
    numbered, seen = _seen(tracks, frames, scope, track, frame)
    last = numbered.groupBy(*scope).agg(F.max("_pos").alias("_end"))
    runs = (
        scan.with_runs(seen, [*scope, track], "_pos", limits={"_pos": grace})
        .groupBy(*scope, track, "run_no")
        .agg(F.max("_pos").alias("_last"))
        .where(F.col("run_no") == 1)
        .join(last, scope)
        .where(F.col("_last") + grace <= F.col("_end"))
        .withColumn("_pos", F.col("_last") + grace)
    )
    return runs.join(numbered, [*scope, "_pos"]).select(*scope, track, F.col(frame).alias("lost_frame"))


def geometry_history(
    boxes: DataFrame, keys: list[str], policy: GuardPolicy, frame: str = "frame_index"
) -> DataFrame:
    """Medians of the last accepted boxes and the anomaly flags against them."""
    b = g.box()
    measured = boxes.select(
        "*",
        g.width(b).alias("_w"),
        g.area(b).alias("_a"),
        g.center_x(b).alias("_x"),
        g.center_y(b).alias("_y"),
        F.hypot(g.width(b), g.height(b)).alias("_d"),
    )
    placed = scan.with_position(measured, keys, frame, name="_position")

    def median_of(name: str):
        return lambda w: F.percentile(name, F.lit(0.5)).over(w.rowsBetween(-policy.history, -1))

    names = {f"median{n}": median_of(n) for n in ("_w", "_a", "_x", "_y", "_d")}
    known = scan.over_last_rows(placed, keys, policy.history, names, position="_position")
    floor = F.lit(1e-6)
    width_ratio = F.col("_w") / F.greatest("median_w", floor)
    area_ratio = F.col("_a") / F.greatest("median_a", floor)
    shift = F.hypot(F.col("_x") - F.col("median_x"), F.col("_y") - F.col("median_y")) / F.greatest("median_d", floor)
    has = F.col("median_w").isNotNull()
    return known.select(
        *boxes.columns,
        F.when(has, width_ratio).otherwise(1.0).alias("width_ratio"),
        F.when(has, area_ratio).otherwise(1.0).alias("area_ratio"),
        F.when(has, shift).otherwise(0.0).alias("center_shift"),
    )


def anomalies(measured: DataFrame, policy: GuardPolicy) -> DataFrame:
    """Boxes that changed too much against their history."""
    flags = (
        (F.col("width_ratio") > policy.max_width_growth)
        | (F.col("area_ratio") > policy.max_area_growth)
        | (F.col("center_shift") > policy.max_center_shift)
    )
    return measured.withColumn("anomalous", F.lit(True) if policy.overlap_alone else flags)


def key_changes(pdf: pd.DataFrame, keys: list[str], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Row numbers at which another key begins, given the key of the row before the batch."""
    marks = np.zeros(len(pdf), dtype=bool)
    for key in keys:
        column = pdf[key].to_numpy()
        marks[1:] |= column[1:] != column[:-1]
    marks[0] = last is None or tuple(pdf[keys].iloc[0]) != last
    return marks, tuple(pdf[keys].iloc[-1])


def row_fold(
    df: DataFrame, keys: list[str], order: list, inputs: list[str], start, step, added: str
) -> DataFrame:
    """Sequential fold per key with one result per row, for rows sorted by ``order``.

    The rows of a key arrive in one task, sorted by Spark (which spills) and streamed in
    Arrow batches, so a long key costs time but never memory: only ``start()``'s state is
    kept.  ``step(state, *inputs)`` changes the state and returns the added values, or
    None to drop the row.
    """
    names = [part.split()[0] for part in added.split(", ")]
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", " + added

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            marks, last = key_changes(pdf, keys, last)
            rows = zip(marks.tolist(), *[pdf[c].tolist() for c in inputs])
            results, kept = [], []
            for i, (fresh, *values) in enumerate(rows):
                if fresh:
                    state = start()
                result = step(state, *values)
                if result is not None:
                    results.append(result)
                    kept.append(i)
            if not results:
                continue
            out = pdf.iloc[kept].reset_index(drop=True)
            for name, column in zip(names, zip(*results)):
                out[name] = column
            yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def thin(df: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """Keep the first row of a key and then every row at least ``gap`` after the last kept.

    Of rows with equal times one can stay. Marks are found by chunks (``jumps``), so a long key is
    spread over tasks.
    """
    kept = jumps.marks(df, keys, at, gap)
    on = F.lit(True)
    for c in [*keys, at]:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}"))
    return df.alias("r").join(kept.alias("m"), on, "left_semi").dropDuplicates([*keys, at])


def segments(
    frames: DataFrame, keys: list[str], at: str, size: list[str], duration: int, ties: list[str] | None = None
) -> DataFrame:
    """Number the recording segments of a source.

    A new one starts with the first frame, with another frame size, and once the time
    since the segment began reaches ``duration``.

    A change of size starts a segment whatever came before, so it cuts a source into pieces;
    inside a piece the starts are marks (``jumps``). No step needs a source in one task.
    """
    placed = scan.with_position(frames, keys, at, ties, name="_position")
    dims = F.struct(*size)
    before = {"_before": lambda w: F.lag(dims).over(w)}
    placed = scan.over_last_rows(placed, keys, 1, before, position="_position")
    changed = F.col("_before").isNull() | ~dims.eqNullSafe(F.col("_before"))
    placed = placed.withColumn("_changed", changed.cast("long"))
    pieces = cut_lineage(scan.running(placed, keys, "_position", {"_piece": F.col("_changed")}).drop("_before", "_changed"))
    starts = jumps.marks(pieces, [*keys, "_piece"], at, duration)
    on = F.lit(True)
    for c in [*keys, "_piece", at]:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}"))
    # Of several frames in the moment of a start the first one starts.
    moment = [*(F.col(f"r.{c}") for c in [*keys, "_piece", at])]
    first = F.min("r._position").over(Window.partitionBy(*moment)) == F.col("r._position")
    starting = F.col(f"m.{at}").isNotNull() & first
    marked = pieces.alias("r").join(starts.alias("m"), on, "left").select("r.*", F.when(starting, F.col(f"r.{at}")).alias("_start"))
    number = F.col("_start").isNotNull().cast("long")
    numbered = scan.running(marked, keys, "_position", {"segment": number}, {"segment_start": F.col("_start")})
    return numbered.drop("_position", "_piece", "_start")


def name_suffix(starts: DataFrame, keys: list[str], second: str, order: list[str]) -> DataFrame:
    """Running number of the names that fall into the same second; the first has none.

    The first column of ``order`` is a whole number: names are numbered by stretches of it, so that
    a second with very many names is spread over tasks.
    """
    placed = scan.with_position(starts, [*keys, second], order[0], order[1:], name="suffix")
    return placed.withColumn("suffix", F.col("suffix") - 1)


def moving_mean(times: DataFrame, keys: list[str], frame: str, seconds: str, n: int, name: str = "mean") -> DataFrame:
    """Mean of the last ``n`` frame times as of each frame."""
    placed = scan.with_position(times, keys, frame, name="_position")
    mean = {name: lambda w: F.avg(seconds).over(w.rowsBetween(-(n - 1), Window.currentRow))}
    return scan.over_last_rows(placed, keys, n - 1, mean, position="_position").drop("_position")


def moving_fps(times: DataFrame, keys: list[str], frame: str, seconds: str, n: int) -> DataFrame:
    """Frames per second as the inverse mean of the last ``n`` frame times; zero without a time."""
    known = moving_mean(times, keys, frame, seconds, n, "_mean")
    return known.withColumn("fps", F.when(F.col("_mean") > 0.0, 1.0 / F.col("_mean")).otherwise(0.0)).drop("_mean")


def fifo_bank(refs: DataFrame, keys: list[str], frame: str, item: str, size: int) -> DataFrame:
    """The last ``size`` items of a key as of each row, oldest first."""
    placed = scan.with_position(refs, keys, frame, name="_position")
    bank = {"bank": lambda w: F.collect_list(item).over(w.rowsBetween(-(size - 1), Window.currentRow))}
    return scan.over_last_rows(placed, keys, size - 1, bank, position="_position").drop("_position")


def sweep_batches(candidates: DataFrame, sweep: list[str], budget: int) -> DataFrame:
    """Order of a sweep's candidates and the frame offset in which each is examined."""
    w = Window.partitionBy(*sweep).orderBy("age", "track_id")
    ranked = candidates.withColumn("rank", F.row_number().over(w))
    return ranked.withColumn("batch", F.floor((F.col("rank") - 1) / budget))


def failed_reads(status: DataFrame, keys: list[str], order: str, failed: Column) -> DataFrame:
    """Failed reads with their run, place and whether a later read followed; written once."""
    placed = scan.with_position(status.withColumn("_failed", failed).select(*keys, order, "_failed"), keys, order, name="_position")
    placed = cut_lineage(placed)
    ends = placed.groupBy(*keys).agg(F.max("_position").alias("_end"))
    return cut_lineage(scan.with_runs(placed.where("_failed"), keys, "_position").join(ends, keys))


def failure_runs(reads: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Runs of :func:`failed_reads`: when they began, how long, and whether they ended."""
    runs = reads.groupBy(*keys, "run_no").agg(
        F.min(order).alias("first_failure"),
        F.count(F.lit(1)).alias("failures"),
        (F.max("_position") < F.max("_end")).alias("recovered"),
    )
    return runs.select(*keys, "run_no", "first_failure", "failures", "recovered")


def reconnect_attempts(reads: DataFrame, keys: list[str], order: str, gap: int) -> DataFrame:
    """Reconnects per run of :func:`failed_reads`: the first failed read, then one every ``gap``."""
    runs = reads.select(*keys, F.col("run_no").alias("failure_run"), order)
    tries = thin(runs, [*keys, "failure_run"], order, gap)
    return tries.groupBy(*keys, F.col("failure_run").alias("run_no")).agg(
        F.count(F.lit(1)).alias("reconnect_attempts")
    )


def rotate(ranked: DataFrame, keys: list[str], rank: str, cursor: Column) -> DataFrame:
    """Round-robin order: start at ``cursor`` modulo the number of rows of the key."""
    sizes = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    turn = F.pmod(F.col(rank) - 1 - cursor, F.col("_n"))
    return ranked.join(sizes, keys).withColumn("turn", turn).drop("_n")
