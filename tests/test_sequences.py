"""Chunked scans and sequential folds against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sightline import policy as pol
from sightline.operators import scan, sequences
from sightline.streaming import batch


def frames_of(rng, n_keys=4, span=120, share=0.5):
    return [(k, f) for k in range(n_keys) for f in range(span) if rng.random() < share]


def table(spark, data, schema="key bigint, frame_index bigint"):
    return spark.createDataFrame(data, schema).repartition(3)


def loop_runs(data, gap):
    out, last, start, no = [], {}, {}, {}
    for k, f in sorted(data):
        if k not in last or f - last[k] > gap:
            start[k], no[k] = f, no.get(k, 0) + 1
        last[k] = f
        out.append((k, f, start[k], no[k]))
    return out


@pytest.mark.parametrize("chunk", [1, 7, 50, 4096])
@pytest.mark.parametrize("gap", [1, 3])
def test_runs_cross_chunks(spark, chunk, gap):
    data = frames_of(random.Random(chunk * 10 + gap), share=0.6)
    got = scan.with_runs(table(spark, data), ["key"], limits={"frame_index": gap}, chunk=chunk)
    assert rows(got.select("key", "frame_index", "run_start", "run_no"), "key", "frame_index") == loop_runs(data, gap)


@pytest.mark.parametrize("chunk", [3, 64])
def test_positions_totals_and_tails(spark, chunk):
    data = frames_of(random.Random(chunk), share=0.4)
    placed = scan.with_position(table(spark, data), ["key"], "frame_index", chunk=chunk)
    sums = scan.running_totals(
        table(spark, data).withColumn("v", F.col("frame_index")), ["key"], "frame_index", ["v"], chunk=chunk
    )
    tail = {"s": lambda w: F.sum("frame_index").over(w.rowsBetween(-3, 0))}
    last = scan.over_last_rows(placed, ["key"], 3, tail, block=max(4, chunk))
    want_pos, want_sum, want_tail = [], [], []
    for k in range(4):
        mine = sorted(f for kk, f in data if kk == k)
        for i, f in enumerate(mine):
            want_pos.append((k, f, i + 1))
            want_sum.append((k, f, sum(mine[: i + 1])))
            want_tail.append((k, f, sum(mine[max(0, i - 3) : i + 1])))
    assert rows(placed) == want_pos
    assert rows(sums) == want_sum
    assert rows(last.select("key", "frame_index", "s")) == want_tail


def test_age_counts_from_one_and_resets(spark):
    data = [(1, f) for f in (0, 1, 2, 5, 6, 9)]
    got = sequences.track_age(table(spark, data), ["key"])
    assert rows(got.select("frame_index", "age", "epoch")) == [
        (0, 1, 1), (1, 2, 1), (2, 3, 1), (5, 1, 2), (6, 2, 2), (9, 1, 3)
    ]


@pytest.mark.parametrize("gap", [1, 2, 5, 17])
def test_thinning_keeps_greedily(spark, gap):
    data = frames_of(random.Random(gap), share=0.7)
    want = []
    for k in range(4):
        last = None
        for f in sorted(f for kk, f in data if kk == k):
            if last is None or f - last >= gap:
                want.append((k, f))
                last = f
    assert rows(sequences.thin(table(spark, data), ["key"], "frame_index", gap)) == want


def test_fold_state_survives_batches(spark):
    """A key longer than an Arrow batch keeps one state."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        data = [(k, f, 10, 10) for k in range(3) for f in range(40)]
        df = spark.createDataFrame(data, "key bigint, at bigint, w int, h int")
        got = sequences.segments(df, ["key"], "at", ["w", "h"], 15)
        assert rows(got.groupBy("key").agg(F.max("segment"))) == [(0, 3), (1, 3), (2, 3)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_segments_follow_size_and_time(spark):
    data = [(0, 0, 100), (0, 5, 100), (0, 6, 200), (0, 15, 200), (0, 16, 200), (0, 17, 200)]
    df = spark.createDataFrame(data, "key bigint, at bigint, w int")
    got = sequences.segments(df, ["key"], "at", ["w"], 10)
    assert rows(got.select("at", "segment", "segment_start")) == [
        (0, 1, 0), (5, 1, 0), (6, 2, 6), (15, 2, 6), (16, 3, 16), (17, 3, 16)
    ]


def test_lost_after_grace_only(spark):
    frames = spark.createDataFrame([("a", f) for f in range(12)], "camera_id string, frame_index bigint")
    seen = [("a", 1, f) for f in (0, 1, 5, 6)] + [("a", 2, f) for f in (0, 1, 2)] + [("a", 3, f) for f in range(12)]
    tracks = spark.createDataFrame(seen, "camera_id string, track_id bigint, frame_index bigint")
    got = sequences.lost_periods(tracks, frames, ["camera_id"], grace=4)
    # Track 1 is away for three frames only; then it stays away, like track 2.
    assert rows(got.select("track_id", "lost_frame")) == [(1, 10), (2, 6)]


def test_presence_uses_processed_frames(spark):
    frames = spark.createDataFrame([("a", f) for f in (0, 1, 4, 5)], "camera_id string, frame_index bigint")
    tracks = spark.createDataFrame([("a", 7, 1), ("a", 7, 4)], "camera_id string, track_id bigint, frame_index bigint")
    got = sequences.presence_changes(tracks, frames, ["camera_id"])
    assert rows(got.select("frame_index", "created", "ended")) == [(1, 1, 0), (5, 0, 1)]


def test_cooldown_skips_fourteen_frames(spark):
    data = [("t", f, 0, False) for f in range(16)]
    df = spark.createDataFrame(data, "key string, frame_index bigint, gallery_version bigint, matched boolean")
    used = batch.retry_cooldown(df, ["key"], 15).where("attempted")
    assert rows(used.select("frame_index")) == [(0,), (15,)]


def test_cooldown_is_lifted_by_store_change_and_absence(spark):
    data = [("t", 0, 0, False), ("t", 1, 1, False), ("u", 0, 0, False), ("u", 2, 0, False)]
    df = spark.createDataFrame(data, "key string, frame_index bigint, gallery_version bigint, matched boolean")
    assert batch.retry_cooldown(df, ["key"], 15).where("attempted").count() == 4


def test_greedy_pairs_equal_a_loop(spark):
    rng = random.Random(5)
    data = [(f, a, b, rng.choice([0.3, 0.5, 0.5, 0.7, 0.9])) for f in range(20) for a in range(4) for b in range(4) if rng.random() < 0.7]
    df = spark.createDataFrame(data, "frame_index bigint, a bigint, b bigint, iou double")
    want = []
    for f in range(20):
        used_a, used_b = set(), set()
        for s, a, b in sorted([(s, a, b) for ff, a, b, s in data if ff == f], reverse=True):
            if a not in used_a and b not in used_b:
                used_a.add(a)
                used_b.add(b)
                want.append((f, a, b, s))
    assert rows(batch.greedy_pairs(df, ["frame_index"], "a", "b", "iou")) == sorted(want)


def test_suppression_keeps_the_best_per_class(spark):
    data = [
        (0, 0, 0.9, 0.0, 0.0, 10.0, 10.0),
        (0, 0, 0.8, 1.0, 0.0, 11.0, 10.0),
        (0, 2, 0.7, 1.0, 0.0, 11.0, 10.0),
        (0, 0, 0.6, 50.0, 0.0, 60.0, 10.0),
    ]
    df = spark.createDataFrame(data, "frame int, class_id int, score double, x1 double, y1 double, x2 double, y2 double")
    kept = batch.suppress(df, ["frame", "class_id"], [F.desc("score")], 0.5)
    assert rows(kept.select("class_id", "score")) == [(0, 0.6), (0, 0.9), (2, 0.7)]


def test_bank_starts_from_stored_references(spark):
    from dataclasses import replace

    from sightline import policy as pol

    data = [(1, i, True, [1.0, 0.0], True) for i in range(3)]
    data += [(1, 10, True, [0.0, 1.0], False), (1, 11, True, [1.0, 0.0], False), (1, 12, False, [1.0, 0.0], False), (1, 13, True, [-1.0, 0.0], False)]
    df = spark.createDataFrame(data, "key bigint, frame_index bigint, accepted boolean, embedding array<double>, stored boolean")
    policy = replace(pol.PERSON_RECOVERY, bank_size=3, reference_interval=1, reference_update_threshold=0.5)
    got = batch.reference_bank(df, ["key"], policy)
    # The live crop joins the copies without a test and pushes out the oldest.
    assert rows(got.where("not stored").select("frame_index", "outcome", "bank_size")) == [
        (10, "started", 3), (11, "accepted", 3), (12, "rejected_quality", 3), (13, "rejected_likeness", 3)
    ]


def test_reference_turns_are_the_rows_of_the_bank(spark):
    """Turns are known without vectors, so vectors are fetched for a few crops only."""
    rng = random.Random(8)
    data = []
    for key in range(12):
        for frame in sorted(rng.sample(range(400), 150)):
            vector = [rng.choice((1.0, 0.2)), rng.random(), 0.5] if rng.random() < 0.9 else [0.0] * 3
            data.append((key, frame, rng.random() < 0.6, vector, any(vector)))
    df = spark.createDataFrame(data, "key int, frame_index bigint, accepted boolean, embedding array<double>, usable boolean")
    policy = pol.PERSON_RECOVERY
    crops = df.withColumn("able", F.col("accepted") & F.col("usable"))
    turns = batch.reference_turns(crops.drop("embedding", "usable"), ["key"], policy, starts="able").drop("able")
    assert turns.count() < len(data) / 4
    fetched = turns.join(df.select("key", "frame_index", "embedding"), ["key", "frame_index"])
    show = lambda out: rows(out.select("key", "frame_index", "outcome", F.round("likeness", 9).cast("string"), "bank_size"))
    want = show(batch.reference_bank(df.drop("usable"), ["key"], policy))
    assert want and show(batch.reference_bank(fetched, ["key"], policy)) == want


def test_moving_fps_query_divides_as_its_sql(spark, tmp_path):
    """A mean of zero, below zero, or of nothing but nulls."""
    from sightline.plans.catalog import ORACLES, QUERIES
    from sightline.plans.compare import compare, connect

    values = {1: [0.0, 0.0, 40.0], 2: [None, None, 25.0], 3: [-20.0, 5.0, 45.0], 4: [33.0] * 40}
    data = [(100 * u + i, u, v) for u, vs in values.items() for i, v in enumerate(vs)]
    spark.createDataFrame(data, "event_id bigint, user_id bigint, value double").coalesce(1).write.parquet(f"{tmp_path}/made")
    next(tmp_path.glob("made/*.parquet")).rename(tmp_path / "events.parquet")
    assert compare(spark, str(tmp_path), "w13_moving_fps", QUERIES, ORACLES, connect(str(tmp_path)))[0] == "same"


def test_counts_of_a_run_and_what_is_kept_of_it(spark):
    from sightline.operators import dumps

    rng = random.Random(4)
    first = spark.createDataFrame([(rng.randrange(30), rng.randrange(3), rng.random() < 0.7) for _ in range(300)], "frame int, class_id int, kept boolean")
    want = rows(dumps.frame_counts(first, first.where("kept"), ["frame"]))
    assert len(want) == 30 and rows(dumps.kept_counts(first, F.col("kept"), ["frame"])) == want
