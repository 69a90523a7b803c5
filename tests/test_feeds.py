"""Streams of late results, embeddings, expiry and source reads against their batch forms."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import SF, rows
from sightline import policy as pol
from sightline.operators import gallery, lifecycle, plates
from sightline.plans import derived as d, q_plates
from sightline.sources import reads
from sightline.streaming import feeds, stream
from test_streams import drain

FAR = 18 * 10**14


def in_files(df, path, *conditions):
    for condition in conditions:
        df.where(condition).coalesce(1).write.mode("append").parquet(path)


def timed(df, frame):
    return df.withColumn("event_time", F.timestamp_seconds(F.col(frame) + 1.7e9))


def test_late_results_equal_batch_and_state_shrinks(spark, tmp_path):
    results, states = q_plates.late_results(spark, SF)
    want = rows(plates.stale_reason(results, states, pol.PLATE).select("task_id", "reason"), "task_id")
    left, right = timed(results, "arrive_frame"), timed(states, "frame_index")
    for name, df, frame in (("results", left, "arrive_frame"), ("states", right, "frame_index")):
        far = df.limit(1).withColumn("event_time", F.timestamp_micros(F.lit(FAR))).withColumn("camera_id", F.lit("end"))
        df.write.parquet(str(tmp_path / f"all-{name}"))
        stored = spark.read.parquet(str(tmp_path / f"all-{name}"))
        in_files(stored, str(tmp_path / name), *(F.col(frame).between(a, a + 9) for a in range(0, 60, 10)), F.col(frame) >= 60)
        far.select(stored.columns).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    sources = [stream.table_stream(spark, str(tmp_path / n), df.schema) for n, df in (("results", left), ("states", right))]
    out = str(tmp_path / "out")
    query = stream.write_batches(feeds.stale_reason_stream(*sources, pol.PLATE, delay="5 seconds"), out, str(tmp_path / "checkpoint"))
    query.awaitTermination(300)
    assert query.exception() is None
    got = spark.read.parquet(out).where("camera_id <> 'end'").select("task_id", "reason")
    assert rows(got, "task_id") == want and "track_missing" in {r for _, r in want}
    held = [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    assert max(held) > 10 * max(1, held[-1])


def test_embeddings_once_per_frame(spark, tmp_path):
    keys = ["camera_id", "domain", "frame_index", "track_id"]
    made = d.candidates(d.references(spark, SF)).withColumnRenamed("attempt", "frame_index").select(*keys, "embedding")
    made = timed(made, "frame_index")
    for part in range(3):  # every embedding is delivered three times, in any order
        made.orderBy(F.rand(part)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = stream.table_stream(spark, str(tmp_path / "in"), made.schema)
    out = drain(feeds.embedding_stream(source, keys, "1 hour"), tmp_path, "once")
    got = spark.read.parquet(out)
    asks = made.select(*keys)
    served = gallery.share_embeddings(asks, made.unionByName(made), keys)
    assert got.count() == got.select(*keys).distinct().count()
    assert rows(gallery.share_embeddings(asks, got, keys)) == rows(served) and served.count() > 10


def losses(spark):
    """``target_id, loss_id, change, ts`` of events: errors lose a target, clicks bring it back."""
    ev = d.table(spark, SF, "events").withColumn("ts", d.epoch_micros(F.col("ts")) / 1e6)
    change = F.when(F.col("event_type") == "error", "lost").when(F.col("event_type") == "click", "recovered")
    out = ev.select(F.col("user_id").cast("long").alias("target_id"), F.col("event_id").cast("long").alias("loss_id"), F.coalesce(change, F.lit("other")).alias("change"), "ts")
    return out.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))


@pytest.mark.parametrize("retention, restart", [(86_400.0, False), (86_400.0, True), (0.0, False)])
def test_expiry_by_timers(spark, tmp_path, retention, restart):
    changes = losses(spark)
    changes.write.parquet(str(tmp_path / "all"))
    stored = spark.read.parquet(str(tmp_path / "all"))
    low, high = stored.agg(F.min("ts"), F.max("ts")).first()
    cut = low + (high - low) / 4
    at = F.when(F.col("change") == "recovered", F.col("ts"))
    lost = stored.where("change = 'lost'").select("target_id", "loss_id", F.col("ts").alias("lost_since"))
    back = stored.where(at.isNotNull()).select(F.col("target_id").alias("t"), F.col("ts").alias("back"))
    known = lost.join(back, (F.col("t") == F.col("target_id")) & (F.col("back") > F.col("lost_since")), "left")
    known = known.groupBy("target_id", "loss_id", "lost_since").agg(F.min("back").alias("recovered_at"))
    horizon = lost.select("target_id").distinct().withColumn("horizon", F.lit(high))
    want = rows(lifecycle.expired_targets(known, retention, horizon, ["target_id"]).select("target_id", "loss_id", "expires_at"))

    # Losses of the first quarter that are still open are stored; the stream has the rest.
    early = lost.where(F.col("lost_since") < cut)
    initial = known.where((F.col("lost_since") < cut) & (F.col("recovered_at").isNull() | (F.col("recovered_at") >= cut)))
    gone = rows(lifecycle.expired_targets(known.where(F.col("lost_since") < cut).join(initial, "loss_id", "left_anti"), retention, horizon, ["target_id"]).select("target_id", "loss_id", "expires_at"))
    assert initial.count() and early.count()
    path, middle = str(tmp_path / "in"), (cut + high) / 2
    in_files(stored, path, (F.col("ts") >= cut) & (F.col("ts") < middle))
    source = stream.table_stream(spark, path, stored.schema)
    start = initial.select("target_id", "loss_id", "lost_since")
    if restart:
        drain(feeds.expiry_stream(source, retention, start), tmp_path, "expired")
    in_files(stored, path, F.col("ts") >= middle)
    # No row of a target but the clock: the last moment, the delay and a millisecond behind it.
    clock = stored.limit(1).withColumn("target_id", F.lit(-1).cast("long")).withColumn("change", F.lit("clock"))
    clock = clock.withColumn("ts", F.lit(high + 10.001)).withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
    clock.select(stored.columns).coalesce(1).write.mode("append").parquet(path)
    out = drain(feeds.expiry_stream(source, retention, start), tmp_path, "expired")
    got = rows(spark.read.parquet(out).select("target_id", "loss_id", "expires_at"))
    assert got == [r for r in want if r not in gone]
    assert bool(got) == (retention > 0)


def test_the_very_end_of_a_retention(spark, tmp_path):
    """Expired at the inclusive limit; a recovery in that moment is in time."""
    data = [(1, 1, "lost", 100.0), (2, 2, "lost", 100.0), (2, 2, "recovered", 160.0), (3, 3, "lost", 101.0)]
    df = spark.createDataFrame([(*r[:3], r[3] + 1.7e9) for r in data], "target_id long, loss_id long, change string, ts double")
    clock = spark.createDataFrame([(-1, 0, "clock", 1.7e9 + 170.001)], df.schema)
    for part in (df, clock):
        part.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = stream.table_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    out = drain(feeds.expiry_stream(source, 60.0), tmp_path, "expired")
    assert rows(spark.read.parquet(out).select("target_id", "expires_at")) == [(1, 1.7e9 + 160)]


def test_an_end_row_releases_a_finished_recording(spark, tmp_path):
    gated = q_plates.gated_plates(spark, SF).withColumn("ts", F.col("frame_index") + 1.7e9)
    gated = gated.withColumn("event_time", F.timestamp_seconds("ts")).withColumn("bound", F.col("track_id") % 2 == 0)
    gated.write.parquet(str(tmp_path / "all"))
    stored = spark.read.parquet(str(tmp_path / "all"))
    both = stored.withColumn("end", F.lit(False))
    in_files(both, str(tmp_path / "in"), F.col("frame_index") < 20, F.col("frame_index") >= 20)
    ends = feeds.end_rows(stored, ["camera_id", "domain", "track_id"], ["camera_id"]).withColumn("event_time", F.lit(stored.agg(F.max("event_time")).first()[0]))
    ends.select(both.columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = stream.table_stream(spark, str(tmp_path / "in"), both.schema)
    out = drain(stream.plate_stream(source, pol.PLATE, idle_seconds=1e6), tmp_path, "plates")
    columns = ["camera_id", "track_id", "track_epoch", "frame_index", "plate"]
    want = rows(q_plates.confirmed_plates(spark, SF).select(columns))
    got = spark.read.parquet(out)
    assert want and rows(got.where("not late").select(columns)) == want and got.where("late").count() == 0


def test_source_reads(spark, tmp_path):
    def log(name, *lines):
        with open(tmp_path / f"{name}.jsonl", "a") as file:
            file.writelines(f"{line}\n" for line in lines)

    frames = lambda *n: [json.dumps({"frame": i}) for i in n]
    log("file", *frames(1, 2), '{"eof": true}')
    log("camera", *frames(1), '{"error": "timeout"}', "no json", *frames(2))
    paths = {n: str(tmp_path / f"{n}.jsonl") for n in ("file", "camera", "away")}
    progress, out = str(tmp_path / "progress.json"), str(tmp_path / "out")

    def run():
        query = reads.read_stream(spark, paths, progress).writeStream.foreachBatch(
            lambda df, i: df.write.mode("append").parquet(out)
        ).option("checkpointLocation", str(tmp_path / "checkpoint")).start()
        query.processAllAvailable()
        query.stop()
        found = spark.read.parquet(out).collect()
        return sorted((r.source, -1 if r.number is None else r.number, r.status, r.frame_index or 0) for r in found)

    first = run()
    assert first == [
        ("away", -1, "TEMPORARY_FAILURE", 0),
        ("camera", 0, "FRAME", 1), ("camera", 1, "TEMPORARY_FAILURE", 0), ("camera", 2, "TEMPORARY_FAILURE", 0), ("camera", 3, "FRAME", 2),
        ("file", 0, "FRAME", 1), ("file", 1, "FRAME", 2), ("file", 2, "EOF", 0),
    ]
    # A restart repeats nothing, while one camera is gone and another one is back.
    (tmp_path / "camera.jsonl").rename(tmp_path / "hidden.jsonl")
    log("away", *frames(9))
    second = run()
    assert sorted(set(second) - set(first)) == [("away", 0, "FRAME", 9), ("camera", -1, "TEMPORARY_FAILURE", 0)]
    assert len(second) == len(first) + 2
    (tmp_path / "hidden.jsonl").rename(tmp_path / "camera.jsonl")
    log("camera", *frames(3))
    third = run()
    assert len(third) == len(second) + 1 and ("camera", 4, "FRAME", 3) in third
