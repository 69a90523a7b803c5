"""Streaming jobs give what their batch forms give."""

import pytest
from pyspark.sql import functions as F

from conftest import SF, rows
from sightline import policy as pol
from sightline.operators import eventlog, plates
from sightline.plans import derived as d, q_plates, q_sessions as q
from sightline.streaming import batch, stream


def drain(df, tmp_path, name):
    out = str(tmp_path / name)
    query = stream.write_batches(df, out, str(tmp_path / f"{name}-checkpoint"))
    query.awaitTermination(240)
    assert query.exception() is None
    return out


def test_session_stream_equals_batch(spark, tmp_path):
    # Real times: the very first watermark is the epoch, and rows at the epoch would be late.
    inputs = q.session_inputs(spark, SF).withColumn("ts", F.col("ts") + 1.7e9)
    inputs = inputs.withColumn("event_time", F.timestamp_micros((F.col("ts") * 1e6).cast("long")))
    inputs.write.parquet(str(tmp_path / "all"))
    stored = spark.read.parquet(str(tmp_path / "all"))
    # Three files in time order, and one far in the future that moves the watermark on.
    for i, (low, high) in enumerate(((0, 12), (12, 24), (24, 99))):
        part = stored.where((F.col("ts") >= 1.7e9 + low) & (F.col("ts") < 1.7e9 + high))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = stored.where("track_id is null").limit(1).withColumn("camera_id", F.lit("end")).withColumn(
        "event_time", F.timestamp_micros(F.lit(18 * 10**14))
    ).withColumn("ts", F.lit(1.8e9))
    late.select(stored.columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    source = stream.table_stream(spark, str(tmp_path / "in"), stored.schema)
    out = drain(stream.session_stream(source, q.OPTIONS), tmp_path, "events")
    columns = ["camera_id", "domain", "frame_index", "event", "target_id", "track_id", "identity_id"]
    got = rows(spark.read.parquet(out).select(columns))
    want = rows(batch.session_events(stored, ["camera_id"], q.OPTIONS).select(columns))
    assert want and got == want


def test_plate_stream_equals_batch(spark, tmp_path):
    gated = q_plates.gated_plates(spark, SF).withColumn("ts", F.col("frame_index") + 1.7e9)
    gated = gated.withColumn("event_time", F.timestamp_seconds("ts")).withColumn("bound", F.col("track_id") % 2 == 0)
    gated.write.parquet(str(tmp_path / "all"))
    stored = spark.read.parquet(str(tmp_path / "all"))
    # Readings of a file come in any order; two come after their time; one moves the watermark on.
    for low, high in ((0, 20), (20, 40), (40, 10**6)):
        part = stored.where((F.col("frame_index") >= low) & (F.col("frame_index") < high))
        part.orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = stored.limit(1).withColumn("camera_id", F.lit("end"))
    end = end.withColumn("ts", F.lit(1.8e9)).withColumn("event_time", F.timestamp_seconds("ts"))
    end.select(stored.columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = stream.table_stream(spark, str(tmp_path / "in"), stored.schema)
    out = drain(stream.plate_stream(source, pol.PLATE, idle_seconds=1e6), tmp_path, "plates")
    columns = ["camera_id", "track_id", "track_epoch", "frame_index", "plate"]
    want = rows(q_plates.confirmed_plates(spark, SF).select(columns))
    got = spark.read.parquet(out)
    assert want and rows(got.where("not late").select(columns)) == want
    assert got.where("late").count() == 0


def test_late_plate_readings_are_reported(spark, tmp_path):
    def write(*frames):
        """Frames, or pairs of a frame and the second in which it was read."""
        timed = [f if isinstance(f, tuple) else (f, f) for f in frames]
        data = [("c", "vehicle", 1, 1, f, t + 1.7e9, "A", 0.9, 50.0, False) for f, t in timed]
        df = spark.createDataFrame(
            data,
            "camera_id string, domain string, track_id bigint, track_epoch bigint, frame_index bigint, ts double, plate string, conf double, sharpness double, bound boolean",
        )
        df.withColumn("event_time", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    write(1, 2)
    write(500)
    write(501)
    write(480, 502)
    write((1, 503), 100)  # a frame that was counted long ago, and one that the watermark drops
    write(900)
    source = stream.table_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    query = stream.write_batches(stream.plate_stream(source, pol.PLATE, delay="30 seconds"), str(tmp_path / "plates"), str(tmp_path / "checkpoint"))
    query.awaitTermination(240)
    got = rows(spark.read.parquet(str(tmp_path / "plates")).select("frame_index", "late"))
    # 480 and 500 come in time and confirm nothing new: the plate is stable since frame 2.
    assert got == [(1, True), (2, False)]
    assert sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]) == 1


def test_repeated_plate_readings_of_a_frame_all_count(spark, tmp_path):
    """Two readings of one track in one frame are two votes, as in the batch form."""
    schema = "camera_id string, domain string, track_id bigint, track_epoch bigint, frame_index bigint, ts double, plate string, conf double, sharpness double, bound boolean"
    frames = [7] * pol.PLATE.hits + [8]
    readings = spark.createDataFrame([("c", "vehicle", 1, 1, f, f + 1.7e9, "A", 0.9, 50.0, False) for f in frames], schema)
    ahead = spark.createDataFrame([("end", "vehicle", 2, 1, f, f + 1.7e9, "B", 0.9, 50.0, False) for f in (900,)], schema)
    for part in (readings, ahead):
        part.withColumn("event_time", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = stream.table_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    out = drain(stream.plate_stream(source, pol.PLATE, idle_seconds=1e6), tmp_path, "plates")
    want = rows(plates.confirmations(readings, ["camera_id", "track_id"], pol.PLATE).select("camera_id", "track_id", "frame_index", "plate"))
    assert want == [("c", 1, 7, "A")]
    assert rows(spark.read.parquet(out).where("not late").select("camera_id", "track_id", "frame_index", "plate")) == want


def test_log_sink_repeats_a_batch_without_doubles(spark, tmp_path):
    log = d.log_events(spark, SF)
    log.repartition(3).write.parquet(str(tmp_path / "in"))
    source = stream.table_stream(spark, str(tmp_path / "in"), log.schema)
    out = str(tmp_path / "log")

    def prepare(df):
        return eventlog.validate(df)[0]

    for attempt in ("a", "b"):  # a second run from scratch overwrites its batches
        done = stream.write_batches(source, out, str(tmp_path / f"checkpoint-{attempt}"), prepare)
        done.awaitTermination(120)
    stored = spark.read.parquet(out)
    assert stored.count() == eventlog.validate(log)[0].count() == stored.select("event_id").distinct().count()


def test_source_status(spark):
    reads = spark.createDataFrame([(True, True), (False, True), (False, False)], "ok boolean, is_camera boolean")
    assert [r.status for r in stream.source_status(reads).collect()] == ["FRAME", "TEMPORARY_FAILURE", "EOF"]
