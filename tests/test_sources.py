"""Files: recorded runs, stores, labels, exports and model hooks."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF, rows
from sightline import policy as pol
from sightline.operators import dumps, eventlog as log_ops, gallery, hooks, lifecycle, plates
from sightline.plans import derived as d, q_store
from sightline.sources import dumps as dump_files, embeddings, eventlog, gallery_store, labels
from sightline.functions import text
from sightline.streaming import batch


def test_dump_round_trip(spark, tmp_path):
    tracks = q_store._numbered(d.tracks(spark, SF).where("camera_id = '0'")).drop("camera_id", "k")
    frames = d.sized(d.frames(spark, SF).where("camera_id = '0'")).drop("camera_id", "c")
    path = str(tmp_path / "run")
    dump_files.write(dump_files.nest(tracks, tracks, frames, ["frame_index"]), dump_files.summary(frames, tracks), path)
    back = dump_files.read(spark, path)
    assert back.count() == frames.count()
    columns = ["frame_index", "track_id", "domain", "x1", "y1", "x2", "y2", "conf"]
    assert rows(dump_files.tracks_of(back, ["frame_index"]).select(columns)) == rows(tracks.select(columns))
    assert dump_files.detections_of(back, ["frame_index"]).count() == tracks.count()
    closing = json.loads(next((tmp_path / "run" / "summary").glob("*.json")).read_text())
    assert closing["type"] == "summary" and closing["frames"] == frames.count()


def test_last_record_of_a_frame_wins(spark, tmp_path):
    lines = [
        {"frame_index": 1, "detections": [], "seq": 1},
        {"frame_index": 1, "detections": [{"bbox": [0, 0, 1, 1], "class": 0, "confidence": 0.5}], "seq": 2},
        {"type": "summary", "frames": 1},
    ]
    (tmp_path / "a.json").write_text("\n".join(json.dumps(x) for x in lines))
    got = dump_files.read(spark, str(tmp_path), with_sequence=True)
    assert [(r.frame_index, len(r.detections)) for r in got.collect()] == [(1, 1)]


def test_divergence_of_a_grown_box(spark):
    schema = "frame_index bigint, det_idx int, class_id int, x1 double, y1 double, x2 double, y2 double, conf double"
    a = spark.createDataFrame([(10, 0, 0, 20.0, 20.0, 100.0, 220.0, 0.9)], schema)
    b = spark.createDataFrame([(10, 0, 0, 20.0, 20.0, 140.0, 220.0, 0.8)], schema)
    pairs = dumps.candidate_pairs(a, b, ["frame_index"], pol.DUMP.match_iou)
    got = dumps.divergence(batch.greedy_pairs(pairs, ["frame_index"], "a_det_idx", "b_det_idx", "iou"), pol.DUMP).first()
    assert got.divergent and "area_grew" in got.reasons and got.area_ratio == pytest.approx(1.5)


def test_blob_codec_rejects_bad_lengths(spark):
    df = spark.createDataFrame([(bytearray(b"abc"),), (bytearray(np.array([1.5, -2], "<f4").tobytes()),)], "b binary")
    assert [r.v for r in df.select(embeddings.decode_blob("b").alias("v")).collect()] == [None, [1.5, -2.0]]


def identity_rows(spark, *ids, domain="person"):
    unit = [1.0] + [0.0] * 7
    ident = spark.createDataFrame(
        [(domain, i, f"Target {i}", unit, False) for i in ids],
        "domain string, identity_id bigint, label string, centroid array<double>, recognition_enabled boolean",
    )
    refs = spark.createDataFrame([(domain, i, 0, unit) for i in ids], "domain string, identity_id bigint, embedding_index bigint, embedding array<double>")
    snaps = spark.createDataFrame([(domain, i, bytearray(b"jpg")) for i in ids], "domain string, identity_id bigint, image binary")
    return ident, refs, snaps


def test_store_versions_deletion_and_numbers(spark, tmp_path):
    path = str(tmp_path / "store")
    ident, refs, snaps = identity_rows(spark, 1, 2, 3)
    meta = spark.createDataFrame([("person", 1)], "domain string, next_id bigint")
    gallery_store.create(spark, path, {"identities": ident, "references": refs, "snapshots": snaps, "meta": meta})
    gone = gallery_store.remove_identities(spark, path, spark.createDataFrame([("person", 3), ("person", 3), ("person", 9)], "domain string, identity_id bigint"))
    assert rows(gone.select("identity_id")) == [(3,)]
    now = gallery_store.load(spark, path)
    assert [now[t].count() for t in ("identities", "references", "snapshots")] == [2, 2, 2]
    assert now["meta"].first()["next_id"] == 4

    refused = gallery_store.add_identities(spark, path, *identity_rows(spark, 3, 4), batch_id=7)
    assert rows(refused.select("identity_id", "reason")) == [(3, "id_already_used")]
    version = gallery_store.current_version(spark, path)
    gallery_store.save(spark, path, gallery_store.load(spark, path), batch_id=7)
    assert gallery_store.current_version(spark, path) == version
    with pytest.raises(RuntimeError, match="somebody else"):
        gallery_store.save(spark, path, gallery_store.load(spark, path), based_on=version - 1)
    assert gallery_store.current_version(spark, path) == version
    now = gallery_store.load(spark, path)
    assert rows(now["identities"].select("identity_id")) == [(1,), (2,), (4,)]
    assert now["identities"].where("recognition_enabled").count() == 0
    assert gallery.store_violations(now["identities"], now["references"], 8).count() == 0


def test_clearing_keeps_the_numbers(spark):
    ident, refs, snaps = identity_rows(spark, 5)
    meta = spark.createDataFrame([("person", 9)], "domain string, next_id bigint")
    assert gallery.next_ids(ident, meta).first()["next_id"] == 9
    assert gallery.next_ids(ident.limit(0), meta).first()["next_id"] == 9


def test_named_export(spark, tmp_path):
    named = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "name string, embedding array<float>")
    embeddings.write_named(named, str(tmp_path / "n"))
    clean, bad = embeddings.read_named(spark, str(tmp_path / "n"), 2)
    assert clean.count() == 2 and bad.count() == 0
    assert embeddings.read_named(spark, str(tmp_path / "n"), 3)[1].count() == 2


def test_label_xml(spark, tmp_path):
    body = '<?xml version="1.0" encoding="gb2312"?><TrainingImages><Items number="4">'
    body += '<Item imageName="a.jpg" vehicleID="1" cameraID="c1"/><Item imageName="b.jpg" vehicleID="1" cameraID=""/>'
    body += '<Item imageName="../x.jpg" vehicleID="2"/><Item imageName="车.jpg" vehicleID="3"/><Item imageName="d.jpg"/>'
    body += "</Items></TrainingImages>"
    (tmp_path / "l.xml").write_bytes(body.encode("gb2312"))
    good, bad = labels.read_label_xml(spark, str(tmp_path / "l.xml"))
    assert rows(good.select("image_name", "vehicle_id"), "image_name") == [("a.jpg", "1"), ("b.jpg", "1"), ("车.jpg", "3")]
    assert good.where("camera_id is null").count() == 2
    assert sorted(r.reason for r in bad.collect()) == ["missing_attribute", "unsafe_path"]


@pytest.mark.parametrize("name, ok", [("a/b.jpg", True), ("/a.jpg", False), ("..\\a.jpg", False), ("a/../b.jpg", False), ("C:\\a.jpg", False), ("a..b.jpg", True), ("", False)])
def test_safe_paths(spark, name, ok):
    assert spark.range(1).select(text.safe_relative_path(F.lit(name)).alias("v")).first()["v"] is ok


def test_image_listing(spark, tmp_path):
    for name in ("car1/a.JPG", "car1/b.png", "car2/c.webp", "car2/notes.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = labels.list_images(spark, str(tmp_path))
    assert rows(got.select("vehicle_id", "image_name")) == [("car1", "a.JPG"), ("car1", "b.png"), ("car2", "c.webp")]
    # Listing must not open the files.
    assert "ReadSchema: struct<path:string>" in got._jdf.queryExecution().explainString(got.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_bounded_log_across_limits(spark, tmp_path):
    path = str(tmp_path / "log")
    events = spark.range(1, 11).select(
        F.col("id").alias("event_id"), F.lit("2024-01-01 00:00:00").alias("event_time"), F.lit("vehicle").alias("domain"), F.col("id").alias("identity_id"), F.lit("recovery").alias("event_type")
    )
    assert eventlog.append(events, path).count() == 0
    kept = eventlog.load(spark, path, 3)
    assert [r.v for r in kept.select(text.display_id(F.col("domain"), F.col("identity_id")).alias("v")).collect()] == ["V008", "V009", "V010"]
    assert eventlog.append(events.withColumn("domain", F.lit("cat")), path).count() == 10


def test_log_export_file(spark, tmp_path):
    log = spark.createDataFrame(
        [(1, "2024-01-01 00:00:00", "person", "P001", "recognition", None, 0.5, None), (2, "2024-01-01 00:00:01", "vehicle", "V002", "recovery", None, None, "cam")],
        "event_id bigint, event_time string, domain string, display_id string, event_type string, plate_number string, similarity double, source_label string",
    )
    eventlog.export(log, str(tmp_path / "x"))
    lines = [l for f in sorted((tmp_path / "x" / "rows").glob("part*")) for l in f.read_text().splitlines()]
    lines = [l for i, l in enumerate(lines) if i == 0 or not l.startswith("时间")]
    assert lines == [
        "时间\t类别\t目标ID\t事件\t车牌号\t相似度\t来源",
        "2024-01-01 00:00:00\t人员\tP001\t识别\t—\t0.5000\t—",
        "2024-01-01 00:00:01\t车辆\tV002\t恢复\tNULL\t—\tcam",
    ]


def test_unbound_targets_emit_nothing(spark):
    m = spark.createDataFrame([("0", "person", 1, 5, 9, 0.9, "c"), ("0", "person", 2, 6, 9, 0.9, "c"), ("1", "vehicle", 4, 5, 9, 0.9, "c")], "camera_id string, domain string, target_id bigint, track_id bigint, frame_index bigint, score double, source_label string")
    b = spark.createDataFrame([("person", 1, 3), ("vehicle", 4, 8)], "domain string, target_id bigint, identity_id bigint")
    # The same track number in two cameras and domains is three tracks.
    plate = [("0", "vehicle", 5, "A"), ("1", "vehicle", 5, "B"), ("1", "person", 5, "C")]
    p = spark.createDataFrame(plate, "camera_id string, domain string, track_id bigint, plate string")
    got = log_ops.match_events(m, b, p, "recognition").collect()
    assert sorted((r.display_id, r.plate_number, r.requires_attention) for r in got) == [("P003", None, True), ("V008", "B", True)]


def readings(spark, *items):
    data = [(1, f, f, p, c, 20, 40, 140, 70, 100.0, 200, 100) for f, p, c in items]
    return spark.createDataFrame(data, "track_id bigint, frame_index bigint, obs_idx bigint, plate string, conf double, x1 int, y1 int, x2 int, y2 int, sharpness double, crop_w int, crop_h int")


def test_one_flipped_character_is_tolerated(spark):
    got = plates.confirmations(readings(spark, (0, "粤B12345", 0.95), (1, "粤B1234S", 0.95), (2, "粤B12345", 0.9)), ["track_id"], pol.PLATE)
    assert [(r.frame_index, r.plate, r.conf) for r in got.collect()] == [(2, "粤B12345", 0.9)]


def test_votes_lapse(spark):
    assert plates.confirmations(readings(spark, (0, "A", 0.9), (31, "A", 0.9)), ["track_id"], pol.PLATE).count() == 0
    assert plates.confirmations(readings(spark, (0, "A", 0.9), (30, "A", 0.9)), ["track_id"], pol.PLATE).count() == 1


def test_provider_hooks(spark):
    crops = spark.createDataFrame([(i, bytearray([i])) for i in range(5)], "id bigint, crop binary")
    got = hooks.extract_embeddings(crops, ["id"], "crop", lambda c: np.array([[x[0], 1.0] for x in c]), batch=2)
    assert rows(got.select("id", F.col("embedding")[0])) == [(i, float(i)) for i in range(5)]

    def provider(crop):
        if crop[0] == 3:
            raise ValueError("blurred")
        return [("A1", 0.9, 1, 2, 3, 4)] * (crop[0] % 2)

    read = hooks.read_plates(crops, ["id"], "crop", provider)
    assert rows(read.select("id", "plate", "error"), "id") == [(1, "A1", None), (3, None, "ValueError: blurred")]


def test_expiry_limits(spark):
    lost = spark.createDataFrame([("a", 1, 0.0, None), ("a", 2, 0.0, 600.0), ("a", 3, 0.0, 600.5), ("a", 4, 1.0, None)], "key string, t bigint, lost_since double, recovered_at double")
    horizon = spark.createDataFrame([("a", 600.5)], "key string, horizon double")
    assert rows(lifecycle.expired_targets(lost, 600.0, horizon, ["key"]).select("t")) == [(1,), (3,)]
    assert lifecycle.expired_targets(lost, 0.0, horizon, ["key"]).count() == 0


def test_retention_spares_other_files(spark):
    names = ["2024-01-01_00-00-00.mp4", "2024-01-01_00-00-00_2.mp4", "2024-01-01_00-00-00_10.mp4", "2024-01-02_00-00-00.mp4", "holiday.mp4", "2024-13-01_00-00-00.mp4"]
    df = spark.createDataFrame([("d", n) for n in names], "folder string, name string")
    assert rows(log_ops.retention(df, 2, ["folder"]).select("name")) == [(names[0],), (names[1],)]


def test_interruption_clears_votes_and_the_plate_of_an_unbound_track(spark):
    data = [(1, e, f, "A", 0.9, 50.0) for e, f in ((1, 0), (2, 5), (2, 6), (3, 20), (3, 21))]
    df = spark.createDataFrame(data, "track_id bigint, track_epoch bigint, frame_index bigint, plate string, conf double, sharpness double")

    def found(bound):
        out = plates.confirmations(df, ["track_id"], pol.PLATE, epoch="track_epoch", bound=bound)
        return sorted((r.track_epoch, r.frame_index) for r in out.collect())

    assert found(None) == [(2, 6), (3, 21)] and found(F.lit(True)) == [(2, 6)]
    assert plates.confirmations(df, ["track_id"], pol.PLATE).first().frame_index == 5


def test_workers_find_the_package_from_any_folder(tmp_path):
    """A session started elsewhere runs queries with Python functions."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = (
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "for name in ('w14_failure_runs', 'u01_embedding_provider'):\n"
        "    name = next(q for q in e.queries() if q.startswith(name.split('_')[0] + '_'))\n"
        "    assert e.queries()[name](spark, '/root/testdata/sf0.001').count() > 0\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
