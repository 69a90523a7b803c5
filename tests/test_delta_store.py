"""The store of small changes against the operators on whole tables; and sketches of distinct tracks."""

import pathlib

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sightline.operators import diagnostics, gallery
from sightline.sources import delta_store as store

KEY = gallery.KEY


def tables(spark, n=40):
    ids = [("person" if i % 2 else "vehicle", i, f"L{i}", None, i % 3 == 0, None, [float(i), 1.0] * 200) for i in range(1, n + 1)]
    schema = "domain string, identity_id bigint, label string, plate_number string, recognition_enabled boolean, created_at string, centroid array<double>"
    identities = spark.createDataFrame(ids, schema)
    references = identities.select(*KEY, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("embedding_index")).withColumn("embedding", F.array(F.lit(1.0)))
    snapshots = identities.where("identity_id % 2 = 0").select(*KEY, F.lit(b"jpg").alias("image"))
    meta = identities.groupBy("domain").agg((F.max("identity_id") + 1).alias("next_id"))
    return {"identities": identities, "references": references, "snapshots": snapshots, "meta": meta}


def ids(spark, *pairs):
    return spark.createDataFrame(list(pairs), "domain string, identity_id bigint")


def size(path, version):
    return sum(f.stat().st_size for d in pathlib.Path(path).glob(f"v{version}-*") for f in d.rglob("*.parquet"))


def same(a, b):
    for name in store.TABLES:
        order = a[name].columns
        assert rows(a[name]) == rows(b[name].select(*order)), name


def test_changes_equal_those_of_whole_tables(spark, tmp_path):
    path, t = str(tmp_path / "s"), tables(spark)
    assert store.create(spark, path, t) == 1
    flags = spark.createDataFrame([("person", 1, True), ("vehicle", 2, True), ("person", 999, True)], "domain string, identity_id bigint, recognition_enabled boolean")
    assert rows(store.set_column(spark, path, flags, "recognition_enabled")) == [("person", 999)]
    plates = spark.createDataFrame([("vehicle", 2, "B1"), ("vehicle", 4, "B2")], "domain string, identity_id bigint, plate_number string")
    store.set_column(spark, path, plates, "plate_number")
    store.set_column(spark, path, plates.withColumn("plate_number", F.when(F.col("identity_id") == 4, None).otherwise("B9")), "plate_number")
    t["identities"], _ = gallery.set_column(t["identities"], flags, "recognition_enabled")
    t["identities"], _ = gallery.set_column(t["identities"], plates.withColumn("plate_number", F.when(F.col("identity_id") == 4, None).otherwise("B9")), "plate_number")

    centroids = spark.createDataFrame([("person", 3, [9.0]), ("person", 999, [9.0])], "domain string, identity_id bigint, centroid array<double>")
    for length in (5, 1):  # the second bank replaces the first one
        bank = ids(spark, ("person", 3), ("person", 999)).withColumn("embedding_index", F.explode(F.sequence(F.lit(0), F.lit(length)))).withColumn("embedding", F.array(F.lit(float(length))))
        assert rows(store.replace_features(spark, path, centroids, bank)) == [("person", 999)]
    t["identities"], t["references"] = gallery.replace_features(t["identities"], t["references"], centroids, bank)

    gone = ids(spark, ("person", 5), ("person", 5), ("vehicle", 40), ("vehicle", 77))
    assert rows(store.remove_identities(spark, path, gone)) == [("person", 5), ("vehicle", 40)]
    data, _ = gallery.delete({n: t[n] for n in ("identities", "references", "snapshots")}, gone)
    t |= data
    same(store.load(spark, path), t)
    # Numbers of deleted identities stay taken, also after compaction.
    assert store.compact(spark, path) == 8
    same(store.load(spark, path), t)
    new = tables(spark, 44)
    new = {n: new[n].where("identity_id >= 40") for n in ("identities", "references", "snapshots")}
    assert rows(store.add_identities(spark, path, *new.values(), batch_id=3).select(*KEY)) == [("vehicle", 40)]
    now = store.load(spark, path)
    assert rows(now["identities"].where("identity_id > 39").select("identity_id")) == [(41,), (42,), (43,), (44,)]
    assert dict(rows(now["meta"])) == {"person": 44, "vehicle": 45}
    # The same batch again changes nothing.
    store.add_identities(spark, path, *new.values(), batch_id=3)
    assert store.read_log(spark, path).version == 9


def test_what_is_written_follows_the_change(spark, tmp_path):
    path, t = str(tmp_path / "s"), tables(spark, 400)
    store.create(spark, path, t)
    flag = ids(spark, ("person", 1)).withColumn("recognition_enabled", F.lit(True))
    store.set_column(spark, path, flag, "recognition_enabled")
    store.remove_identities(spark, path, ids(spark, ("person", 7)))
    assert size(path, 2) < size(path, 1) / 4 and size(path, 3) < size(path, 1) / 4
    assert not list(pathlib.Path(path).glob("v2-*/references"))


def test_two_writers(spark, tmp_path, monkeypatch):
    path, t = str(tmp_path / "s"), tables(spark)
    store.create(spark, path, t)
    seen = store.read_log(spark, path)
    store.remove_identities(spark, path, ids(spark, ("person", 1)))
    monkeypatch.setattr(store, "read_log", lambda spark, path: seen)  # the other writer began before that
    with pytest.raises(RuntimeError, match="version 2"):
        store.remove_identities(spark, path, ids(spark, ("person", 3)))
    with pytest.raises(RuntimeError, match="version 2"):
        store.compact(spark, path)
    monkeypatch.undo()
    assert store.load(spark, path)["identities"].where("identity_id in (1, 3)").count() == 1


def test_no_store(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.load(spark, str(tmp_path))
    with pytest.raises(ValueError, match="created_at"):
        store.set_column(spark, str(tmp_path), None, "created_at")


def test_union_of_sketches_is_the_sketch_of_all(spark):
    tracks = spark.range(400_000).select(
        F.when(F.col("id") % 3 == 0, "person").otherwise("vehicle").alias("domain"), (F.col("id") % 90_001).alias("track_id"), (F.col("id") % 24).alias("hour"), (F.col("id") % 7).alias("run")
    )
    hours = diagnostics.track_sketches(tracks, ["hour"])
    parts = diagnostics.united_tracks(hours, [])
    whole = diagnostics.united_tracks(diagnostics.track_sketches(tracks, []), [])
    steps = diagnostics.united_tracks(hours.withColumn("day", F.col("hour") % 2), ["day"]).drop("unique_tracks")
    runs = diagnostics.united_tracks(diagnostics.track_sketches(tracks, ["run"]), [])
    for other in (whole, runs, diagnostics.united_tracks(steps, [])):
        assert rows(parts.select("domain", "unique_tracks")) == rows(other.select("domain", "unique_tracks"))
    exact = dict(rows(tracks.groupBy("domain").agg(F.countDistinct("track_id"))))
    assert all(abs(n - exact[k]) <= 0.02 * exact[k] for k, n in rows(parts.select("domain", "unique_tracks")))
