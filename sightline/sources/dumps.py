"""Recorded runs as JSON lines: one nested record per frame and a closing summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sightline.functions import geometry as g

_BOX = "bbox array<double>, width double, height double, area double, center array<double>"
_DET = f"array<struct<{_BOX.replace(' array', ': array').replace(' double,', ': double,')}, class: int, confidence: double>>"
_TRK = _DET.replace("class: int", "track_id: bigint, domain: string, class: int")
RECORD = (
    f"frame_index bigint, source_shape array<int>, detections {_DET}, "
    f"tracks struct<person: {_TRK}, vehicle: {_TRK}>, type string"
)


def _box_fields() -> list[Column]:
    b = g.box()
    return [
        F.array(*b).alias("bbox"),
        g.width(b).alias("width"),
        g.height(b).alias("height"),
        g.area(b).alias("area"),
        F.array(g.center_x(b), g.center_y(b)).alias("center"),
    ]


def nest(detections: DataFrame, tracks: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """One record per frame.  A frame holds what one image shows, so its lists stay short."""
    det = detections.groupBy(*keys).agg(
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "det_idx",
                        F.struct(*_box_fields(), F.col("class_id").alias("class"), F.col("conf").alias("confidence")).alias("r"),
                    )
                )
            ),
            lambda x: x["r"],
        ).alias("detections")
    )
    record = F.struct(
        *_box_fields(),
        "track_id",
        "domain",
        F.col("class_id").alias("class"),
        F.col("conf").alias("confidence"),
    )

    def of(domain: str) -> Column:
        items = F.collect_list(F.when(F.col("domain") == domain, F.struct("track_id", record.alias("r"))))
        return F.transform(F.array_sort(items), lambda x: x["r"])

    trk = tracks.groupBy(*keys).agg(of("person").alias("person"), of("vehicle").alias("vehicle"))
    joined = frames.join(det, keys, "left").join(trk, keys, "left")
    return joined.select(
        *keys,
        F.array("frame_height", "frame_width").alias("source_shape"),
        F.coalesce("detections", F.array()).alias("detections"),
        F.struct(
            F.coalesce("person", F.array()).alias("person"), F.coalesce("vehicle", F.array()).alias("vehicle")
        ).alias("tracks"),
    )


def summary(frames: DataFrame, tracks: DataFrame) -> DataFrame:
    """The closing record of a run."""
    seen = frames.select(F.lit("frame").alias("_kind"))
    ids = tracks.select("domain", "track_id").distinct().select(F.col("domain").alias("_kind"))
    counts = seen.unionByName(ids).agg(
        F.count_if(F.col("_kind") == "frame").alias("frames"),
        F.count_if(F.col("_kind") == "person").alias("unique_person_tracks"),
        F.count_if(F.col("_kind") == "vehicle").alias("unique_vehicle_tracks"),
    )
    return counts.select(
        F.lit("summary").alias("type"),
        "frames",
        F.col("frames").alias("yolo_inference_count"),
        "unique_person_tracks",
        "unique_vehicle_tracks",
    )


def write(records: DataFrame, closing: DataFrame, path: str) -> None:
    """Records under ``path/frames``, the summary beside them."""
    records.write.mode("overwrite").json(f"{path}/frames")
    closing.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def last_per_frame(records: DataFrame, keys: list[str], seq: Column | None = None) -> DataFrame:
    """Drop summaries; of several records of a frame the one written last wins.

    Lines of distributed files have no order of their own, so the writer's sequence is
    needed where frames can repeat.
    """
    frames = records.where(F.col("type").isNull() | (F.col("type") != "summary")).drop("type")
    rest = [c for c in frames.columns if c not in keys]
    order = F.lit(0) if seq is None else seq
    last = frames.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def read(spark: SparkSession, path: str, with_sequence: bool = False) -> DataFrame:
    """Records of a run, keyed by frame.  Summary files may be part of ``path``."""
    schema = RECORD + (", seq bigint" if with_sequence else "")
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    return last_per_frame(rows, ["frame_index"], F.col("seq") if with_sequence else None)


def _corner(i: int, item: str, name: str) -> Column:
    return F.col(f"{item}.bbox")[i].alias(name)


def _flat(item: str) -> list[Column]:
    corners = [_corner(i, item, n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]
    return [*corners, F.col(f"{item}.confidence").alias("conf"), F.col(f"{item}.class").alias("class_id")]


def detections_of(records: DataFrame, keys: list[str]) -> DataFrame:
    return records.select(*keys, F.posexplode("detections").alias("det_idx", "d")).select(
        *keys, "det_idx", *_flat("d")
    )


def tracks_of(records: DataFrame, keys: list[str]) -> DataFrame:
    both = F.concat("tracks.person", "tracks.vehicle")
    return records.select(*keys, F.explode(both).alias("t")).select(
        *keys, "t.track_id", "t.domain", *_flat("t")
    )
