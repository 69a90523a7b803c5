"""Labelled image sets: XML lists and folders named after their label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline.functions import text


def read_label_xml(spark: SparkSession, path: str, encoding: str = "gb2312") -> tuple[DataFrame, DataFrame]:
    """Usable items and rejects of ``<Item imageName= vehicleID= cameraID=/>`` lists."""
    schema = "_imageName string, _vehicleID string, _cameraID string"
    rows = (
        spark.read.format("xml")
        .option("rowTag", "Item")
        .option("encoding", encoding)
        .schema(schema)
        .load(path)
    )
    return judge_items(
        rows.select(
            F.col("_imageName").alias("image_name"),
            F.col("_vehicleID").alias("vehicle_id"),
            F.nullif(F.col("_cameraID"), F.lit("")).alias("camera_id"),
        )
    )


def judge_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    def given(name: str):
        return F.coalesce(F.col(name) != "", F.lit(False))

    reason = F.when(~given("image_name") | ~given("vehicle_id"), "missing_attribute").when(
        ~text.safe_relative_path(F.col("image_name")), "unsafe_path"
    )
    judged = items.withColumn("reason", reason)
    return judged.where(F.col("reason").isNull()).drop("reason"), judged.where(F.col("reason").isNotNull())


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """Image files below ``root`` labelled by their folder.

    Only names are read: the content column is pruned, so no image is opened.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    )
    return label_paths(files)


def label_paths(files: DataFrame) -> DataFrame:
    """Image paths with their label (the folder) and name; other files drop out."""
    parts = F.split("path", "/")
    return files.where(text.image_suffix_ok(F.col("path"))).select(
        F.element_at(parts, -2).alias("vehicle_id"), F.element_at(parts, -1).alias("image_name"), "path"
    )


def parse_items(lines: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Usable items and rejects of a column with one ``<Item .../>`` text per row."""
    item = F.from_xml(column, "struct<_imageName: string, _vehicleID: string, _cameraID: string>")
    rows = lines.select(item.alias("i")).select(
        F.col("i._imageName").alias("image_name"),
        F.col("i._vehicleID").alias("vehicle_id"),
        F.nullif(F.col("i._cameraID"), F.lit("")).alias("camera_id"),
    )
    return judge_items(rows)
