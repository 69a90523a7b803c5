"""Embedding files: binary codec, named exports and parity of two exports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from sightline.functions import vectors as v


@pandas_udf(T.ArrayType(T.FloatType()))
def decode_blob(blobs: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to an array; null for a wrong length."""

    def one(blob):
        if blob is None or len(blob) == 0 or len(blob) % 4:
            return None
        return np.frombuffer(blob, dtype="<f4")

    return blobs.map(one)


@pandas_udf(T.BinaryType())
def encode_blob(arrays: pd.Series) -> pd.Series:
    return arrays.map(lambda a: None if a is None else np.asarray(a, dtype="<f4").tobytes())


def unit_check(embedding: Column, dimension: int | None, tolerance: float = 1e-3) -> Column:
    """Why a stored vector is not acceptable; null when it is."""
    reason = F.when(embedding.isNull() | (F.size(embedding) == 0), "missing")
    if dimension is not None:
        reason = reason.when(F.size(embedding) != dimension, "dimension")
    finite = F.forall(v.as_double(embedding), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    # Relative 1e-5 on top of the absolute tolerance, like the usual closeness test.
    return reason.when(~finite, "not_finite").when(
        F.abs(v.norm(embedding) - 1.0) > tolerance + 1e-5, "not_unit"
    )


def write_named(vectors: DataFrame, path: str) -> None:
    vectors.select("name", "embedding").write.mode("overwrite").parquet(path)


def read_named(spark: SparkSession, path: str, dimension: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Clean rows and violations of a named export."""
    rows = spark.read.schema("name string, embedding array<float>").parquet(path)
    return check_named(rows, dimension)


def check_named(rows: DataFrame, dimension: int | None = None) -> tuple[DataFrame, DataFrame]:
    copies = rows.groupBy("name").agg(F.count(F.lit(1)).alias("_copies"))
    judged = rows.join(copies, "name").withColumn(
        "reason",
        F.when(F.col("_copies") > 1, "duplicate_name").otherwise(unit_check(F.col("embedding"), dimension)),
    )
    clean = judged.where(F.col("reason").isNull()).select(*rows.columns)
    return clean, judged.where(F.col("reason").isNotNull()).select("name", "reason")


def parity(
    left: DataFrame, right: DataFrame, group: str, acceptance: float = 0.999, decimals: int | None = None
) -> DataFrame:
    """Agreement of two exports of the same vectors, aligned by name, per ``group``."""
    a = left.select("name", F.col(group), F.col("embedding").alias("_a"), F.lit(True).alias("_in_a"))
    b = right.select("name", F.col("embedding").alias("_b"), F.lit(True).alias("_in_b"))
    s = v.cosine(F.col("_a"), F.col("_b"))
    scored = a.join(b, "name", "full_outer").select(
        F.coalesce(F.col(group), F.lit(-1)).alias(group),
        "_in_a",
        "_in_b",
        F.when(F.col("_in_a") & F.col("_in_b"), s).alias("_s"),
    )

    def shown(c: Column) -> Column:
        return c if decimals is None else F.round(c, decimals)

    return scored.groupBy(group).agg(
        F.count("_s").alias("pairs"),
        F.count_if(F.col("_in_b").isNull()).alias("only_left"),
        F.count_if(F.col("_in_a").isNull()).alias("only_right"),
        shown(F.min("_s")).alias("min_cosine"),
        shown(F.avg("_s")).alias("mean_cosine"),
        shown(F.max("_s")).alias("max_cosine"),
        (F.coalesce(F.min("_s") >= acceptance, F.lit(False)) & (F.count(F.lit(1)) == F.count("_s"))).alias("passed"),
    )
