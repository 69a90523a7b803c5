"""The event log as a table, and its export as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline.functions import text
from sightline.operators import eventlog


def append(events: DataFrame, path: str) -> DataFrame:
    """Append the loggable events; returns the rejects."""
    good, bad = eventlog.validate(events)
    good.write.mode("append").parquet(path)
    return bad


def load(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """The newest ``limit`` events, oldest first, whatever limit they were written under."""
    return eventlog.oldest_first(eventlog.newest(spark.read.parquet(path), limit))


def export(log: DataFrame, path: str) -> None:
    """Tab-separated rows in event order under ``path/rows``, title and count beside them.

    One range-sorted file per partition keeps the order without a single writer.
    """
    rows = eventlog.export_rows(log).orderBy("event_id").drop("event_id").toDF(*text.LOG_CAPTIONS)
    rows.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(f"{path}/rows")
    head = log.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(text.LOG_TITLE).alias("title"), F.concat(F.lit("记录数量："), F.col("n").cast("string")).alias("count")
    )
    head.coalesce(1).write.mode("overwrite").option("sep", "\t").csv(f"{path}/head")
