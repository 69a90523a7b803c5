"""op4: expected grade and selection of every document. Tested by held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import quality
from sightline.llm.registry import query
from sightline.llm.texts import table


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    model = quality.fit(docs, table(spark, sf_dir, "labels"), learn=~held_out)
    found = quality.score(docs, model)
    tail = F.col("quality")["tail"]
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("quality")["expected_grade"].alias("expected_grade"),
        tail.alias("probability"),
        F.coalesce(tail >= 0.5, F.lit(True)).alias("selected"),
    )
