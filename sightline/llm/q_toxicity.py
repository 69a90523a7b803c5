"""op9: toxicity of every document. Tested by held-out quality; SQL cannot express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import toxicity
from sightline.llm.registry import query
from sightline.llm.texts import table


def held_out(doc_id: str = "doc_id"):
    """Rows that teach nothing: every fifth by checksum, and those without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=~held_out())
    found = toxicity.score(docs, model, result="score")
    return found.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
