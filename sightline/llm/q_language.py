"""op10: language of every document. Tested by held-out accuracy; SQL cannot express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import language
from sightline.llm.registry import query
from sightline.llm.texts import table


@query("op10_language")
def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    model = language.fit(docs, learn=~held_out)
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("language")["lang"].alias("lang_pred"),
        F.col("language")["score"].alias("score"),
    )
