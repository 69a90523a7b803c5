"""op3: SimHash components of all documents. Tested by brute force; DuckDB has no XXH64."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import simhash
from sightline.llm.registry import query
from sightline.llm.texts import table


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")
