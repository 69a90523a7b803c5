"""op5: secrets in every document. Tested by held-out findings; SQL cannot express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import secrets
from sightline.llm.registry import query
from sightline.llm.texts import table


@query("op5_secrets")
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    words = secrets.dictionary(docs)
    model = secrets.fit(secrets.known_findings(docs, words), words)
    found = secrets.scan(docs, model)
    s = F.col("secrets")
    return found.select(
        "doc_id",
        s["candidates"].alias("n_candidates"),
        s["secrets"].alias("n_secrets"),
        F.filter(s["spans"], lambda x: x["probability"] >= 0.5).alias("spans"),
        F.sha2(s["redacted"], 256).alias("redacted_sha256"),
    )
