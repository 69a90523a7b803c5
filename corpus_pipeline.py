"""A training corpus from ``documents``: five stages, each written before the next one reads.

Toxic documents go, of each group of near-duplicates one stays, documents that hold benchmark
passages go, secrets are cut out of the rest, and sources are mixed to their target weights.
Every stage works on all that its predecessor kept; all but the last return the columns of
``documents``, the last one adds the ``shard`` of each copy. Null and empty texts pass the
filters (an empty text is a near-duplicate of every other empty one); the mix counts them as
0 words. Texts go to the Python workers in batches of ``BATCH_BYTES``, as the workers of all
stages live in the same executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import decontaminate, mixing, nearcopies, secrets, toxicity
from sightline.llm.q_toxicity import held_out
from sightline.llm.texts import table
from sightline.session import checkpoint_dir, remove_folder, small_batches


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=~held_out())
    return toxicity.clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id."""
    small_batches(spark)
    return nearcopies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a placeholder and ``n_chars`` counted anew."""
    small_batches(spark)
    words = secrets.dictionary(docs)
    model = secrets.fit(secrets.known_findings(docs, words), words)
    return secrets.redact(docs, model).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes, with their shard, in random order inside it."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: SQL has no trained models; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, keep_stages: bool = False) -> DataFrame:
    """All stages over ``documents``. A stage's table goes once the next one is written; after a failure all go."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    try:
        for k, (name, stage) in enumerate(STAGES):
            path = f"{folder}/{k}-{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if before is not None and not keep_stages:
                remove_folder(spark, before)
            before = path
    except BaseException:
        remove_folder(spark, folder)
        raise
    return docs
