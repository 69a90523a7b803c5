"""The identity store as versioned folders of parquet tables.

A change writes a complete new version beside the old one, in a folder nobody else writes,
and then claims its number in the list of versions.  Readers look at the newest listed
version, so a half-written one is never seen; of two writers that started from the same
version the second one gets an error; and a batch that is repeated after a failure is
recognised by its number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from sightline.operators import gallery

TABLES = ("identities", "references", "snapshots", "meta")
_VERSIONS = "version bigint, batch_id bigint, folder string"


def versions(spark: SparkSession, path: str) -> DataFrame:
    try:
        listed = spark.read.schema(_VERSIONS).option("recursiveFileLookup", "true").parquet(f"{path}/versions")
        return listed.select("version", "batch_id", "folder")
    except AnalysisException:
        return spark.createDataFrame([], _VERSIONS)


def current_version(spark: SparkSession, path: str) -> int:
    return int(versions(spark, path).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0])


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of the newest version, with the columns older versions lack."""
    newest = versions(spark, path).agg(F.max_by("folder", "version")).first()[0]
    base = f"{path}/{newest}"
    tables = {name: spark.read.parquet(f"{base}/{name}") for name in TABLES}
    tables["identities"] = gallery.with_legacy_columns(tables["identities"])
    return tables


def save(
    spark: SparkSession, path: str, tables: dict[str, DataFrame], batch_id: int = -1, based_on: int | None = None
) -> int:
    """Write a new version; returns its number, or the existing one for a known batch.

    ``based_on`` is the version the tables were made from; if another one has followed it
    meanwhile, nothing is listed and an error is raised.
    """
    known = versions(spark, path)
    if batch_id >= 0:
        done = known.where(F.col("batch_id") == batch_id).agg(F.max("version")).first()[0]
        if done is not None:
            return int(done)
    version = (current_version(spark, path) if based_on is None else based_on) + 1
    folder = f"v{version}-{uuid.uuid4().hex[:12]}"
    for name in TABLES:
        tables[name].write.parquet(f"{path}/{folder}/{name}")
    row = spark.createDataFrame([(version, batch_id, folder)], _VERSIONS)
    try:
        row.coalesce(1).write.mode("error").parquet(f"{path}/versions/n{version}")
    except AnalysisException as taken:
        raise RuntimeError(f"version {version} was written by somebody else; load again and repeat") from taken
    return version


def add_identities(
    spark: SparkSession,
    path: str,
    identities: DataFrame,
    references: DataFrame,
    snapshots: DataFrame,
    batch_id: int = -1,
) -> DataFrame:
    """Store new identities with references and snapshots in one version.

    Numbers that were ever used are refused; returns the refused ones.
    """
    based_on = current_version(spark, path)
    old = load(spark, path)
    nxt = gallery.next_ids(old["identities"], old["meta"])
    merged, refused = gallery.save_new(old["identities"], identities, nxt)
    fresh = identities.join(refused.select(*gallery.KEY), gallery.KEY, "left_anti").select(*gallery.KEY)

    def of_fresh(df: DataFrame) -> DataFrame:
        return df.join(fresh, gallery.KEY, "left_semi")

    tables = {
        "identities": merged,
        "references": old["references"].unionByName(of_fresh(references)),
        "snapshots": old["snapshots"].unionByName(of_fresh(snapshots)),
        "meta": gallery.next_ids(merged, old["meta"]),
    }
    save(spark, path, tables, batch_id, based_on)
    return refused


def remove_identities(spark: SparkSession, path: str, requested: DataFrame, batch_id: int = -1) -> DataFrame:
    """Delete identities everywhere; the allocator keeps their numbers taken."""
    based_on = current_version(spark, path)
    old = load(spark, path)
    meta = gallery.next_ids(old["identities"], old["meta"])
    data = {name: old[name] for name in ("identities", "references", "snapshots")}
    left, deleted = gallery.delete(data, requested)
    save(spark, path, {**left, "meta": meta}, batch_id, based_on)
    return deleted


def create(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> int:
    return save(spark, path, tables)
