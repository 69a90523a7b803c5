"""Stored identities: validation, changes and listings.

A store is three tables: identities, references (several per identity) and snapshots.
Operators take and return DataFrames; ``sources.gallery_store`` gives them files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline.functions import text, vectors as v
from sightline.sources.embeddings import unit_check

KEY = ["domain", "identity_id"]


def with_legacy_columns(identities: DataFrame) -> DataFrame:
    """Fill in what older stores lack: recognition off, no time, no plate."""
    missing = {
        "recognition_enabled": F.lit(False),
        "created_at": F.lit(None).cast("string"),
        "plate_number": F.lit(None).cast("string"),
    }
    for name, value in missing.items():
        if name not in identities.columns:
            identities = identities.withColumn(name, value)
    return identities.withColumn(
        "recognition_enabled", F.coalesce(F.col("recognition_enabled").cast("boolean"), F.lit(False))
    )


def store_violations(identities: DataFrame, refs: DataFrame, dimension: int | None) -> DataFrame:
    """Everything that makes a store unusable, one row per identity and reason."""
    known = identities.select(*KEY)
    orphans = refs.join(known, KEY, "left_anti").select(*KEY, F.lit("orphan_reference").alias("reason"))
    counts = refs.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_n"),
        F.countDistinct("embedding_index").alias("_d"),
        F.min("embedding_index").alias("_lo"),
        F.max("embedding_index").alias("_hi"),
    )
    gaps = counts.where(
        (F.col("_lo") != 0) | (F.col("_hi") != F.col("_n") - 1) | (F.col("_d") != F.col("_n"))
    ).select(*KEY, F.lit("index_not_contiguous").alias("reason"))
    empty = known.join(refs.select(*KEY), KEY, "left_anti").select(*KEY, F.lit("no_references").alias("reason"))
    blank = identities.where(F.col("label").isNull() | (F.trim("label") == "")).select(
        *KEY, F.lit("blank_label").alias("reason")
    )
    bad_ref = unit_check(F.col("embedding"), dimension)
    refs_bad = refs.select(*KEY, F.concat(F.lit("reference_"), bad_ref).alias("reason")).where("reason is not null")
    bad_mid = unit_check(F.col("centroid"), dimension)
    mids_bad = identities.select(*KEY, F.concat(F.lit("centroid_"), bad_mid).alias("reason")).where("reason is not null")
    found = orphans
    for part in (gaps, empty, blank, refs_bad, mids_bad):
        found = found.unionByName(part)
    return found.groupBy(*KEY, "reason").agg(F.count(F.lit(1)).alias("rows"))


def replace_features(
    identities: DataFrame, refs: DataFrame, new_identities: DataFrame, new_refs: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Swap centroid and references of some identities; everything else stays."""
    fresh = new_identities.select(*KEY, F.col("centroid").alias("_centroid"))
    ids = identities.join(fresh, KEY, "left").withColumn("centroid", F.coalesce("_centroid", "centroid"))
    # References for an identity that does not exist are an error of the caller, not rows.
    usable = new_refs.join(identities.select(*KEY), KEY, "left_semi")
    kept = refs.join(new_identities.select(*KEY), KEY, "left_anti")
    return ids.drop("_centroid"), kept.unionByName(usable.select(*refs.columns))


def set_column(identities: DataFrame, updates: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Set one column for the listed identities; also returns the ids that do not exist."""
    wanted = updates.select(*KEY, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    changed = identities.join(wanted, KEY, "left").withColumn(
        column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))
    )
    unknown = updates.join(identities.select(*KEY), KEY, "left_anti").select(*KEY)
    return changed.drop("_new", "_hit"), unknown


def delete(tables: dict[str, DataFrame], requested: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete identities with all their rows; returns what was really there.

    The id allocator is no table here on purpose: deleted numbers are never reused.
    """
    ids = requested.select(*KEY).dropDuplicates(KEY)
    deleted = tables["identities"].select(*KEY).join(ids, KEY, "left_semi")
    left = {name: df.join(ids, KEY, "left_anti") for name, df in tables.items()}
    return left, deleted


def next_ids(identities: DataFrame, meta: DataFrame) -> DataFrame:
    """Next number per domain: the stored one, or one above the largest id if that is more."""
    largest = identities.groupBy("domain").agg((F.max("identity_id") + 1).alias("_above"))
    joined = meta.join(largest, "domain", "full_outer")
    return joined.select("domain", F.greatest("next_id", "_above", F.lit(1)).alias("next_id"))


def allocate(requests: DataFrame, next_id: DataFrame, order: str, buckets: int = 64) -> DataFrame:
    """Give every new request of a domain the following numbers, in order.

    Positions come from per-bucket counts, so a large batch is not numbered in one task.
    ``order`` is a unique whole number.
    """
    from sightline.operators.scan import with_position

    placed = with_position(requests, ["domain"], order, name="_pos", chunk=1 << 14)
    return placed.join(next_id, "domain").withColumn(
        "identity_id", F.col("next_id") + F.col("_pos") - 1
    ).drop("_pos", "next_id")


def enroll(
    requests: DataFrame, bindings: DataFrame, next_id: DataFrame, min_width: int = 0, min_height: int = 0
) -> DataFrame:
    """New identities for targets and imported crops.

    One identity per target whatever the number of requests, none for a target that is
    already bound, none for an imported crop that is too small.  Recognition starts off.
    """
    open_targets = (
        requests.where(F.col("target_id").isNotNull())
        .join(bindings.select("domain", "target_id"), ["domain", "target_id"], "left_anti")
        .groupBy("domain", "target_id")
        .agg(F.min("request_id").alias("request_id"))
    )
    imports = requests.where(
        F.col("target_id").isNull()
        & (F.col("crop_width") >= min_width)
        & (F.col("crop_height") >= min_height)
    ).select("domain", "target_id", "request_id")
    fresh = allocate(open_targets.unionByName(imports), next_id, "request_id")
    return fresh.select(
        "domain",
        "identity_id",
        "request_id",
        "target_id",
        F.concat(F.lit("Target "), text.display_id(F.col("domain"), F.col("identity_id"))).alias("label"),
        F.lit(False).alias("recognition_enabled"),
    )


def save_new(
    identities: DataFrame, incoming: DataFrame, next_id: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Append identities that are really new; numbers used before are refused."""
    judged = incoming.join(next_id, "domain", "left").withColumn(
        "_used", F.coalesce(F.col("identity_id") < F.col("next_id"), F.lit(False))
    )
    accepted = judged.where(~F.col("_used")).select(*incoming.columns)
    refused = judged.where("_used").select(*KEY, F.lit("id_already_used").alias("reason"))
    return identities.unionByName(accepted, allowMissingColumns=True), refused


def listing(identities: DataFrame, refs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Rows of the identity page, people before vehicles, each in id order."""
    counts = refs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("ref_count"))
    marks = snapshots.select(*KEY, F.lit(True).alias("_snap"))
    joined = identities.join(counts, KEY, "left").join(marks, KEY, "left")
    return joined.select(
        *KEY,
        text.display_id(F.col("domain"), F.col("identity_id")).alias("display_id"),
        F.coalesce("_snap", F.lit(False)).alias("has_snapshot"),
        F.coalesce("ref_count", F.lit(0)).alias("ref_count"),
        "plate_number",
        "recognition_enabled",
        "created_at",
    ).orderBy("domain", "identity_id")


def centroids(refs: DataFrame) -> DataFrame:
    return refs.groupBy(*KEY).agg(v.mean_vector(F.col("embedding")).alias("_m")).select(
        *KEY, v.normalized(F.col("_m")).alias("centroid")
    )


def share_embeddings(asks: DataFrame, embeddings: DataFrame, keys: list[str]) -> DataFrame:
    """One embedding per track and frame for all its consumers, never one of another frame.

    ``embeddings`` may hold several rows per crop (a consumer that computed its own); they
    are merged to one before anybody is served, so all consumers see the same vector.
    """
    one = embeddings.groupBy(*keys).agg(F.min("embedding").alias("embedding"))
    return asks.join(one, keys)
