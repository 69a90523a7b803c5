"""The identity store with small changes: a base, and deltas that are merged when it is read.

A change writes what it changes and nothing else: new identities, patches (one value of one column of
an identity), whole reference banks or snapshots that replace older ones, and tombstones. Each delta
has a folder of its own and claims the next number in the list of versions, as in
``gallery_store``: a half-written one is never seen, and of two writers that started from the same
version the second gets an error. A reader takes the newest base and, for each identity, the newest
value of every column and the newest bank since then; ids are never used again, so a tombstone is
final. ``compact`` is a job of its own that writes the merged tables as a new base.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from sightline.operators import gallery
from sightline.operators.gallery import KEY

TABLES = ("identities", "references", "snapshots", "meta")
PATCHED = ("label", "plate_number", "recognition_enabled", "centroid")
_VERSIONS = "version bigint, batch_id bigint, folder string, parts array<string>"


@dataclass
class Log:
    """The versions that make up the current state: a base and the deltas behind it."""

    path: str
    version: int
    base: str | None
    deltas: list[tuple[int, str, list[str]]]
    batches: dict[int, int]

    def of(self, part: str) -> list[tuple[int, str]]:
        return [(v, f"{self.path}/{folder}/{part}") for v, folder, parts in self.deltas if part in parts]


def read_log(spark: SparkSession, path: str) -> Log:
    """The list has a short row for each version since the store was made; compaction ends what must be merged."""
    try:
        listed = spark.read.schema(_VERSIONS).option("recursiveFileLookup", "true").parquet(f"{path}/versions")
        rows = sorted(listed.select("version", "batch_id", "folder", "parts").collect())
    except AnalysisException:
        rows = []
    bases = [r.version for r in rows if "base" in r.parts]
    start = max(bases, default=0)
    base = next((r.folder for r in rows if r.version == start), None)
    deltas = [(r.version, r.folder, list(r.parts)) for r in rows if r.version > start]
    batches = {r.batch_id: r.version for r in rows if r.batch_id >= 0}
    return Log(path, rows[-1].version if rows else 0, base, deltas, batches)


def _write(spark: SparkSession, log: Log, parts: dict[str, DataFrame], batch_id: int, kind: str | None = None) -> int:
    """Writes the parts and claims the version behind the one that ``log`` saw."""
    if batch_id in log.batches and batch_id >= 0:
        return log.batches[batch_id]
    version = log.version + 1
    folder = f"v{version}-{uuid.uuid4().hex[:12]}"
    for name, df in parts.items():
        df.write.parquet(f"{log.path}/{folder}/{name}")
    names = [*parts, *([kind] if kind else [])]
    row = spark.createDataFrame([(version, batch_id, folder, names)], _VERSIONS)
    try:
        row.coalesce(1).write.mode("error").parquet(f"{log.path}/versions/n{version}")
    except AnalysisException as taken:
        raise RuntimeError(f"version {version} was written by somebody else; read again and repeat") from taken
    return version


def create(spark: SparkSession, path: str, tables: dict[str, DataFrame], batch_id: int = -1) -> int:
    return _write(spark, read_log(spark, path), {n: tables[n] for n in TABLES}, batch_id, "base")


def _stack(spark: SparkSession, log: Log, part: str, base: bool) -> DataFrame | None:
    """Rows of a part in the base and the deltas, with their ``_version`` (the base has 0)."""
    places = ([(0, f"{log.path}/{log.base}/{part}")] if base else []) + log.of(part)
    out = None
    for version, place in places:
        df = spark.read.parquet(place).withColumn("_version", F.lit(version))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def _newest(rows: DataFrame, replaced: DataFrame | None) -> DataFrame:
    """Rows of the newest version of their identity; ``replaced`` lists identities and versions."""
    if replaced is None:
        return rows.drop("_version")
    last = replaced.groupBy(*KEY).agg(F.max("_version").alias("_last"))
    kept = rows.join(last, KEY, "left").where(F.col("_version") == F.coalesce("_last", F.lit(0)))
    return kept.drop("_version", "_last")


def load(spark: SparkSession, path: str, log: Log | None = None) -> dict[str, DataFrame]:
    """The four tables as of the newest version (or as of ``log``)."""
    log = log or read_log(spark, path)
    if log.base is None:
        raise FileNotFoundError(f"no identity store in {path}")
    identities = gallery.with_legacy_columns(_stack(spark, log, "identities", True).drop("_version"))
    patches = _stack(spark, log, "patches", False)
    if patches is not None:
        here = [c for c in PATCHED if c in identities.columns and c in patches.columns]
        newest = [F.max_by(F.struct(c), F.when(F.col("column") == c, F.col("_version"))).alias(f"_p_{c}") for c in here]
        found = patches.groupBy(*KEY).agg(*newest)
        merged = identities.join(found, KEY, "left")
        for c in here:
            merged = merged.withColumn(c, F.when(F.col(f"_p_{c}").isNotNull(), F.col(f"_p_{c}")[c]).otherwise(F.col(c)))
        identities = merged.select(*identities.columns)
    references = _newest(_stack(spark, log, "references", True), _stack(spark, log, "banks", False))
    pictures = _stack(spark, log, "snapshots", True)
    taken = pictures.where("_version > 0").select(*KEY, "_version") if log.of("snapshots") else None
    tables = {"identities": identities, "references": references, "snapshots": _newest(pictures, taken)}
    dead = _stack(spark, log, "tombstones", False)
    if dead is not None:
        tables = {n: df.join(dead.select(*KEY).distinct(), KEY, "left_anti") for n, df in tables.items()}
    meta = _stack(spark, log, "meta", True).groupBy("domain").agg(F.max("next_id").alias("next_id"))
    return {**tables, "meta": meta}


def add_identities(
    spark: SparkSession, path: str, identities: DataFrame, references: DataFrame, snapshots: DataFrame, batch_id: int = -1
) -> DataFrame:
    """Stores new identities with their references and snapshots; returns those whose numbers were used before."""
    log = read_log(spark, path)
    old = load(spark, path, log)
    nxt = gallery.next_ids(old["identities"], old["meta"])
    _, refused = gallery.save_new(old["identities"], identities, nxt)
    fresh = identities.join(refused.select(*KEY), KEY, "left_anti")
    keys = fresh.select(*KEY)
    parts = {"identities": fresh, "references": references.join(keys, KEY, "left_semi"), "banks": keys}
    parts |= {"snapshots": snapshots.join(keys, KEY, "left_semi"), "meta": gallery.next_ids(fresh, nxt)}
    _write(spark, log, parts, batch_id)
    return refused


def set_column(spark: SparkSession, path: str, updates: DataFrame, column: str, batch_id: int = -1) -> DataFrame:
    """Sets one column of the listed identities; returns the ids that do not exist. Writes these values only."""
    if column not in PATCHED:
        raise ValueError(f"{column} is not one of {', '.join(PATCHED)}")
    log = read_log(spark, path)
    known = load(spark, path, log)["identities"].select(*KEY)
    patch = updates.join(known, KEY, "left_semi").select(*KEY, F.lit(column).alias("column"), column)
    _write(spark, log, {"patches": patch}, batch_id)
    return updates.join(known, KEY, "left_anti").select(*KEY)


def replace_features(spark: SparkSession, path: str, centroids: DataFrame, references: DataFrame, batch_id: int = -1) -> DataFrame:
    """New centroid and new bank of some identities; returns the ids that do not exist."""
    log = read_log(spark, path)
    known = load(spark, path, log)["identities"].select(*KEY)
    fresh = centroids.join(known, KEY, "left_semi")
    keys = fresh.select(*KEY)
    patch = fresh.select(*KEY, F.lit("centroid").alias("column"), "centroid")
    parts = {"patches": patch, "references": references.join(keys, KEY, "left_semi"), "banks": keys}
    _write(spark, log, parts, batch_id)
    return centroids.join(known, KEY, "left_anti").select(*KEY)


def remove_identities(spark: SparkSession, path: str, requested: DataFrame, batch_id: int = -1) -> DataFrame:
    """Deletes identities with all that belongs to them; the allocator keeps their numbers. Returns what was there."""
    log = read_log(spark, path)
    old = load(spark, path, log)
    dead = requested.select(*KEY).dropDuplicates(KEY).join(old["identities"].select(*KEY), KEY, "left_semi")
    _write(spark, log, {"tombstones": dead, "meta": gallery.next_ids(old["identities"], old["meta"])}, batch_id)
    return dead


def compact(spark: SparkSession, path: str) -> int:
    """Writes the merged tables as a new base. A change that comes in between makes it fail, not vanish."""
    log = read_log(spark, path)
    return _write(spark, log, load(spark, path, log), -1, "base")
