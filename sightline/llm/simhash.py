"""SimHash near-duplicates with one-wildcard segment variants.

A fingerprint is cut into ``max_distance // 2 + 1`` segments; if two differ in at most
``max_distance`` bits, some segment differs in at most one. Each segment is indexed once per
bit with that bit as a wildcard, so segments that differ in one bit (or none) meet in a bucket
of equal (mask, value). Buckets are sorted by Spark and streamed; candidates are verified by
their number of differing bits.

Copies are merged first: one fingerprint is one node. A bucket yields the edges of a spanning
forest of its links, never all pairs. Buckets beyond ``BUCKET`` fingerprints are not worked on
as they are: their free bits are cut and indexed again in the same way (a longer mask) until
they are small or have at most ``FREE_BITS`` free bits, which bounds their size. Segment values
that are so frequent are found by a count that is combined before the shuffle, and their rows
skip the first level, so that no hot bucket is dealt to one task.

Defined results: null and empty texts have fingerprint zero, which links like any other; a
text of fewer words than a shingle is one shingle; repeated rows get the same component; rows
with a null id belong to a component but never name it (it is null if it has no other rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.components import components
from sightline.llm.texts import LOWER, fresh, utf8
from sightline.session import cut_lineage

SHINGLE, MAX_DISTANCE, SEED = 3, 2, 42
BUCKET = 4096
FREE_BITS = 16
#: Buckets up to this size are compared together, larger ones one by one.
SMALL = 48
#: Shingles whose bits are counted at once.
COUNTED = 1 << 16
FULL = (1 << 64) - 1


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the shingles' hashes, as a signed long."""
    import xxhash

    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    digest = xxhash.xxh64_digest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in spans])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(rows), COUNTED):
        ones += np.unpackbits(rows[i : i + COUNTED], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(rows)).tobytes(), "big", signed=True)


def with_fingerprint(docs: DataFrame, *, text: str = "text", shingle: int = SHINGLE, result: str = "fp") -> DataFrame:
    @F.pandas_udf("long")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(t, shingle) for t in batch], dtype="int64")

    return docs.withColumn(result, made(utf8(text)))


def _cut(bits: list[int], distance: int) -> list[list[int]]:
    """Bit positions in ``distance // 2 + 1`` runs of nearly equal length."""
    parts = distance // 2 + 1
    edges = [len(bits) * i // parts for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:]) if b > a]


def masks(fixed: int, distance: int) -> list[int]:
    """Masks one level below a bucket with these fixed bits: one segment but for one bit."""
    free = [i for i in range(64) if not fixed >> i & 1]
    out = []
    for part in _cut(free, distance):
        whole = sum(1 << i for i in part)
        out += [fixed | whole ^ (1 << i) for i in part]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _small_links(fps: np.ndarray, run: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of many short runs at once: (fingerprint, smallest in its component)."""
    left, right = [], []
    at = np.arange(len(fps))
    for shift in range(1, SMALL):
        at = at[: np.searchsorted(at, len(fps) - shift)]
        at = at[run[at] == run[at + shift]]
        if not len(at):
            break
        near = at[np.bitwise_count(fps[at] ^ fps[at + shift]) <= distance]
        left.append(near)
        right.append(near + shift)
    a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (left, right))
    label = np.arange(len(fps))
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(fps))
    return fps[moved], fps[label[moved]]


def _large_links(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of one run, by breadth-first search over what is left."""
    child, root, left = [], [], fps
    while len(left):
        top, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= distance
            if near.any():
                found = left[near]
                child.append(found)
                root.append(np.full(len(found), top))
                queue.extend(found)
                left = left[~near]
    empty = np.empty(0, np.uint64)
    return np.concatenate([empty, *child]), np.concatenate([empty, *root])


class _Runs:
    """Streams rows sorted by (mask, value, fingerprint) and closes each run of equal keys."""

    def __init__(self, distance: int):
        self.distance = distance
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.key: tuple | None = None
        self.size, self.spilling = 0, False

    def _close(self) -> Iterator[tuple]:
        """Links of the held rows, all of one run."""
        if self.held and self.size > 1 and not self.spilling:
            fps = np.unique(np.concatenate([f for _, f in self.held]))
            yield np.zeros(1, np.uint64), *_large_links(fps, self.distance)
        self.held, self.size, self.spilling = [], 0, False

    def _hold(self, mask: np.ndarray, fps: np.ndarray) -> Iterator[tuple]:
        """Keeps rows of the open run, or passes them on for the next level if it is large."""
        self.size += len(fps)
        self.held.append((mask, fps))
        deep = 64 - int(mask[0]).bit_count() <= FREE_BITS
        if not deep and (self.spilling or self.size > BUCKET):
            self.spilling = True
            for m, f in self.held:
                yield m, f, f
            self.held = []

    def feed(self, mask: np.ndarray, fps: np.ndarray) -> Iterator[tuple]:
        value = fps & mask
        new = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
        starts = np.concatenate(([0], new))
        ends = np.concatenate((new, [len(fps)]))
        first = (int(mask[0]), int(value[0]))
        if self.key != first:
            yield from self._close()
        else:
            yield from self._hold(mask[: ends[0]], fps[: ends[0]])
            if len(starts) == 1:
                return
            yield from self._close()
            starts, ends = starts[1:], ends[1:]
        inner_starts, inner_ends = starts[:-1], ends[:-1]  # the last run may go on
        sizes = inner_ends - inner_starts
        small = (sizes > 1) & (sizes <= SMALL)
        if small.any():
            rows = np.repeat(inner_starts[small], sizes[small]) + (
                np.arange(sizes[small].sum()) - np.repeat(np.cumsum(sizes[small]) - sizes[small], sizes[small])
            )
            run = np.repeat(np.flatnonzero(small), sizes[small])
            yield np.zeros(1, np.uint64), *_small_links(fps[rows], run, self.distance)
        for i in np.flatnonzero(sizes > SMALL):
            part = slice(inner_starts[i], inner_ends[i])
            yield from self._hold(mask[part], fps[part])
            yield from self._close()
        self.key = (int(mask[starts[-1]]), int(value[starts[-1]]))
        yield from self._hold(mask[starts[-1] :], fps[starts[-1] :])

    def end(self) -> Iterator[tuple]:
        yield from self._close()


#: mask 0: a link between a and b; else a fingerprint a of a bucket that is too large.
FOUND = "mask long, a long, b long"


def _stream(distance: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(distance)

        def batch(part: tuple) -> pa.RecordBatch:
            mask, a, b = part
            mask = np.broadcast_to(mask, a.shape) if len(mask) != len(a) else mask
            columns = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (mask, a, b)]
            return pa.RecordBatch.from_arrays(columns, ["mask", "a", "b"])

        for rows in batches:
            if rows.num_rows:
                mask, fps = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in rows.columns)
                yield from (batch(p) for p in runs.feed(mask, fps) if len(p[1]))
        yield from (batch(p) for p in runs.end() if len(p[1]))

    return found


def _deeper(distance: int):
    """Rows of large buckets, once per mask of the next level."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for rows in batches:
            mask, fps = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in rows.columns)
            for fixed in np.unique(mask):
                if fixed not in known:
                    known[fixed] = np.array(masks(int(fixed), distance), np.uint64)
                own, below = fps[mask == fixed], known[fixed]
                columns = [np.tile(below, len(own)), np.repeat(own, len(below))]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], ["mask", "fp"])

    return cut


def _hot_segments(nodes: DataFrame, distance: int) -> DataFrame:
    """Level-one buckets (mask, value) that a frequent segment value makes large."""
    parts = [sum(1 << i for i in p) for p in _cut(list(range(64)), distance)]
    split = F.explode(F.array(*(F.lit(_signed(p)) for p in parts)))
    counts = nodes.select("fp", split.alias("segment")).groupBy("segment", F.col("fp").bitwiseAND(F.col("segment")).alias("v")).count()
    hot = counts.where(F.col("count") > BUCKET // 2)
    below = F.explode(F.array(*(F.lit(_signed(m)) for m in masks(0, distance))))
    hot = hot.select("segment", "v", below.alias("mask")).where(F.col("mask").bitwiseAND(F.col("segment")) == F.col("mask"))
    return hot.select("mask", F.col("v").bitwiseAND(F.col("mask")).alias("value")).distinct()


def links(nodes: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``a, b``: edges that connect whatever differs in ``max_distance`` bits or fewer.

    ``nodes`` has one long column ``fp`` of different fingerprints.
    """
    spark = nodes.sparkSession
    one = F.explode(F.array(*(F.lit(_signed(m)) for m in masks(0, max_distance))))
    rows = nodes.select(one.alias("mask"), "fp")
    hot = cut_lineage(_hot_segments(nodes, max_distance))
    deeper = None
    if not hot.isEmpty():
        keyed = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        deeper = keyed.join(hot, ["mask", "value"], "left_semi").select("mask", "fp")
        rows = keyed.join(hot, ["mask", "value"], "left_anti").select("mask", "fp")
    edges = []
    while rows is not None:
        if deeper is not None:
            rows = rows.union(deeper.mapInArrow(_deeper(max_distance), "mask long, fp long"))
        value = F.col("fp").bitwiseAND(F.col("mask"))
        dealt = rows.repartition(_partitions(spark), "mask", value).sortWithinPartitions("mask", value, "fp")
        found = cut_lineage(dealt.mapInArrow(_stream(max_distance), FOUND))
        edges.append(found.where("mask = 0").select("a", "b"))
        large = found.where("mask <> 0").select("mask", F.col("a").alias("fp"))
        if large.isEmpty():
            break
        rows, deeper = large.mapInArrow(_deeper(max_distance), "mask long, fp long"), None
    out = edges[0]
    for more in edges[1:]:
        out = out.union(more)
    return out


def _partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def near_duplicates(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    max_distance: int = MAX_DISTANCE,
) -> DataFrame:
    """``doc_id, fp, component_id``: a row per document, with its fingerprint as a long."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = cut_lineage(with_fingerprint(rows, shingle=shingle).drop("text"))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = cut_lineage(nodes)
    found = components(links(nodes.select("fp"), max_distance), "a", "b")
    members = nodes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left")
    members = cut_lineage(members.select("fp", "first", F.coalesce("root", "fp").alias("root")))
    smallest = cut_lineage(members.groupBy("root").agg(F.min("first").alias("component_id")))
    named = cut_lineage(members.join(smallest, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without near-duplicates: of each group the row with the smallest id stays.

    Of repeated rows with that id one stays; rows without an id stay, as nothing tells them apart.
    """
    groups = near_duplicates(docs.where(F.col(doc_id).isNotNull()), doc_id=doc_id, **options)
    return keep_first(docs, groups, doc_id=doc_id)


def keep_first(docs: DataFrame, groups: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each ``component_id`` of ``groups``, and the rows without an id."""
    name = fresh(docs.columns, "keeper")
    keepers = groups.select(F.col("component_id").alias(name)).distinct()
    kept = docs.join(keepers, F.col(doc_id) == F.col(name), "left_semi")
    once = kept.dropDuplicates([doc_id])
    return once.unionByName(docs.where(F.col(doc_id).isNull()))
