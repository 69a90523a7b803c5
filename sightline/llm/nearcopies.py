"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts of equal words (ASCII case and spacing aside) are merged first: one word sequence is one
node. Candidates are found in two ways. By SimHash, as in ``simhash``: nodes whose fingerprints
of five-word shingles are linked at ``NEAR_BITS`` or fewer bits (segment variants, verified
links, spanning stars) are a bucket. Near copies of such a similarity may differ in more bits than
segments can tell, so a node has also ``BANDS`` keys, each a hash of ``ROWS`` minima of its
shingles' hashes, and nodes with an equal key are a bucket. A pair at similarity s shares no key
with probability ``(1 - s ** ROWS) ** BANDS``: 3 in a million at 0.8, less above. All pairs of a
bucket are decided by their shingles, unless the two nodes are already in one component; a
fingerprint or a key alone links nothing.

In the first turn one node of a bucket is compared with the others, which is enough for most
groups of copies; buckets within one component are done. In later turns a few nodes (the centres)
leave a bucket; tasks hold their shingles' hashes (64 bits) in an index, let the others stream
past, and hand on the edges of a spanning forest of the links. So a group costs rows by its size,
not its square; a bucket whose centres have more than ``HELD`` shingles is cut into blocks.

Defined results: null and empty texts are one node; a text of fewer words than a shingle is one
shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm import simhash
from sightline.llm.components import components
from sightline.llm.simhash import keep_first
from sightline.llm.texts import LOWER, utf8
from sightline.session import cut_lineage

SHINGLE, SEED = 5, 42
#: Similarity of near copies, as a fraction.
NEAR = (4, 5)
BANDS, ROWS = 32, 5
#: Fingerprints that differ in so many bits are candidates.
NEAR_BITS = 5
#: Nodes of a bucket compared with the others in the second turn, and its growth by turn.
CENTRES, GROWTH = 4096, 8
#: Shingles whose minima are taken at once.
MIXED = 1024
#: Shingles of centres in a task's index, and nodes that one task compares with them.
HELD, PASSED = 1 << 20, 1 << 13
#: Places in the index, and pairs, that are looked at together.
COUNTED = 1 << 20

_MIX = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def _words(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER).split() if text else []


def shingles(text: bytes | None) -> frozenset[tuple[bytes, ...]]:
    """Runs of ``SHINGLE`` words, or all the words of a shorter text."""
    words = _words(text)
    size = min(SHINGLE, len(words))
    return frozenset(zip(*(words[i:] for i in range(size))))


def similar(a: frozenset, b: frozenset) -> bool:
    common = len(a & b)
    return common * NEAR[1] >= (len(a) + len(b) - common) * NEAR[0]


def _digest(words: list[bytes]) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(words))


def _hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of the different shingles, in order."""
    import xxhash

    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(SHINGLE, len(words))
    hashed = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.unique(np.array([hashed(joined[a:b], SEED) for a, b in spans], np.uint64))


def sketch(text: bytes | None) -> tuple[bytes, int, int | None, np.ndarray]:
    """Digest of the words, number of different shingles, fingerprint, and the keys of the bands."""
    import xxhash

    words = _words(text)
    digest = _digest(words)
    if not words:
        return digest, 0, None, np.empty(0, np.int64)
    hashes = _hashes(words)
    least = np.full(len(_MIX), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), MIXED):
        np.minimum(least, (_MIX[:, None] * hashes[None, i : i + MIXED]).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))]
    return digest, len(hashes), simhash.fingerprint(text, SHINGLE), np.array(keys, np.uint64).view(np.int64)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        made = [sketch(t) for t in rows.column(1).to_pylist()]
        offsets = np.cumsum([0, *(len(keys) for *_, keys in made)])
        keys = np.concatenate([np.empty(0, np.int64), *(keys for *_, keys in made)])
        columns = [
            rows.column(0),
            pa.array([d for d, *_ in made], pa.binary()),
            pa.array([n for _, n, *_ in made], pa.int64()),
            pa.array([fp for *_, fp, _ in made], pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys)),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n", "fp", "keys"])


@F.pandas_udf(T.BinaryType())
def _digests(texts: pd.Series) -> pd.Series:
    return pd.Series([_digest(_words(t)) for t in texts], dtype=object)


@F.pandas_udf(T.BooleanType())
def _alike(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    known = lru_cache(maxsize=8)(shingles)
    for left, right in batches:
        yield pd.Series([similar(known(a), known(b)) for a, b in zip(left, right)], dtype=bool)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        made = [_hashes(_words(t)).tobytes() for t in rows.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(made, pa.binary())], ["node", "hashes"])


class _Index:
    """Shingles of a bucket's centres, and the links that are found with them."""

    def __init__(self, key: tuple):
        self.key, self.up = key, {}
        self.roots: list[np.ndarray] = []
        self.sets: list[np.ndarray] = []
        self.places: np.ndarray | None = None

    def _top(self, root: int) -> int:
        while (above := self.up.get(root, root)) != root:
            self.up[root] = self.up.get(above, above)
            root = above
        return root

    def _tops(self, roots: np.ndarray) -> np.ndarray:
        return np.array([self._top(r) for r in roots.tolist()], np.int64)

    def hold(self, roots: np.ndarray, sets: list[np.ndarray]) -> None:
        self.roots.append(roots)
        self.sets += sets

    def close(self) -> Iterator[tuple[int, int]]:
        """No further centres come: links among them."""
        if self.places is None and self.sets:
            self.held = np.concatenate(self.roots)
            self.sizes = np.array([len(s) for s in self.sets])
            places = np.concatenate(self.sets)
            order = np.argsort(places, kind="stable")
            self.places, self.owners = places[order], np.repeat(np.arange(len(self.sets)), self.sizes)[order]
            sets, self.sets = self.sets, []
            yield from self.meet(self.held, sets)

    def meet(self, roots: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """Links of these nodes with the centres that unite two components."""
        if self.places is None:
            return
        sizes = np.array([len(s) for s in sets])
        shingle = np.concatenate(sets)
        row = np.repeat(np.arange(len(sets)), sizes)
        low = np.searchsorted(self.places, shingle, "left")
        found = np.searchsorted(self.places, shingle, "right") - low
        cost = np.cumsum(np.bincount(row, found, len(sets)) + len(self.held))
        i = 0
        while i < len(sets):
            done = cost[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(cost, done + COUNTED, "right")))
            part = slice(int(sizes[:i].sum()), int(sizes[:j].sum()))
            yield from self._unite(roots[i:j], sizes[i:j], row[part] - i, low[part], found[part])
            i = j

    def _unite(self, roots: np.ndarray, sizes: np.ndarray, row: np.ndarray, low: np.ndarray, found: np.ndarray) -> Iterator[tuple[int, int]]:
        at = np.repeat(low - (np.cumsum(found) - found), found) + np.arange(found.sum())
        pair = np.repeat(row, found) * len(self.held) + self.owners[at]
        common = np.bincount(pair, minlength=len(roots) * len(self.held)).reshape(len(roots), -1)
        near = common * NEAR[1] >= (sizes[:, None] + self.sizes[None, :] - common) * NEAR[0]
        left, of_left = np.unique(self._tops(roots), return_inverse=True)
        right, of_right = np.unique(self._tops(self.held), return_inverse=True)
        linked = np.zeros((len(left), len(right)), bool)
        i, j = np.nonzero(near)
        linked[of_left[i], of_right[j]] = True
        for i, j in np.argwhere(linked & (left[:, None] != right[None, :])).tolist():
            a, b = self._top(int(left[i])), self._top(int(right[j]))
            if a != b:
                self.up[max(a, b)] = min(a, b)
                yield min(a, b), max(a, b)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by (bucket, block, part), centres first, and yields links."""
    index = None
    for rows in batches:
        if not rows.num_rows:
            continue
        *key, held, root = (c.to_numpy(zero_copy_only=False) for c in rows.columns[:5])
        sets = [np.frombuffer(h, np.uint64) for h in rows.column(5).to_pylist()]
        change = np.any([np.diff(c.astype(np.int64)) != 0 for c in (*key, held)], axis=0)
        starts = [0, *(np.flatnonzero(change) + 1).tolist()]
        links = []
        for a, b in zip(starts, [*starts[1:], len(sets)]):
            now = tuple(int(c[a]) for c in key)
            if index is None or index.key != now:
                if index is not None:
                    links += index.close()
                index = _Index(now)
            if held[a]:
                index.hold(root[a:b], sets[a:b])
            else:
                links += index.close()
                links += index.meet(root[a:b], sets[a:b])
        yield _edges(links)
    if index is not None:
        yield _edges(list(index.close()))


def _edges(links: list[tuple[int, int]]) -> pa.RecordBatch:
    low, high = zip(*links) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["low", "high"])


def _nodes(rows: DataFrame) -> DataFrame:
    """``node, first, digest, n, fp, keys``: one row per word sequence."""
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("digest", T.BinaryType())])
    schema = schema.add("n", T.LongType()).add("fp", T.LongType()).add("keys", T.ArrayType(T.LongType()))
    made = rows.mapInArrow(_sketched, schema)
    merged = made.groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("keys").alias("keys")
    )
    return cut_lineage(merged.withColumn("node", F.monotonically_increasing_id()))


def _fingerprinted(nodes: DataFrame) -> DataFrame:
    """``bucket, node, n``: buckets that hold every pair of nodes whose fingerprints differ in few bits.

    ``simhash.links`` has a star for each component inside a run of equal segments; two fingerprints
    that differ in few bits are in one of them.
    """
    known = nodes.where(F.col("fp").isNotNull()).select("fp", "node", "n")
    fps = cut_lineage(known.select("fp").distinct())
    stars = simhash.links(fps, NEAR_BITS).select(F.col("b").alias("bucket"), F.col("a").alias("fp")).distinct()
    stars = stars.union(fps.select(F.col("fp").alias("bucket"), "fp"))
    return stars.join(known, "fp").select(F.xxhash64(F.lit("fingerprint"), "bucket").alias("bucket"), "node", "n")


def _mixed(members: DataFrame, turn: int) -> DataFrame:
    """Members of the buckets with more than one component; ``centre`` marks those that this turn compares with the others."""
    rank = F.xxhash64(F.lit(turn), "node")
    order = F.struct((F.col("node") != F.col("root")).alias("late"), rank.alias("rank"), "node")
    buckets = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high"), F.min(order)["node"].alias("lead")
    )
    share = F.lit(float(CENTRES * GROWTH ** (turn - 1) if turn else 0)) / F.col("size")
    drawn = F.pmod(rank, F.lit(1 << 32)) < share * (1 << 32)
    rows = members.join(buckets.where("low <> high").drop("low", "high"), "bucket")
    return cut_lineage(rows.withColumn("centre", (F.col("node") == F.col("lead")) | drawn).drop("size", "lead"))


def _star(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``low, high``: links between components, of the one centre of a bucket with the others."""
    centres = rows.where("centre").select("bucket", F.col("node").alias("c"), F.col("n").alias("m"), F.col("root").alias("own"))
    found = rows.join(centres, "bucket").where("node <> c and root <> own")
    found = found.where(F.least("n", "m") * NEAR[1] >= F.greatest("n", "m") * NEAR[0])
    found = found.select(
        F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"), F.least("root", "own").alias("low"), F.greatest("root", "own").alias("high")
    )
    read = cut_lineage(found.distinct())
    read = read.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
    read = read.join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
    return read.where(_alike("left", "right")).select("low", "high")


def _compared(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``low, high``: links between components that connect all that centres and others of a bucket connect."""
    shingles_held = F.sum(F.when(F.col("centre"), F.col("n")))
    sizes = rows.groupBy("bucket").agg(
        F.greatest(F.lit(1), F.ceil(shingles_held / HELD)).cast("long").alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.count_if(~F.col("centre")) / PASSED)).cast("long").alias("parts"),
    )
    placed = rows.join(sizes, "bucket").join(sets, "node")
    home, zero = F.pmod(F.xxhash64("node"), F.col("blocks")), F.lit(0).cast("long")
    part = F.pmod(F.xxhash64(F.lit("part"), "node"), F.col("parts"))
    held = placed.where("centre").withColumn("block", home).withColumn("part", F.explode(F.sequence(zero, F.col("parts") - 1)))
    # Centres pass the blocks before their own.
    passing = placed.withColumn("last", F.when(F.col("centre"), home).otherwise(F.col("blocks")) - 1).where("last >= 0")
    passing = passing.withColumn("block", F.explode(F.sequence(zero, F.col("last")))).withColumn("part", part)
    columns = ["bucket", "block", "part", "held", "root", "hashes"]
    both = held.withColumn("held", F.lit(True)).select(*columns).union(passing.withColumn("held", F.lit(False)).select(*columns))
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(partitions, *columns[:3]).sortWithinPartitions(*columns[:3], F.desc("held"))
    return dealt.mapInArrow(_forest, "low long, high long")


def roots(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, root``: the component of every node that shares a bucket with another.

    ``docs`` has the columns ``doc_id`` and ``text`` (bytes), ``nodes`` are made of it.
    """
    keyed = _fingerprinted(nodes).union(nodes.select(F.explode("keys").alias("bucket"), "node", "n"))
    shared = keyed.groupBy("bucket").count().where("count > 1").select("bucket")
    members = cut_lineage(keyed.join(shared, "bucket").select("bucket", "node", "n", F.col("node").alias("root")))
    out = members.select("node", "root").distinct()
    wanted = nodes.join(members.select("node").distinct(), "node").select("node", F.col("first").alias("doc_id"), "digest")
    texts = docs.join(wanted, "doc_id").where(_digests("text") == F.col("digest"))
    texts = cut_lineage(texts.select("node", "text").dropDuplicates(["node"]))
    sets, turn = None, 0
    while not members.isEmpty():
        rows = _mixed(members, turn)
        if rows.isEmpty():
            break
        if turn == 1:
            sets = cut_lineage(texts.join(rows.select("node").distinct(), "node").mapInArrow(_hashed, "node long, hashes binary"))
        # Links between components found so far; only these are contracted further.
        links = _compared(rows, sets) if turn else _star(rows, texts)
        moved = components(links, "low", "high").select(F.col("node").alias("root"), F.col("root").alias("to"))
        out = cut_lineage(out.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        members = rows.where("not centre").join(moved, "root", "left")
        members = cut_lineage(members.select("bucket", "node", "n", F.coalesce("to", "root").alias("root")))
        turn += 1
    return out


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near copies: of each component the row with the smallest id stays.

    Of repeated rows with that id one stays; rows without an id stay, as nothing tells them apart.
    """
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), utf8(text).alias("text"))
    nodes = _nodes(rows)
    found = roots(rows, nodes)
    groups = nodes.select("node", "first").join(found, "node", "left").groupBy(F.coalesce("root", "node"))
    return keep_first(docs, groups.agg(F.min("first").alias("component_id")), doc_id=doc_id)
