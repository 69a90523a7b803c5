"""Collocations: phrases that come more often than their parts let expect, for each group of texts.

Two passes over the corpus count every n-gram that occurs ``threshold`` times or more.

1. **Misra-Gries summaries per hash partition.** Each task combines the n-grams of a chunk by hash
   and sends them, dealt by hash, as summaries (no counter is taken off there). A partition merges
   the summaries that it gets: counters are added up, and where more than ``capacity`` are left, the
   largest that does not fit is taken off all. What was taken off one n-gram in sum is at most mass
   / (capacity + 1), and capacity is the (bound of the) mass divided by the threshold, so an n-gram
   with the threshold has a counter left; a partition whose mass is above the expectation would
   take off more and gets more counters instead. Nothing frequent is lost.
2. **Exact counts.** The surviving hashes make a bit filter of fixed size (at most 16 MB, each
   partition makes its own slice), which is broadcast. Each task counts the n-grams that it lets
   through, as words; counts are dealt by phrase and added up. Equal hashes and a crowded filter let
   more through and change no result.

The rest is joins and grouping over the frequent n-grams only.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm import ngrams
from sightline.llm.texts import utf8
from sightline.session import cut_lineage

#: Counters of a hash partition, while there are few partitions, and at most.
COUNTERS, MOST_COUNTERS = 1 << 16, 1 << 22
#: Partitions up to which counters stay few.
PARTITIONS = 1 << 12
#: Bits of the filter at most.
FILTER_BITS = 1 << 27
#: N-grams that a task counts as text before it hands the counts on (some 140 bytes each).
HELD = 1 << 19
#: Parts of a group that are ranked apart before the last ranking.
SALTS = 64


class Summary:
    """A mergeable Misra-Gries summary: counters of 32-bit keys, and what was taken off at most."""

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold, self.taken_off = capacity, threshold, 0
        self.keys, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > 2 * self.capacity:
            self.merge()

    def merge(self) -> None:
        """Adds up the counters, then takes off what leaves no more than ``capacity`` of them."""
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.size = [], 0
        self.keys, self.counts = combined(keys, counts)
        while len(self.counts) > self.capacity:
            off = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            if self.taken_off + off >= self.threshold:
                self.capacity *= 2  # more mass than expected
                continue
            self.taken_off += off
            left = self.counts > off
            self.keys, self.counts = self.keys[left], self.counts[left] - off

    def survivors(self) -> np.ndarray:
        """Keys that may have reached the threshold: all that did, and some others."""
        self.merge()
        return self.keys[self.counts + self.taken_off >= self.threshold]


def combined(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, ascending, with the sum of its counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts[order], first)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as differences and counts, byte by byte of the numbers, compressed."""
    both = np.concatenate([np.diff(keys, prepend=np.uint32(0)).astype("<u4"), counts.astype("<u4")])
    return pa.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpack(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(raw, n * 8, codec="zstd", asbytes=True), np.uint8)
    both = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()
    return np.cumsum(both[:n], dtype=np.uint32), both[n:].astype(np.int64)


def dealt(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Number of the hash partition above, key inside it below: 32 bits each."""
    part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return (part << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The two bits of a key in its partition's slice of the filter."""
    spread = ngrams.mixed(keys.astype(np.uint64) + np.uint64(1))
    return [(spread >> np.uint64(s)).astype(np.uint32) % np.uint32(bits) for s in (0, 32)]


def _summaries(parts: int, longest: int):
    """Maps texts to the summaries of their chunks, one row for each hash partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in ngrams.chunks(batches):
            found = np.concatenate([dealt(h, parts) for _, h in chunk.hashes(longest)])
            if not len(found):
                continue
            found.sort()
            first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
            counts = np.diff(np.r_[first, len(found)])
            keys = found[first]
            part = (keys >> np.uint64(32)).astype(np.int64)
            low = keys.astype(np.uint32)
            edges = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
            rows = [pack(low[a:b], counts[a:b]) for a, b in zip(edges, edges[1:])]
            yield pa.record_batch(
                [pa.array(part[edges[:-1]]), pa.array(np.diff(edges)), pa.array(rows, pa.binary())],
                ["part", "n", "summary"],
            )

    return run


def _slices(capacity: int, threshold: int, slice_bits: int):
    """Merges the summaries of each partition, rows in order of it, to its slice of the filter."""

    def made(summary: Summary) -> bytes:
        bits = np.zeros(slice_bits, bool)
        for at in places(summary.survivors(), slice_bits):
            bits[at] = True
        return np.packbits(bits).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, summary = None, None
        done: list[tuple[int, bytes]] = []
        for batch in batches:
            for p, n, raw in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if p != part:
                    if summary is not None:
                        done.append((part, made(summary)))
                    part, summary = p, Summary(capacity, threshold)
                summary.add(*unpack(raw, n))
            if done:
                yield pa.record_batch([pa.array([p for p, _ in done]), pa.array([b for _, b in done])], ["part", "bits"])
                done = []
        if summary is not None:
            yield pa.record_batch([pa.array([part]), pa.array([made(summary)])], ["part", "bits"])

    return run


def _counts(held: Broadcast, parts: int, slice_bits: int, longest: int, deals: int):
    """Maps texts to counts of the n-grams that pass the filter; n = 0 counts words.

    Counts are handed on as one row for each deal (a hash of the phrase), group and n: the phrases,
    one in a line (no word holds a line feed), and their numbers.
    """

    def passing(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
        start = (keys >> np.uint64(32)) * np.uint64(slice_bits)
        ok = np.ones(len(keys), bool)
        for at in places(keys.astype(np.uint32), slice_bits):
            bit = start + at
            ok &= (bits[bit >> np.uint64(3)] >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1
        return ok

    def rows(counts: dict[tuple[str, int], Counter[bytes]]) -> Iterator[pa.RecordBatch]:
        for (group, n), found in counts.items():
            hands: defaultdict[int, list[bytes]] = defaultdict(list)
            for phrase in found:
                hands[xxhash.xxh64_intdigest(phrase) % deals].append(phrase)
            columns = [
                pa.array(list(hands), pa.int64()),
                pa.array([group] * len(hands), pa.string()),
                pa.array([n] * len(hands), pa.int32()),
                pa.array([zlib.compress(b"\n".join(phrases), 1) for phrases in hands.values()], pa.binary()),
                pa.array([[found[phrase] for phrase in phrases] for phrases in hands.values()], pa.list_(pa.int64())),
            ]
            yield pa.record_batch(columns, ["deal", "group", "n", "phrases", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(held.value, np.uint8)
        counts: defaultdict[tuple[str, int], Counter[bytes]] = defaultdict(Counter)
        for chunk in ngrams.chunks(batches):
            for n, (at, hashes) in enumerate(chunk.hashes(longest), 1):
                if n == 1:
                    counts[chunk.group, 0][b""] += len(at)
                found = counts[chunk.group, n]
                kept = passing(dealt(hashes, parts), bits)
                at, hashes = at[kept], hashes[kept]
                if not len(at):
                    continue
                order = np.argsort(hashes, kind="stable")
                at, hashes = at[order], hashes[order]
                first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
                size = np.diff(np.r_[first, len(at)])
                # Other words of the same hash are counted one by one.
                own = np.repeat(at[first], size)
                same = np.ones(len(at), bool)
                for j in range(n):
                    same &= chunk.word[at + j] == chunk.word[own + j]
                for place, by in zip(at[first].tolist(), np.add.reduceat(same.astype(np.int64), first).tolist()):
                    found[chunk.phrase(place, n)] += by
                for place in at[~same].tolist():
                    found[chunk.phrase(place, n)] += 1
            if sum(map(len, counts.values())) > HELD:
                yield from rows(counts)
                counts.clear()
        yield from rows(counts)

    return run


def _totals(threshold: int):
    """Adds up the counts of each deal, group and n, rows in order of them; infrequent n-grams go."""

    def rows(group: str, n: int, total: Counter[bytes]) -> pa.RecordBatch:
        kept = [(p, f) for p, f in total.items() if f >= threshold or n == 0]
        columns = [[group] * len(kept), [n] * len(kept), [p for p, _ in kept], [f for _, f in kept]]
        kinds = [pa.string(), pa.int32(), pa.binary(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["group", "n", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, Counter()
        for batch in batches:
            for deal, group, n, phrases, f in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if (deal, group, n) != key:
                    if key is not None:
                        yield rows(*key[1:], total)
                    key, total = (deal, group, n), Counter()
                for phrase, by in zip(zlib.decompress(phrases).split(b"\n"), f):
                    total[phrase] += by
        if key is not None:
            yield rows(*key[1:], total)

    return run


def frequent(docs: DataFrame, text: str = "text", group: str = "lang", threshold: int = 30, longest: int = 4) -> DataFrame:
    """(group, n, phrase, f): every n-gram of up to ``longest`` words with ``threshold`` occurrences.

    n = 0 holds the number of all words of a group. Null groups are ``und``. The table is written to
    the shared folder, since several joins read it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("group"), utf8(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    # A word and the space behind it are two bytes or more.
    mass = longest * (size // 2 + 1)
    parts = math.ceil(mass / threshold / COUNTERS)
    if parts > PARTITIONS:
        parts = max(PARTITIONS, math.ceil(mass / threshold / MOST_COUNTERS))
    capacity = math.ceil(mass / threshold / parts)
    bits = min(FILTER_BITS, 1 << (8 * mass // threshold).bit_length())
    slice_bits = max(8, bits // parts // 8 * 8)

    summaries = rows.mapInArrow(_summaries(parts, longest), "part long, n long, summary binary")
    slices = (
        summaries.repartition("part")
        .sortWithinPartitions("part")
        .mapInArrow(_slices(capacity, threshold, slice_bits), "part long, bits binary")
    )
    # Bounded: all slices together have the size of the filter.
    filled = bytearray(parts * slice_bits // 8)
    for row in slices.collect():
        at = row["part"] * slice_bits // 8
        filled[at : at + slice_bits // 8] = row["bits"]
    held = spark.sparkContext.broadcast(bytes(filled))

    deals = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.mapInArrow(
        _counts(held, parts, slice_bits, longest, deals), "deal long, group string, n int, phrases binary, f array<long>"
    )
    dealt_out = counted.repartition("deal").sortWithinPartitions("deal", "group", "n")
    total = dealt_out.mapInArrow(_totals(threshold), "group string, n int, phrase binary, f long")
    return cut_lineage(total.withColumn("phrase", F.col("phrase").cast("string")))


def scored(grams: DataFrame) -> DataFrame:
    """(group, phrase, n, a, l, r, score) of phrases of two words and more.

    A phrase is cut after each of its words; a cut scores 2000000 a / (l + r), rounded down, with
    the frequencies of the phrase and of both parts, and the lowest cut counts (ties: the first).
    Products are decimals of 38 digits.
    """
    words = grams.where("n > 0")
    part = words.select("group", "phrase", "f")
    first, rest = part.toDF("group", "first", "l"), part.toDF("group", "rest", "r")
    cut = (
        words.where("n > 1")
        .withColumn("w", F.split("phrase", " "))
        .select("group", "phrase", "n", F.col("f").alias("a"), "w", F.explode(F.expr("sequence(1, n - 1)")).alias("k"))
        .withColumn("first", F.concat_ws(" ", F.expr("slice(w, 1, k)")))
        .withColumn("rest", F.concat_ws(" ", F.expr("slice(w, k + 1, n - k)")))
        .drop("w")
    )
    score = F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    return (
        cut.join(first, ["group", "first"])
        .join(rest, ["group", "rest"])
        .withColumn("score", score)
        .groupBy("group", "phrase", "n", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("group", "phrase", "n", "a", "cut.l", "cut.r", "cut.score")
    )


def inside(grams: DataFrame) -> DataFrame:
    """(group, phrase, outer): for phrases inside a longer one the highest frequency of such."""
    longer = grams.where("n > 2").withColumn("w", F.split("phrase", " "))
    spans = F.expr(
        "flatten(transform(sequence(2, n - 1), m -> transform(sequence(1, n - m + 1), i -> concat_ws(' ', slice(w, i, m)))))"
    )
    return longer.select("group", F.explode(spans).alias("phrase"), "f").groupBy("group", "phrase").agg(F.max("f").alias("outer"))


def mine(
    docs: DataFrame, text: str = "text", group: str = "lang", threshold: int = 30, longest: int = 4, top: int = 2000
) -> DataFrame:
    """(group, rank, phrase, a, l, r, n, score): the ``top`` phrases of each group by score.

    A phrase inside a longer one that reaches 80 % of its frequency goes. Ties go by frequency, then
    by phrase in byte order. ``n`` is the number of the group's words. Null texts are empty, null
    groups are ``und``; repeated rows count each time, other columns do not matter, and an empty
    table or one without frequent phrases gives no rows.
    """
    grams = frequent(docs, text, group, threshold, longest)
    outer = inside(grams)
    kept = (
        scored(grams)
        .join(outer, ["group", "phrase"], "left")
        .where("outer is null or cast(outer as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * 80")
        .drop("outer", "n")
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("group", "salt").orderBy(*order))).where(
        F.col("rank") <= top
    )
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(*order)).cast("long"))
    words = grams.where("n = 0").select("group", F.col("f").alias("n"))
    return (
        ranked.where(F.col("rank") <= top)
        .join(words, "group")
        .select(F.col("group").alias(group), "rank", "phrase", "a", "l", "r", "n", "score")
    )
