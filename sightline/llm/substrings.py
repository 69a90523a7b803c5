"""Substring dedup: prefix-partitioned suffix trees over words.

A window is ``window`` consecutive words; a word is removed if a window over it has a word
sequence that also starts earlier (smaller id, or same id and earlier place).

Suffixes are indexed sparsely. Every window has one anchor: its run of ``PREFIX`` words with
the smallest hash, the leftmost of equals. Equal windows have their anchors at the same place,
so only windows around an anchor that occurs at two places can repeat; anchors are counted with
map-side combining, and all other suffixes are dropped before any text is shuffled. Neighbour
windows of one anchor travel as one stretch of words.

The anchor is the prefix that deals suffixes into groups. A prefix with more than ``GROUP``
occurrences is made longer, to the whole window, so that no group outgrows the memory of a
task; equal stretches are combined before the shuffle. In each group the suffixes are sorted
into a subtree cut at ``window`` words: its deepest nodes are the repeats, and the first
suffix of a node is the one that stays. What goes back to the documents are the places where a
window is the first of its kind; other windows of a repeated anchor are removed.

Whole texts that are equal are one text: the first id stands for it, in all others every word
goes (if there is a window). So large groups of copies enter the index once.

Defined results: a null or empty text has no words; texts of fewer words than a window keep
all of them; a null id comes after all ids; rows with the same id are one document as to what
is earlier, and neither of two windows at the same id and place is; repeated rows get the same
result; extra columns pass through ``dedup`` unchanged. Hashes choose anchors and groups;
windows are compared word by word. Rows of one id (null ids are one) are told apart by a 32-bit
hash of their text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.texts import fresh, utf8
from sightline.session import cut_lineage

WINDOW, PREFIX = 20, 4
#: Occurrences from which a prefix is made as long as the window.
GROUP = 8192
#: Bytes of text whose anchors are found at once, and over which prefix sums run.
CHUNK, BYTES = 1 << 20, 1 << 18
LAST = (1 << 63) - 1


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_BASE = 0x5851F42D4C957F2D


@cache
def _powers(inverse: bool = False) -> np.ndarray:
    """Powers of an odd base (or of its inverse) modulo 2**64."""
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(BYTES, base, np.uint64))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _word_hashes(joined: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of each word, from prefix sums over stretches of at most ``BYTES``."""
    import xxhash

    out = np.zeros(len(start), np.uint64)
    data = np.frombuffer(joined, np.uint8)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BYTES, "right")))
        first, last = int(start[i]), int(end[j - 1])
        if last - first > BYTES:  # one very long word
            out[i] = xxhash.xxh64_intdigest(joined[first:last])
        else:
            sums = np.zeros(last - first + 1, np.uint64)
            np.cumsum((data[first:last].astype(np.uint64) + np.uint64(1)) * _powers()[: last - first], out=sums[1:])
            out[i:j] = (sums[end[i:j] - first] - sums[start[i:j] - first]) * _powers(True)[start[i:j] - first]
        i = j
    return _mix(out)


class Stretches:
    """Some texts (words joined by one space) and their runs of windows with a common anchor.

    Per run: number of the text, first and last window start (words from the beginning of the
    text) and the anchor's hash.
    """

    def __init__(self, texts: list[bytes], window: int):
        self.window = window
        self.sizes = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
        self.joined = b" ".join(t for t in texts if t)
        gaps = np.flatnonzero(np.frombuffer(self.joined, np.uint8) == 32)
        self.start = np.concatenate(([0], gaps + 1))
        self.end = np.concatenate((gaps, [len(self.joined)]))
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.text, self.first, self.last, self.anchor = self._find(int(self.sizes.sum()))
        self.edge = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def _find(self, n: int) -> tuple[np.ndarray, ...]:
        none = np.empty(0, np.int64)
        if n < self.window:
            return none, none, none, none.astype(np.uint64)
        ids = _word_hashes(self.joined, self.start, self.end)
        size = min(PREFIX, self.window)
        places = n - size + 1
        gram = np.zeros(places, np.uint64)
        for j in range(size):
            gram += ids[j : j + places] * _ODD[j]
        gram = _mix(gram)
        # The smallest of a window's grams, by doubling; of equals the leftmost.
        low, at, have, want = gram, np.arange(places), 1, self.window - size + 1
        while have < want:
            step = min(have, want - have)
            right, left = low[step:], low[:-step]
            keep = left <= right
            low, at, have = np.where(keep, left, right), np.where(keep, at[:-step], at[step:]), have + step
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        starts = np.flatnonzero(owner[: n - self.window + 1] == owner[self.window - 1 :])
        if not len(starts):
            return none, none, none, none.astype(np.uint64)
        anchor = at[starts]
        new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        first, last = starts[new], starts[np.concatenate((new[1:], [len(starts)])) - 1]
        text = owner[first]
        return text, first - self.begin[text], last - self.begin[text], gram[anchor[new]]

    def words(self, text: int, first: int, end: int) -> bytes:
        """Words ``first`` up to but without ``end`` of a text."""
        at = self.begin[text]
        return self.joined[self.start[at + first] : self.end[at + end - 1]]

    def listed(self, text: int, places: np.ndarray) -> tuple[slice, np.ndarray, np.ndarray]:
        """Which runs of a text begin at listed places, and the flags of these places."""
        part = slice(self.edge[text], self.edge[text + 1])
        places = np.sort(places)
        spot = np.minimum(np.searchsorted(places >> 1, self.first[part]), len(places) - 1)
        found = np.flatnonzero(places[spot] >> 1 == self.first[part])
        return part, found, places[spot[found]] & 1


def _chunks(texts: Iterable[bytes | None], window: int) -> Iterator[tuple[int, list[bytes], Stretches]]:
    """Texts in chunks of about ``CHUNK`` bytes: number of the first, joined words, their runs."""
    start, size, held = 0, 0, []
    for i, text in enumerate(texts):
        joined = b" ".join(text.split()) if text is not None else b""
        if held and size + len(joined) > CHUNK:
            yield start, held, Stretches(held, window)
            start, size, held = i, 0, []
        held.append(joined)
        size += len(joined)
    if held:
        yield start, held, Stretches(held, window)


def _digest(joined: bytes) -> bytes:
    return hashlib.sha256(joined).digest()


def _summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [b" ".join(t.split()) if t is not None else b"" for t in batch["text"]]
        n_words = [t.count(b" ") + 1 if t else 0 for t in texts]
        yield batch[["doc_id", "d", "short"]].assign(n_words=n_words, sha=[_digest(t) for t in texts])


def _anchors(window: int):
    """``h, d, at, place``: anchor hash, id, short digest and first window, and what tells places apart."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shorts = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for a, texts, runs in _chunks((t.as_py() for t in batch.column(2)), window):
                long = np.array([int.from_bytes(_digest(t)[:8], "big") for t in texts], np.uint64)
                at = (shorts[a + runs.text].astype(np.int64) << 32) | runs.first
                place = _mix(long[runs.text] + runs.first.astype(np.uint64) * _ODD[0])
                columns = [runs.anchor.view(np.int64), ids[a + runs.text].astype(np.int64), at, place.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "d", "at", "place"])

    return found


def _stretch_rows(window: int):
    """Suffix groups' rows of the texts whose repeated anchors are listed, equal ones combined."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best: dict[tuple[int, bytes], list] = {}
            ids, shorts, listed = batch["d"].tolist(), batch["short"].tolist(), batch["listed"]
            for a, texts, runs in _chunks(batch["text"], window):
                anchor = runs.anchor.view(np.int64)
                for i in range(len(texts)):
                    d, short = ids[a + i], shorts[a + i]
                    part, spots, flags = runs.listed(i, listed.iat[a + i])
                    firsts, lasts = runs.first[part][spots].tolist(), runs.last[part][spots].tolist()
                    for first, last, h, long in zip(firsts, lasts, anchor[part][spots].tolist(), flags.tolist()):
                        step = 1 if long else last - first + 1
                        for start in range(first, last + 1, step):
                            body = runs.words(i, start, start + step - 1 + window)
                            key = (_long_key(body) if long else h, body)
                            old = best.get(key)
                            if old is None or (d, start) < (old[0], old[1]):
                                best[key] = [d, start, step, {short}]
                            elif (d, start) == (old[0], old[1]):
                                old[3].add(short)
            rows = [(key, d, start, step, short, body) for (key, body), (d, start, step, some) in best.items() for short in sorted(some)]
            if rows:
                yield pd.DataFrame(rows, columns=["key", "d", "start", "n", "short", "body"])

    return found


def _long_key(body: bytes) -> int:
    import xxhash

    x = xxhash.xxh64_intdigest(body, 1)
    return x - (1 << 64) if x >> 63 else x


def first_windows(rows: list[tuple[int, int, int, int, bytes]], window: int) -> Iterator[tuple[int, int, int, int]]:
    """``d, short, start, n``: runs of windows of one group that no earlier window of it equals.

    ``rows`` are ``d, start, n, short, body`` in order of ``d, start``.
    """
    bodies: dict[bytes, list] = {}
    for d, start, n, short, body in rows:
        seen = bodies.setdefault(body, [d, start, n, []])
        if (d, start) == (seen[0], seen[1]):
            seen[3].append(short)
    if len(bodies) == 1:
        # Windows of one stretch have different places around its anchor: they differ.
        for d, start, n, shorts in bodies.values():
            yield from ((d, short, start, n) for short in shorts)
        return
    # The subtree, cut at the window's depth: suffixes sorted by their first words.
    suffixes = []
    for body, (d, start, n, shorts) in bodies.items():
        gaps = [-1, *(m.start() for m in re.finditer(b" ", body)), len(body)]
        suffixes += [(body[gaps[j] + 1 : gaps[j + window]], d, start + j, shorts) for j in range(n)]
    suffixes.sort()
    found = []
    for _, node in groupby(suffixes, key=lambda s: s[0]):
        _, d, start, shorts = next(node)
        found += [(d, short, start) for short in shorts]
        for _, other, place, more in node:
            if (other, place) != (d, start):
                break
            found += [(d, short, start) for short in more]
    found.sort()
    at = 0
    for i in range(1, len(found) + 1):
        if i == len(found) or found[i] != (*found[i - 1][:2], found[i - 1][2] + 1):
            yield *found[at], i - at
            at = i


def packed(start: int, n: int) -> int:
    """A run of windows in one number; a text has fewer than 2**31 words."""
    return start << 32 | n


def unpacked(run: int) -> slice:
    start = run >> 32
    return slice(start, start + (run & 0xFFFFFFFF))


def _subtrees(window: int):
    """Streams rows sorted by key, d, start; yields runs (start, length) of first windows."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [(), (), (), ()]
            out.clear()
            runs = [packed(start, n) for start, n in zip(columns[2], columns[3])]
            arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(runs, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["d", "short", "run"])

        for part in batches:
            for k, d, start, n, short, body in zip(*(c.to_pylist() for c in part.columns)):
                if k != key:
                    if rows:
                        out.extend(first_windows(rows, window))
                    key, rows = k, []
                # Of equal stretches only the first one counts, so a run of copies is one row.
                if not rows or rows[-1][4] != body or rows[-1][:2] == (d, start):
                    rows.append((d, start, n, short, body))
            if len(out) > 50_000:
                yield batch()
        if rows:
            out.extend(first_windows(rows, window))
        yield batch()

    return found


def _cleaned(window: int):
    """``d, sha, n_removed, kept``: what is left of the texts with repeated anchors."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            ids = batch["d"].tolist()
            for a, texts, runs in _chunks(batch["text"], window):
                for i, text in enumerate(texts):
                    part, spots, _ = runs.listed(i, batch["listed"].iat[a + i])
                    n = int(runs.sizes[i])
                    edges = np.zeros(n + 1, np.int64)
                    np.add.at(edges, runs.first[part][spots], 1)
                    np.add.at(edges, runs.last[part][spots] + 1, -1)
                    windows = np.cumsum(edges[:-1])
                    stays = batch["stays"].iat[a + i]
                    for run in stays if stays is not None else ():
                        windows[unpacked(run)] = 0
                    starts = np.flatnonzero(windows)
                    if not len(starts):
                        continue
                    edges[:] = 0
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, starts + window, -1)
                    gone = np.concatenate(([True], np.cumsum(edges[:-1]) > 0, [True])).astype(np.int8)
                    turns = np.diff(gone)
                    kept = b" ".join(runs.words(i, x, y) for x, y in zip(np.flatnonzero(turns < 0).tolist(), np.flatnonzero(turns > 0).tolist()))
                    rows.append((ids[a + i], _digest(text), int(gone.sum()) - 2, kept))
            if rows:
                yield pd.DataFrame(rows, columns=["d", "sha", "n_removed", "kept"])

    return found


def repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, digest_only: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, sha, kept``: a row per row of ``docs``.

    ``sha`` is the SHA-256 of the words, ``kept`` what is left of them, joined by one space (with
    ``digest_only`` its SHA-256 in hexadecimal digits); ``kept`` is null where nothing is removed.
    """
    if not 1 <= window < 1 << 16:
        raise ValueError("a window has 1 to 65535 words")
    d = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), d.alias("d"), F.hash(text).alias("short"), utf8(text).alias("text"))
    summary = cut_lineage(texts.mapInPandas(_summary, "doc_id long, d long, short int, n_words long, sha binary"))
    firsts = cut_lineage(summary.groupBy("sha").agg(F.min(F.struct("d", "short")).alias("at")).select("sha", "at.*"))
    summary = summary.drop("short")

    source = texts.select("d", "short", "text").where("text is not null")
    anchors = source.mapInArrow(_anchors(window), "h long, d long, at long, place long")
    counted = anchors.groupBy("h").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.count("*").alias("n"))
    repeated = cut_lineage(counted.where("a <> b").select("h", (F.col("n") > GROUP).cast("int").alias("long")))
    listed = anchors.select("h", "d", "at").join(repeated, "h")
    listed = listed.select(
        "d", F.expr("cast(shiftright(at, 32) as int)").alias("short"), F.expr("(at & 4294967295L) * 2 + long").alias("at")
    )
    listed = listed.groupBy("d", "short").agg(F.collect_set("at").alias("listed"))
    listed = cut_lineage(listed.join(firsts.select("d", "short"), ["d", "short"], "left_semi"))

    rows = source.join(listed, ["d", "short"]).select("d", "short", "listed", "text")
    rows = rows.mapInPandas(_stretch_rows(window), "key long, d long, start int, n int, short int, body binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "key").sortWithinPartitions("key", "d", "start")
    stays = rows.mapInArrow(_subtrees(window), "d long, short int, run long")
    stays = stays.groupBy("d", "short").agg(F.collect_set("run").alias("stays"))
    known = listed.join(stays, ["d", "short"], "left")
    found = source.join(known, ["d", "short"]).select("d", "short", "listed", "stays", "text")
    found = found.mapInPandas(_cleaned(window), "d long, sha binary, n_removed long, kept binary").where("n_removed > 0")
    kept = F.sha2("kept", 256) if digest_only else F.decode("kept", "utf-8")
    found = found.select("d", "sha", "n_removed", kept.alias("kept"))
    found = found.groupBy("d", "sha").agg(F.first("n_removed").alias("n_removed"), F.first("kept").alias("kept"))

    own = firsts.drop("short").withColumn("first", F.lit(True)).join(cut_lineage(found), ["d", "sha"], "left")
    out = summary.join(cut_lineage(own), ["d", "sha"], "left")
    copy = F.col("first").isNull() & (F.col("n_words") >= window)
    nothing = F.lit(hashlib.sha256(b"").hexdigest() if digest_only else "")
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        "sha",
        F.when(copy, nothing).otherwise(F.col("kept")).alias("kept"),
    )


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with repeats cut out of ``text``; texts without repeats stay as they are."""
    key, own, words, kept = (fresh(docs.columns, n) for n in ("sha", "own_sha", "id", "kept"))
    found = repeats(docs, doc_id=doc_id, text=text, **options).where(F.col("kept").isNotNull())
    found = found.select(F.col("doc_id").alias(words), F.col("sha").alias(key), F.col("kept").alias(kept)).distinct()

    @F.pandas_udf("binary")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _digest(b" ".join(t.split()) if t is not None else b""))

    keyed = docs.withColumn(own, digest(utf8(text)))
    out = keyed.join(found, F.col(own).eqNullSafe(F.col(key)) & F.col(doc_id).cast("long").eqNullSafe(F.col(words)), "left")
    return out.withColumn(text, F.coalesce(kept, text)).select(*docs.columns)
