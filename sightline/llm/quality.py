"""Quality: ordinal cumulative-link regression on graded ratings.

A text is the mean of its words' hashed features: the lower-cased word, its shape (letters,
digits and signs, runs shortened) and whether it repeats the word before. All grades share one
weight per feature bucket; ordered thresholds between neighbouring grades turn a text's
value into P(grade <= k) = logistic(threshold_k - value), which gives the expected grade and
the probability of at least a wanted grade, by which documents are selected.

The model is fitted on the ``SAMPLE`` rated rows with the smallest hash of their id; only
their bucket counts reach the driver. Scores cover every whole text.

Defined results: a null or empty text has value 0; null grades teach nothing; with one grade
every text has it, without ratings expected grade and probability are null and nothing is
rejected; equal rows get equal scores; extra columns pass through ``score`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.texts import ALNUM_LOWER, LOWER, fresh, utf8, vacant

BUCKETS = 1 << 13
SAMPLE = 8000
REMEMBERED = 200_000
REPEATED = crc32(b"\x00repeated") % BUCKETS

_CLASS = bytes(
    ord("9") if chr(i).isdigit() and i < 128
    else ord("a") if 97 <= i <= 122 or i > 127
    else ord("A") if 65 <= i <= 90
    else i
    for i in range(256)
)


def _shape(word: bytes) -> bytes:
    """Character classes of a word with runs of one class shortened to one."""
    classes = word.translate(_CLASS)
    return bytes(c for i, c in enumerate(classes) if not i or classes[i - 1] != c)[:24]


def buckets(word: bytes) -> tuple[int, int]:
    bare = word.translate(ALNUM_LOWER).strip() or word.translate(LOWER)
    return crc32(bare) % BUCKETS, crc32(_shape(word), 1) % BUCKETS


class _Words(dict):
    """Word -> what ``of`` says, filled on demand and emptied when it is full."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, word: bytes):
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = self.of(word)
        return found


def _repeats(words: list[bytes]) -> int:
    return sum(map(eq, words, words[1:]))


@dataclass
class Model:
    """Weights per bucket, ordered grades, and a threshold between each two neighbours."""

    weights: np.ndarray
    grades: np.ndarray
    thresholds: np.ndarray

    def tails(self, values: np.ndarray) -> np.ndarray:
        """P(grade > k) for every threshold, one row per value."""
        return 1 / (1 + np.exp((self.thresholds[None, :] - values[:, None]).clip(-60, 60)))

    def expected(self, values: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.tails(values) @ np.diff(self.grades)

    def at_least(self, values: np.ndarray, grade: float) -> np.ndarray:
        k = int(np.searchsorted(self.grades, grade))
        if k == 0:
            return np.ones(len(values))
        return self.tails(values)[:, k - 1] if k < len(self.grades) else np.zeros(len(values))


def fit_ordinal(
    row: np.ndarray, bucket: np.ndarray, value: np.ndarray, grade: np.ndarray, ridge: float = 1e-4, steps: int = 400
) -> Model:
    """Maximum likelihood by full-batch Adam; ``value`` at ``row`` and ``bucket`` is not 0.

    Thresholds are a first one and the logarithms of the gaps, so they stay in order.
    """
    grades, y = np.unique(grade, return_inverse=True)
    n, cuts = len(grade), len(grades) - 1
    if cuts < 1:
        return Model(np.zeros(BUCKETS), grades.astype(float), np.zeros(0))
    spread = np.sqrt(np.bincount(bucket, value**2, minlength=BUCKETS) / n)
    scale = np.where(spread > 0, 1 / (spread + 0.02 * spread.max()), 0)
    scaled = value * scale[bucket]
    share = np.cumsum(np.bincount(y))[:-1] / n
    first = np.log(share / (1 - share))
    theta = np.concatenate(([first[0]], np.log(np.maximum(np.diff(first), 1e-3)), np.zeros(BUCKETS)))
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        gaps = np.exp(theta[1:cuts])
        cut = np.concatenate(([-np.inf], theta[0] + np.concatenate(([0.0], np.cumsum(gaps))), [np.inf]))
        values = np.bincount(row, scaled * theta[cuts:][bucket], minlength=n)
        upper = 1 / (1 + np.exp(-(cut[y + 1] - values).clip(-60, 60)))
        lower = 1 / (1 + np.exp(-(cut[y] - values).clip(-60, 60)))
        p = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / p, lower * (1 - lower) / p
        by_cut = np.bincount(y, -d_upper, minlength=cuts + 1)[:cuts] + np.bincount(y, d_lower, minlength=cuts + 1)[1:]
        step = np.empty_like(theta)
        step[0] = by_cut.sum() / n
        for k in range(1, cuts):
            step[k] = by_cut[k:].sum() * gaps[k - 1] / n
        slope = (d_upper - d_lower) / n
        step[cuts:] = np.bincount(bucket, scaled * slope[row], minlength=BUCKETS) + ridge * theta[cuts:]
        m, s = 0.9 * m + 0.1 * step, 0.999 * s + 0.001 * step**2
        theta = theta - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    thresholds = theta[0] + np.concatenate(([0.0], np.cumsum(np.exp(theta[1:cuts]))))
    return Model(theta[cuts:] * scale, grades.astype(float), thresholds)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = _Words(buckets)
    for batch in batches:
        found, share = [], []
        for text in batch["text"]:
            words = text.split() if text is not None else []
            pairs = np.array([known[w] for w in words], np.int64).reshape(-1)
            counts = np.bincount(pairs, minlength=BUCKETS).astype(np.float64)
            counts[REPEATED] += _repeats(words)
            at = np.flatnonzero(counts)
            found.append(at.astype(np.int16).tobytes())
            share.append((counts[at] / max(1, len(words))).astype(np.float32).tobytes())
        yield pd.DataFrame({"bucket": found, "share": share, "grade": batch["grade"]})


def fit(
    docs: DataFrame, ratings: DataFrame, *, learn: Column | None = None,
    doc_id: str = "doc_id", text: str = "text", grade: str = "quality",
) -> Model | None:
    """A model of ``grade``; None without any rated document."""
    rated = ratings if learn is None else ratings.where(learn)
    rated = rated.select(F.col(doc_id).alias("id"), F.col(grade).cast("double").alias("grade"))
    rated = rated.where("id is not null and grade is not null and not isnan(grade)")
    # At most SAMPLE rows of (id, grade): a bounded broadcast.
    drawn = rated.orderBy(F.xxhash64("id"), "id", "grade").limit(SAMPLE)
    texts = docs.select(F.col(doc_id).alias("id"), utf8(text).alias("text"))
    sample = texts.join(F.broadcast(drawn), "id").select("text", "grade")
    rows = sample.mapInPandas(_count, "bucket binary, share binary, grade double").toPandas()
    if rows.empty:
        return None
    # The order of rows follows the partitions; sorted, sums are the same in every run.
    rows = sorted((g, bytes(b), bytes(x)) for b, x, g in rows.itertuples(index=False))
    sizes = [len(b) // 2 for _, b, _ in rows]
    return fit_ordinal(
        np.repeat(np.arange(len(rows)), sizes),
        np.frombuffer(b"".join(b for _, b, _ in rows), np.int16).astype(np.int64),
        np.frombuffer(b"".join(x for _, _, x in rows), np.float32).astype(np.float64),
        np.array([g for g, _, _ in rows]),
    )


RESULT = "expected_grade double, tail double"


def score(docs: DataFrame, model: Model | None, *, at_least: float = 1.0, text: str = "text", result: str = "quality") -> DataFrame:
    """Every row of ``docs`` with a struct: the expected grade and P(grade >= ``at_least``)."""
    if model is None:
        return docs.withColumn(vacant(docs.columns, result), F.struct(F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        weights = fitted.weights.tolist()
        known = _Words(lambda w: sum(weights[b] for b in buckets(w)))
        for batch in batches:
            values = np.zeros(len(batch))
            for i, text in enumerate(batch):
                words = text.split() if text is not None else []
                if words:
                    values[i] = (sum(map(known.__getitem__, words)) + weights[REPEATED] * _repeats(words)) / len(words)
            yield pd.DataFrame({"expected_grade": fitted.expected(values), "tail": fitted.at_least(values, at_least)})

    return docs.withColumn(vacant(docs.columns, result), scored.asNondeterministic()(utf8(text)))


def select(docs: DataFrame, model: Model | None, *, probability: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` whose probability of the wanted grade is high enough."""
    name = fresh(docs.columns, "quality")
    scored = score(docs, model, result=name, **options)
    return scored.where(F.coalesce(F.col(name)["tail"] >= probability, F.lit(True))).drop(name)
