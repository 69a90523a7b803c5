"""Toxicity: noisy-channel deobfuscation, then a linear score of the restored words.

A character trigram language model is counted over all texts (at most ``CLASSES ** 3`` rows).
Words that look disguised (digits or signs for letters, letters spaced out or repeated) become
a lattice: each character may stand for itself, for a letter that it imitates, or for nothing,
each at a cost of the channel. Viterbi decoding picks the reading with the lowest total cost
under the language model. Restored words and their beginnings are features of a logistic
regression on document labels; a feature counts once per document.

Only the classifier is fitted on a sample: the ``SAMPLE`` labelled rows with the smallest hash
of their id, and the ``FEATURES`` features with the largest chi-square on it. Language model
and scores cover every whole text. The driver holds the language model, the chosen features
and their weights, all of fixed size.

Defined results: null and empty texts have the score of a text without features; labels that
are null, or other than 0 and 1, teach nothing; if nothing can be learned (no rows, or one
label only), every score is the share of label 1, or 0; a repeated row counts each time it is
drawn; extra columns pass through ``score`` unchanged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.language import CLASSES, _classes, _chunks, grams_of
from sightline.llm.texts import fresh, vacant

SAMPLE, FEATURES, LEAST = 16_000, 2048, 4
PREFIXES = (4, 5, 6)
#: Words that a worker remembers with their features.
REMEMBERED = 200_000

# Which letters a sign may stand for.
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou",
}
#: Costs of the channel, in nats: imitation, a sign or gap that stands for nothing, a gap that
#: ends a word, a repeated letter left out (in a run of two, in a longer run).
IMITATION, NOTHING, GAP, END, DOUBLE, RUN = 1.0, 6.0, 0.3, 3.0, 6.0, 0.5

_LETTER = r"[^\W\d_]"
_SIGN = r"[0-9@$!|+*]"
_SUSPECT = re.compile(
    rf"{_LETTER}{_SIGN}|{_SIGN}{_LETTER}|({_LETTER})\1\1|(?:^|[._-]){_LETTER}[._-]{_LETTER}[._-]"
)
#: Three or more single characters with blanks between them.
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t]){2,}\S(?!\S)")
_EDGES = ".,;:!?\"'()[]{}<>%#&*~`"
_TAIL = re.compile(r"([$@+|])\1\1+$")


class LanguageModel:
    """Costs of a letter class after two others, interpolated from trigram counts."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        share = lambda x: x / np.maximum(x.sum(axis=-1, keepdims=True), 1)
        p = 0.7 * share(three) + 0.2 * share(two) + 0.09 * share(one) + 0.01 / CLASSES
        self.cost = (-np.log(p)).astype(np.float32).tolist()


def _options(token: str) -> Iterator[list[tuple[str, float]]]:
    """Per character of a disguised word: what it may stand for, at which cost."""
    for i, c in enumerate(token):
        if c.isalpha():
            out = [(c, 0.0)]
            if i and token[i - 1] == c:
                run = (i > 1 and token[i - 2] == c) or token[i + 1 : i + 2] == c
                out.append(("", RUN if run else DOUBLE))
        elif c in IMITATES:
            out = [(x, IMITATION) for x in IMITATES[c]] + [("", NOTHING)]
        else:
            out = [("", GAP), (" ", END)]
        yield out


def decode(token: str, model: LanguageModel) -> str:
    """The most likely reading of a lower-case token (Viterbi over the last two letters)."""
    classes, cost = _classes(), model.cost
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in _options(token):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (total, path) in best.items():
            for letter, price in options:
                if letter:
                    k = int(classes[ord(letter)])
                    state = (b, k) if b or k else (a, b)
                    found = (total + price + cost[a][b][k], (path, letter))
                else:
                    state, found = (a, b), (total + price, path)
                if state not in after or found[0] < after[state][0]:
                    after[state] = found
        best = after
    path = _cheapest(best, cost)
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters))


def _cheapest(best: dict, cost: list) -> tuple | None:
    """The path of the state that ends a word at the lowest cost."""
    _, a, b = min((total + cost[a][b][0], a, b) for (a, b), (total, _) in best.items())
    return best[a, b][1]


def restored(word: str, model: LanguageModel) -> list[str]:
    """Lower-case words that a written word stands for."""
    core = _TAIL.sub("", word.lower().strip(_EDGES)).strip(_EDGES)
    if _SUSPECT.search(core):
        return decode(core, model).split()
    return [core] if core else []


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) > n)]


def spaced_words(text: str, model: LanguageModel) -> list[str]:
    """Restored words of stretches of single characters."""
    return [w for m in _SPACED.finditer(text) for w in decode(re.sub(r"\s", "_", m[0].lower()), model).split()]


@dataclass
class Model:
    """Language-model counts, feature numbers, their weights and the intercept."""

    counts: np.ndarray
    numbers: dict[str, int]
    weights: np.ndarray
    intercept: float


class _Known(dict):
    """Word -> feature numbers, filled on demand and emptied when it is full."""

    def __init__(self, numbers: dict[str, int], language: LanguageModel):
        self.numbers, self.language = numbers, language

    def of(self, words: list[str]) -> tuple[int, ...]:
        return tuple(self.numbers[f] for w in words for f in features(w) if f in self.numbers)

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = self.of(restored(word, self.language))
        return found

    def document(self, text: str | None) -> list[int]:
        """Numbers of the features in a text, each once."""
        if not text:
            return []
        found = {n for numbers in filter(None, map(self.__getitem__, text.split())) for n in numbers}
        found.update(self.of(spaced_words(text, self.language)))
        return sorted(found)


_KNOWN: dict[int, tuple] = {}


def _known(model: Model) -> _Known:
    """The memory of this broadcast model in this worker."""
    if id(model) not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[id(model)] = (model, _Known(model.numbers, LanguageModel(model.counts)))
    return _KNOWN[id(model)][1]


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, total = batch["text"].tolist(), np.zeros(CLASSES**3, np.int64)
        for start, end in _chunks(texts):
            total += np.bincount(np.concatenate([grams_of(t) for t in texts[start:end]]), minlength=CLASSES**3)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"gram": seen.astype(np.int32), "n": total[seen]})


def gram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts of all texts; at most ``CLASSES ** 3`` rows reach the driver."""
    rows = docs.select(F.col(text).alias("text")).where("text is not null").mapInPandas(_count_grams, "gram int, n long")
    found = rows.groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CLASSES**3, np.int64)
    counts[found["gram"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def _feature_counts(shared):
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        language = LanguageModel(shared.value)
        for batch in batches:
            totals = {0: Counter(), 1: Counter()}
            for text, label in zip(batch["text"], batch["label"]):
                words = {w for t in set((text or "").split()) for w in restored(t, language)}
                words.update(spaced_words(text or "", language))
                totals[int(label)].update({f for w in words for f in features(w)})
            for label, found in ((k, v) for k, v in totals.items() if v):
                yield pd.DataFrame({"feature": list(found), "n": list(found.values()), "ones": [n * label for n in found.values()]})

    return counted


def _chosen(sample: DataFrame, counts: np.ndarray, total: int, ones: int) -> list[str]:
    """The features most dependent on the label, by chi-square of presence in the sample."""
    shared = sample.sparkSession.sparkContext.broadcast(counts)
    found = sample.mapInPandas(_feature_counts(shared), "feature string, n long, ones long")
    found = found.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).where(F.col("n") >= LEAST)
    n, expected = F.col("n"), F.col("n") * F.lit(ones / total)
    gap = F.col("ones") - expected
    found = found.withColumn("chi", gap * gap / (expected * (1 - n / F.lit(total + 1.0))))
    rows = found.orderBy(F.desc("chi"), "feature").limit(FEATURES).select("feature").collect()
    return [r.feature for r in rows]


def _fit_weights(rows: list[np.ndarray], labels: np.ndarray, width: int, ridge: float = 0.3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of feature numbers: gradient steps with momentum."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64)
    often = np.bincount(feature, minlength=width)
    weights, intercept = np.zeros(width), float(np.log(labels.mean() / (1 - labels.mean())))
    moved, moved_b = np.zeros(width), 0.0
    rate = 1.0 / (0.25 * often * np.sqrt(max(1.0, len(feature) / max(1, len(rows)))) + ridge)
    for _ in range(steps):
        raw = intercept + np.bincount(at, weights[feature], minlength=len(rows))
        error = 1 / (1 + np.exp(-raw.clip(-40, 40))) - labels
        step = np.bincount(feature, error[at], minlength=width) + ridge * weights
        moved = 0.8 * moved - 0.2 * rate * step
        moved_b = 0.8 * moved_b - 0.2 * 4 * error.mean()
        weights, intercept = weights + moved, intercept + moved_b
    return weights, intercept


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    learn: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> Model:
    """A model of ``label`` from the labelled rows where ``learn`` (a column of ids) holds."""
    spark = docs.sparkSession
    counts = gram_counts(docs, text)
    known = labels if learn is None else labels.where(learn)
    known = known.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
    known = known.where("id is not null and label in (0, 1)")
    # At most SAMPLE rows of (id, label): a bounded broadcast.
    drawn = known.orderBy(F.xxhash64("id"), "id", "label").limit(SAMPLE)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    sample = texts.join(F.broadcast(drawn), "id").select("text", "label")
    total, ones = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not total or ones in (0, total):
        share = ones / total if total else 0.0
        odds = np.log(share / (1 - share)) if 0 < share < 1 else (np.inf if share else -np.inf)
        return Model(counts, {}, np.zeros(0), float(odds))
    numbers = {f: i for i, f in enumerate(_chosen(sample, counts, total, ones))}
    shared = spark.sparkContext.broadcast(Model(counts, numbers, np.zeros(0), 0.0))

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_known(shared.value).document(t) for t in batch["text"]]
            yield pd.DataFrame({"found": found, "label": batch["label"]})

    rows = sample.mapInPandas(numbered, "found array<int>, label int").toPandas()
    # The order of rows follows the partitions; sorted, sums are the same in every run.
    pairs = sorted((tuple(map(int, f)), int(y)) for f, y in zip(rows["found"], rows["label"]))
    weights, intercept = _fit_weights(
        [np.array(f, np.int64) for f, _ in pairs], np.array([y for _, y in pairs], float), len(numbers)
    )
    return Model(counts, numbers, weights, intercept)


def score(docs: DataFrame, model: Model, *, text: str = "text", result: str = "toxicity") -> DataFrame:
    """Every row of ``docs`` with its score, 0 to 1, as a column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, fitted = _known(shared.value), shared.value
        for batch in batches:
            raw = np.array([fitted.intercept + fitted.weights[known.document(t)].sum() for t in batch])
            yield pd.Series(1 / (1 + np.exp(-raw.clip(-700, 700))))

    return docs.withColumn(vacant(docs.columns, result), scored.asNondeterministic()(F.col(text)))


def clean(docs: DataFrame, model: Model, *, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, columns as given."""
    name = fresh(docs.columns, "toxicity")
    return score(docs, model, result=name, **options).where(F.col(name) < threshold).drop(name)
