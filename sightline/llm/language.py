"""Language identification with hyperdimensional profiles.

Each letter class has a random vector of +1 and -1. A trigram's vector binds (multiplies) its
letters' vectors, permuted (rolled) by their place; a text's vector bundles (adds) those of
its trigrams, a language's prototype those of its training documents. A text gets the language
whose prototype has the largest cosine.

Letters are lower-cased; a-z have classes of their own, all other letters share ``OTHER``
classes by a hash, and any run of non-letters is one boundary. Training documents weigh alike
whatever their length (whole-number shares, so sums do not depend on their order). Spark adds
up trigram weights per language; a language's profile has at most ``CLASSES ** 3`` rows, so
its prototype is made in one small group. Only prototypes go to the driver, behind a check of
their number.

Defined results: null texts and texts without a letter are ``und`` with score 0, as are all
texts when nothing can be learned from; ties go to the first language in code point order;
rows without a label or without a training flag teach nothing; repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.texts import vacant

DIMENSIONS = 1024
OTHER = 37
CLASSES = 27 + OTHER
SEED = 20_24
UNKNOWN = "und"
#: Most languages whose prototypes are brought to the driver and broadcast; more is an error.
MAX_LANGUAGES = 4096
#: A document's trigram shares are whole numbers of this many parts.
PARTS = 1 << 20
#: Texts are worked on in chunks of so many documents or characters, trigrams in blocks.
CHUNK_DOCS, CHUNK_CHARS, BLOCK = 256, 2_000_000, 8192


@cache
def _classes() -> np.ndarray:
    """Class of every code point: 0 for non-letters, 1 to 26 for a to z, then the others."""
    codes = np.arange(0x110000, dtype=np.uint64)
    out = (27 + ((codes * np.uint64(2654435761)) % np.uint64(1 << 32) >> np.uint64(16)) % np.uint64(OTHER)).astype(np.uint8)
    out[[not chr(c).isalpha() for c in range(0x110000)]] = 0
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return out


@cache
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter vectors as first, second and third letter of a trigram."""
    made = np.random.default_rng(SEED).integers(0, 2, (CLASSES, DIMENSIONS), dtype=np.int8) * 2 - 1
    made = made.astype(np.int8)
    return np.roll(made, 2, axis=1), np.roll(made, 1, axis=1), made


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bound vectors of trigram numbers, one row each."""
    first, second, third = _letters()
    return first[grams // CLASSES**2] * second[grams // CLASSES % CLASSES] * third[grams % CLASSES]


def grams_of(text: str | None) -> np.ndarray:
    """Trigram numbers of a text; none if it has no letter."""
    if not text:
        return np.empty(0, np.int32)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    found = _classes()[codes]
    if not found.any():
        return np.empty(0, np.int32)
    found = np.concatenate(([0], found, [0])).astype(np.int32)
    found = found[(found != 0) | np.concatenate(([True], found[:-1] != 0))]
    return (found[:-2] * CLASSES + found[1:-1]) * CLASSES + found[2:]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if i > start and (i - start >= CHUNK_DOCS or chars + size > CHUNK_CHARS):
            yield start, i
            start, chars = i, 0
        chars += size
    if start < len(texts):
        yield start, len(texts)


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text and different trigram: text number, trigram, count; and trigrams per text."""
    grams = [grams_of(t) for t in texts]
    sizes = np.array([len(g) for g in grams], np.int64)
    keys = np.repeat(np.arange(len(texts), dtype=np.int32), sizes) * CLASSES**3 + np.concatenate(grams)
    keys, counts = np.unique(keys, return_counts=True)
    return keys // CLASSES**3, keys % CLASSES**3, counts, sizes


def text_vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bundled vectors of some texts, and the number of trigrams in each."""
    doc, gram, count, sizes = counted(texts)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    order = np.argsort(gram, kind="stable")
    doc, gram, count = doc[order], gram[order], count[order]
    known, place = np.unique(gram, return_inverse=True)
    for start in range(0, len(known), BLOCK):
        a, b = np.searchsorted(place, [start, start + BLOCK])
        block = known[start : start + BLOCK]
        share = np.zeros((len(texts), len(block)), np.float32)
        share[doc[a:b], place[a:b] - start] = count[a:b]
        out += share @ gram_vectors(block).astype(np.float32)
    return out, sizes


def _weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Trigram weights per language, added up over each batch."""
    for batch in batches:
        texts = batch["text"].tolist()
        codes, langs = pd.factorize(batch["lang"])
        for start, end in _chunks(texts):
            doc, gram, count, sizes = counted(texts[start:end])
            if len(doc):
                rows = pd.DataFrame({"lang": codes[start:end][doc], "gram": gram, "weight": count * PARTS // sizes[doc]})
                rows = rows.groupby(["lang", "gram"], as_index=False)["weight"].sum()
                rows["lang"] = np.asarray(langs, object)[rows["lang"]]
                yield rows


def _prototype(profile: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(DIMENSIONS)
    grams, weights = profile["gram"].to_numpy(), profile["weight"].to_numpy(np.float64)
    order = np.argsort(grams)
    for start in range(0, len(grams), BLOCK):
        part = order[start : start + BLOCK]
        total += weights[part] @ gram_vectors(grams[part]).astype(np.float64)
    norm = np.sqrt((total * total).sum())
    return pd.DataFrame({"lang": profile["lang"].iloc[:1], "vector": [total / (norm or 1.0)]})


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", learn: Column | None = None) -> tuple[list[str], np.ndarray]:
    """Languages in code point order and their prototypes, from the rows where ``learn`` holds."""
    rows = docs if learn is None else docs.where(learn)
    rows = rows.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    weights = rows.where("text is not null and lang is not null").mapInPandas(_weigh, "lang string, gram int, weight long")
    profiles = weights.groupBy("lang", "gram").agg(F.sum("weight").alias("weight"))
    made = profiles.groupBy("lang").applyInPandas(_prototype, "lang string, vector array<double>")
    found = sorted((r.lang, r.vector) for r in made.limit(MAX_LANGUAGES + 1).collect())
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return [x for x, _ in found], np.array([v for _, v in found]).reshape(-1, DIMENSIONS)


def predict(
    docs: DataFrame, model: tuple[list[str], np.ndarray], *, text: str = "text", result: str = "language"
) -> DataFrame:
    """Every row of ``docs`` with a struct column: ``lang``, its cosine as ``score`` (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, prototypes = shared.value
        for batch in batches:
            yield _judge(batch.tolist(), names, prototypes)

    return docs.withColumn(vacant(docs.columns, result), judged.asNondeterministic()(F.col(text)))


def _judge(texts: list[str | None], names: list[str], prototypes: np.ndarray) -> pd.DataFrame:
    langs, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    if names:
        for start, end in _chunks(texts):
            vectors, sizes = text_vectors(texts[start:end])
            length = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
            near = vectors @ prototypes.T / np.where(length > 0, length, 1)[:, None]
            best = near.argmax(axis=1)
            some = sizes > 0
            langs[start:end][some] = np.asarray(names, object)[best[some]]
            scores[start:end][some] = near[np.arange(len(best)), best][some].clip(0, 1)
    return pd.DataFrame({"lang": langs, "score": scores})
