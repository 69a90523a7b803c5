"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are runs of key characters with a digit, and values assigned to a secret-like name.
A forest judges each by its length, character transitions, coverage by dictionary words, its
path, and its neighbouring words and characters. The dictionary is the ``DICTIONARY`` words
that are most frequent in all documents. Spark grows the trees in parallel, each from its own
bootstrap of the labelled findings; only these (at most ``SAMPLE``, by the smallest hash) and
the trees pass through the driver. Scans read whole texts in one pass without a shuffle.

``labelled`` findings may come from reviewers. Where there are none, ``known_label`` gives
those that their form settles: provider key formats and assigned random values are secrets;
plain numbers, parts of addresses and urls, and dictionary words are not.

Defined results: null and empty texts have no candidates; with labels of one kind only, every
candidate gets that label, without labels every candidate counts as a secret; overlapping
candidates count once, as the longest; extra columns pass through ``scan`` unchanged.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.texts import LOWER, fresh, utf8, vacant
from sightline.session import cut_lineage

DICTIONARY, SAMPLE = 5000, 20_000
TREES, LEVELS, BINS, LEAST = 40, 10, 32, 2
SHORTEST, NEAR = 8, 48
PLACEHOLDER = b"<secret>"

_DIGIT = re.compile(rb"[0-9]")
_RUN = re.compile(rb"x{%d,}" % SHORTEST)
_KEY = bytes(120 if chr(i).isalnum() and i < 128 or i in b"+/_-" else 32 for i in range(256))
# Names that secrets are assigned to, and formats of provider keys.
_ASSIGNED = re.compile(
    rb"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|auth)[\"']?[ \t]*[:=][ \t]*[\"']?([^\s\"'<>]{6,})"
)
_NAMES = re.compile(rb"(?i)password|passwd|pwd|secret|token|api[_-]?key|auth|credential|access")
_FORMATS = re.compile(
    rb"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}"
)
_TESTY = re.compile(rb"(?i)test|example|sample|mock|doc")
_WORD = re.compile(r"[a-z]{3,12}")

FEATURES = (
    "length", "entropy", "letters", "digits", "upper", "signs", "changes", "case_changes", "distinct", "longest_same",
    "hexadecimal", "coverage", "assigned", "named_near", "equals", "quoted", "at_sign", "slash", "dot", "word_before",
    "word_after", "line_share", "path_depth", "path_test", "path_hash",
)


def candidates(text: bytes) -> list[tuple[int, int, bool]]:
    """Byte spans of candidates and whether the value is assigned to a secret-like name."""
    spans = [(m.start(1), m.end(1), True) for m in _ASSIGNED.finditer(text)]
    if _DIGIT.search(text):
        for m in _RUN.finditer(text.translate(_KEY)):
            if _DIGIT.search(text, m.start(), m.end()):
                spans.append((m.start(), m.end(), False))
    out: list[tuple[int, int, bool]] = []
    for start, end, assigned in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), assigned or out[-1][2])
        else:
            out.append((start, end, assigned))
    return out


def coverage(value: bytes, words: frozenset[str]) -> float:
    """Share of the letters that dictionary words cover, longest first from the left."""
    text, i, covered = value.decode("latin-1").lower(), 0, 0
    while i < len(text):
        size = next((n for n in range(12, 2, -1) if text[i : i + n] in words and i + n <= len(text)), 0)
        covered += size
        i += size or 1
    letters = sum(c.isalpha() for c in text)
    return covered / letters if letters else 0.0


def describe(text: bytes, start: int, end: int, assigned: bool, path: bytes, words: frozenset[str]) -> list[float]:
    """The features of a candidate, in the order of ``FEATURES``."""
    value, n = text[start:end], end - start
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = value.translate(_KINDS)
    same = max((len(m[0]) for m in re.finditer(rb"(.)\1*", value, re.S)), default=0)
    line = len(text) and n / (len(before.rsplit(b"\n", 1)[-1]) + n + len(after.split(b"\n", 1)[0]))
    left, right = before.split(), after.split()
    return [
        n, entropy, sum(kinds.count(k) for k in b"aA") / n, kinds.count(b"9") / n, kinds.count(b"A") / n,
        kinds.count(b".") / n, sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        sum({a, b} == {65, 97} for a, b in zip(kinds, kinds[1:])) / n, len(counts) / n, same,
        float(all(c in b"0123456789abcdefABCDEF" for c in value)), coverage(value, words), float(assigned),
        float(bool(_NAMES.search(before))), float(before.rstrip()[-1:] in (b"=", b":")), float(before[-1:] in (b'"', b"'")),
        float(b"@" in (before[-1:] + after[:1] + value)), float(b"/" in value or before[-1:] == b"/"), float(b"." in (before[-1:] + after[:1])),
        float(crc32(left[-1].translate(LOWER)) % 32 if left else -1), float(crc32(right[0].translate(LOWER)) % 32 if right else -1),
        line, float(path.count(b"/")), float(bool(_TESTY.search(path))), float(crc32(path.rsplit(b".", 1)[-1]) % 16 if path else -1),
    ]


_KINDS = bytes(
    57 if 48 <= i <= 57 else 65 if 65 <= i <= 90 else 97 if 97 <= i <= 122 or i > 127 else 46 for i in range(256)
)


def known_label(text: bytes, start: int, end: int, features: list[float]) -> int | None:
    """1 or 0 where the form of a candidate settles it, else None."""
    got = dict(zip(FEATURES, features))
    value = text[start:end]
    if _FORMATS.fullmatch(value) or (got["assigned"] and got["digits"] > 0 and got["entropy"] > 2.5):
        return 1
    if got["digits"] == 1 or got["at_sign"] or b"://" in text[max(0, start - NEAR) : end].rsplit(None, 1)[-1]:
        return 0
    return 0 if got["coverage"] > 0.8 and not got["assigned"] else None


# ---- the forest ----


@dataclass
class Tree:
    """Parallel arrays over nodes; a leaf has feature -1. Rows with bin <= cut go left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def predict(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        for _ in range(LEVELS):
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                break
            low = bins[np.arange(len(bins)), np.maximum(feature, 0)] <= self.cut[at]
            at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)
        return self.share[at]


def grow(bins: np.ndarray, label: np.ndarray, seed: int, weight: np.ndarray | None = None) -> Tree:
    """One tree on a (weighted) bootstrap: at each node the best Gini cut of a few random features."""
    rng = np.random.default_rng(seed)
    n, width = bins.shape
    start = rng.integers(0, n, n) if weight is None else rng.choice(n, n, p=weight / weight.sum())
    nodes: list[list] = []
    todo = [(start, 0, -1, "left")]
    while todo:
        rows, depth, parent, side = todo.pop()
        share, me = float(label[rows].mean()), len(nodes)
        nodes.append([-1, 0, 0, 0, share])
        if parent >= 0:
            nodes[parent][2 if side == "left" else 3] = me
        if depth >= LEVELS - 1 or share in (0.0, 1.0) or len(rows) < 2 * LEAST:
            continue
        best = (1e-9, -1, 0)
        for f in rng.choice(width, max(1, int(math.sqrt(width))), replace=False):
            total = np.bincount(bins[rows, f], minlength=BINS).cumsum()
            ones = np.bincount(bins[rows, f], label[rows], minlength=BINS).cumsum()
            left, right = total[:-1], len(rows) - total[:-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                split = left * (ones[:-1] / left) * (1 - ones[:-1] / left) + right * ((ones[-1] - ones[:-1]) / right) * (
                    1 - (ones[-1] - ones[:-1]) / right
                )
            gain = np.where((left >= LEAST) & (right >= LEAST), len(rows) * share * (1 - share) - split, -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), k)
        if best[1] >= 0:
            nodes[me][:2] = best[1:]
            low = bins[rows, best[1]] <= best[2]
            todo += [(rows[low], depth + 1, me, "left"), (rows[~low], depth + 1, me, "right")]
    columns = list(zip(*nodes))
    return Tree(*(np.array(c, np.int64) for c in columns[:4]), np.array(columns[4]))


@dataclass
class Model:
    """Dictionary, bin edges per feature and trees; without trees ``share`` is the answer."""

    words: frozenset[str]
    edges: np.ndarray
    trees: list[Tree]
    share: float = 1.0

    def bins(self, features: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c) for e, c in zip(self.edges, features.T)], axis=1)

    def probability(self, features: np.ndarray) -> np.ndarray:
        if not self.trees or not len(features):
            return np.full(len(features), self.share)
        bins = self.bins(features)
        return np.mean([t.predict(bins) for t in self.trees], axis=0)


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        total: Counter[str] = Counter()
        for text in batch["text"]:
            total.update(text.lower().split())
        kept = {w: n for w, n in total.items() if _WORD.fullmatch(w)}
        if kept:
            yield pd.DataFrame({"word": list(kept), "n": list(kept.values())})


def dictionary(docs: DataFrame, text: str = "text") -> frozenset[str]:
    """The most frequent plain words of all texts; a top-k of fixed size."""
    rows = docs.select(F.col(text).alias("text")).where("text is not null")
    counts = rows.mapInPandas(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return frozenset(r.word for r in counts.orderBy(F.desc("n"), "word").limit(DICTIONARY).collect())


def _labelled(shared):
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, path in zip(batch["text"], batch["path"]):
                for span in candidates(text):
                    features = describe(text, *span, path or b"", shared.value)
                    label = known_label(text, span[0], span[1], features)
                    if label is not None:
                        rows.append((features, label))
            if rows:
                yield pd.DataFrame(rows, columns=["features", "label"])

    return found


def known_findings(docs: DataFrame, words: frozenset[str], *, text: str = "text", path: str | None = "source") -> DataFrame:
    """``features, label`` of the candidates in all documents that their form settles."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    where = F.lit(None).cast("binary") if path is None else F.col(path).cast("string").cast("binary")
    rows = docs.where(F.col(text).isNotNull()).select(utf8(text).alias("text"), where.alias("path"))
    return rows.mapInPandas(_labelled(shared), "features array<double>, label int")


def fit(labelled: DataFrame, words: frozenset[str], *, seed: int = 7) -> Model:
    """A forest from ``features, label``; the trees are grown as Spark tasks."""
    spark = labelled.sparkSession
    # Equal findings are one row with a count, so copies neither crowd out others nor get lost.
    counted = labelled.where("label in (0, 1)").groupBy("features", "label").agg(F.count(F.lit(1)).alias("n"))
    counted = cut_lineage(counted)
    totals = {r["label"]: r["n"] for r in counted.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    order = F.xxhash64(F.to_json(F.struct("features", "label")))
    drawn = [counted.where(F.col("label") == k).orderBy(order).limit(SAMPLE // 2).toPandas() for k in sorted(totals)]
    rows = pd.concat(drawn, ignore_index=True) if drawn else pd.DataFrame(columns=["features", "label", "n"])
    none = np.zeros((len(FEATURES), BINS - 1))
    if rows.empty or rows["label"].nunique() < 2:
        return Model(words, none, [], 1.0 if rows.empty else float(rows["label"].iloc[0]))
    features, label = np.stack(rows["features"]), rows["label"].to_numpy(np.float64)
    # Cuts lie between different values; a feature with few values has a cut for each.
    edges = np.quantile(features, np.linspace(0, 1, BINS + 1)[1:-1], axis=0, method="lower").T
    model = Model(words, edges, [])
    # The labels keep their shares of all findings.
    held = {k: float(part["n"].sum()) for k, part in zip(sorted(totals), drawn)}
    weight = rows["n"].to_numpy(np.float64) * rows["label"].map(lambda k: totals[k] / held[k]).to_numpy(np.float64)
    shared = spark.sparkContext.broadcast((model.bins(features), label, weight, seed))

    def planted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, labels, weights, first = shared.value
        for batch in batches:
            for i in batch["id"]:
                t = grow(bins, labels, first + int(i), weights)
                yield pd.DataFrame({"id": [i], "feature": [t.feature], "cut": [t.cut], "left": [t.left], "right": [t.right], "share": [t.share]})

    schema = "id long, feature array<long>, cut array<long>, left array<long>, right array<long>, share array<double>"
    grown = spark.range(0, TREES, 1, min(TREES, 8)).mapInPandas(planted, schema).toPandas().sort_values("id")
    model.trees = [Tree(*(np.array(x) for x in t[1:])) for t in grown.itertuples(index=False)]
    return model


RESULT = "candidates long, secrets long, spans array<struct<start:long,end:long,probability:double>>, redacted string"


def _judge(text: bytes | None, path: bytes | None, model: Model, threshold: float) -> tuple:
    spans = candidates(text) if text else []
    if not spans:
        return 0, 0, [], None if text is None else text.decode()
    features = np.array([describe(text, *s, path or b"", model.words) for s in spans])
    chance = model.probability(features)
    out, kept, at, chars, secrets = [], [], 0, 0, 0
    for (start, end, _), p in zip(spans, chance):
        chars += len(text[at:start].decode())
        length = len(text[start:end].decode())
        out.append({"start": chars, "end": chars + length, "probability": float(p)})
        kept += [text[at:start], PLACEHOLDER if p >= threshold else text[start:end]]
        secrets += bool(p >= threshold)
        chars, at = chars + length, end
    return len(spans), secrets, out, b"".join([*kept, text[at:]]).decode()


def scan(
    docs: DataFrame, model: Model, *, text: str = "text", path: str | None = "source", threshold: float = 0.5, result: str = "secrets"
) -> DataFrame:
    """Every row of ``docs`` with a struct of ``RESULT``: counts, character spans, redacted text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, paths in batches:
            rows = [_judge(t, p, shared.value, threshold) for t, p in zip(texts, paths)]
            yield pd.DataFrame(rows, columns=["candidates", "secrets", "spans", "redacted"])

    where = F.lit(None).cast("binary") if path is None else F.col(path).cast("string").cast("binary")
    return docs.withColumn(vacant(docs.columns, result), judged.asNondeterministic()(utf8(text), where))


def redact(docs: DataFrame, model: Model, *, text: str = "text", **options) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by a placeholder, columns as given."""
    name = fresh(docs.columns, "secrets")
    return scan(docs, model, text=text, result=name, **options).withColumn(text, F.col(name)["redacted"]).drop(name)
