"""Similarity distributions of labelled embeddings and balanced sampling of images."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sightline.operators.similarity import _units, block_grid

# Cells of the histogram per unit: scores lie in [-1, 1], so a task has at most 4 099 of a kind.
CELLS = 2048
# Cells of a published histogram.
FINE_CELLS = 1_000_000
# A cell that holds a wanted order statistic is cut into so many, until so few pairs are in it.
RADIX, LISTED = 1 << 14, 1 << 15
# Digits after which a cell holds a handful of different doubles at most.
DIGITS = 4
QUANTILES = (0.1, 0.5, 0.9, 0.95)
# Samples of a block, and scores of a block pair that are looked at together: few enough for a core's cache.
MAX_BLOCK = 8192
TILE = (256, 1024)
# Scores that a fine histogram takes in together, as its arrays are large.
HELD = 1 << 21
# Tasks per core; a task counts the pairs of many block pairs before it hands anything on.
TASKS = 4


def _blocks(samples: DataFrame, block: int | None) -> DataFrame:
    """Samples dealt to block pairs, so that every unordered pair meets in one; a task gets whole ones in turn."""
    total = samples.count()
    cores = samples.sparkSession.sparkContext.defaultParallelism
    if block is None:
        # Small inputs are cut finer, so that every core gets a block pair.
        block = min(MAX_BLOCK, max(256, math.ceil(total / (2 * math.sqrt(cores)))))
    blocks = max(1, -(-total // block))
    home = F.pmod(F.xxhash64("name"), F.lit(blocks))
    grid = block_grid(samples.select("name", "label", "embedding"), [], home, F.lit(blocks))
    tasks = min(blocks * (blocks + 1) // 2, TASKS * cores)
    return grid.repartition(tasks, "_lo", "_hi").sortWithinPartitions("_lo", "_hi")


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one block pair after another."""
    held, key = [], None
    for pdf in batches:
        for now, part in pdf.groupby(["_lo", "_hi"]):
            if now != key and held:
                yield pd.concat(held)
                held = []
            key = now
            held.append(part)
    if held:
        yield pd.concat(held)


def _tiles(batches: Iterator[pd.DataFrame]):
    """Per tile of pairs: row names, column names, scores, which have one label, and which count (``None``: all)."""
    for pdf in _groups(batches):
        pdf = pdf.sort_values("name", ignore_index=True)
        own, names = pdf["_b"].to_numpy(), pdf["name"].to_numpy()
        labels, low, high = pd.factorize(pdf["label"])[0], pdf["_lo"].iloc[0], pdf["_hi"].iloc[0]
        for rows, matrix in _units(pdf["embedding"]).values():
            side = own[rows]
            a, b = np.flatnonzero(side == low), np.flatnonzero(side == high)
            for i in range(0, len(a), TILE[0]):
                for j in range(0, len(b), TILE[1]):
                    x, y = a[i : i + TILE[0]], b[j : j + TILE[1]]
                    if low == high and y[-1] <= x[0]:
                        continue
                    left, right = labels[rows[x]], labels[rows[y]]
                    same = (left[:, None] == right[None, :]) & (left >= 0)[:, None]
                    counts = x[:, None] < y[None, :] if low == high and y[0] <= x[-1] else None
                    yield names[rows[x]], names[rows[y]], matrix[x] @ matrix[y].T, same, counts


def _cells(scores: np.ndarray, cells: int, kind: np.dtype | type) -> np.ndarray:
    """Number of each score's cell, from zero."""
    at = np.multiply(scores, cells)
    np.rint(at, out=at)
    at += cells + 1
    return at.astype(kind)


class _Kind:
    """The hardest pair and the extremes of one kind."""

    def __init__(self):
        self.hardest: tuple | None = None
        self.least, self.largest = np.inf, -np.inf

    def judge(self, flag: bool, rows: np.ndarray, columns: np.ndarray, scores: np.ndarray, mask: np.ndarray, least: float, largest: float) -> None:
        """``least`` and ``largest`` are those of all scores of the tile, so most tiles need no second look."""
        if least < self.least:
            self.least = min(self.least, scores.min(where=mask, initial=np.inf))
        if largest > self.largest:
            self.largest = max(self.largest, scores.max(where=mask, initial=-np.inf))
        if self.hardest is not None and (least > self.hardest[0] if flag else largest < self.hardest[0]):
            return
        worst = scores.min(where=mask, initial=np.inf) if flag else scores.max(where=mask, initial=-np.inf)
        if not np.isfinite(worst) or self.hardest is not None and (worst > self.hardest[0] if flag else worst < self.hardest[0]):
            return
        i, j = np.nonzero(mask & (scores == worst))
        x, y = rows[i], columns[j]
        first, second = np.where(x < y, x, y), np.where(x < y, y, x)
        k = np.lexsort((second, first))[0]
        found = (worst, first[k], second[k])
        if self.hardest is None or worst != self.hardest[0] or found[1:] < self.hardest[1:]:
            self.hardest = found


class _Histogram:
    """Pairs of both kinds per cell, and the hardest of them."""

    def __init__(self, cells: int, extremes: bool):
        self.cells, self.extremes, self.size = cells, extremes, 2 * cells + 3
        # Pairs of two labels, pairs of one label, and a place for what does not count.
        self.pairs, self.total = np.zeros(2 * self.size + 1, np.int64), np.zeros(2 * self.size + 1)
        self.low, self.high = (np.full(2 * self.size + 1, x) if extremes else None for x in (np.inf, -np.inf))
        self.kinds = {True: _Kind(), False: _Kind()}
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, rows: np.ndarray, columns: np.ndarray, scores: np.ndarray, same: np.ndarray, counts: np.ndarray | None) -> None:
        at = _cells(scores, self.cells, np.intp)
        np.add(at, self.size, out=at, where=same)
        if counts is not None:
            at[~counts] = 2 * self.size
        least, largest = scores.min(), scores.max()
        for flag, kind in self.kinds.items():
            mask = same if flag else ~same
            kind.judge(flag, rows, columns, scores, mask if counts is None else mask & counts, least, largest)
        if self.extremes:
            self.held.append((at.ravel(), scores.ravel()))
            self.waiting += at.size
            if self.waiting >= HELD:
                self.flush()
        else:
            self._count(at.ravel(), scores.ravel())

    def _count(self, at: np.ndarray, scores: np.ndarray) -> None:
        self.pairs += np.bincount(at, minlength=len(self.pairs))
        self.total += np.bincount(at, scores, minlength=len(self.pairs))

    def flush(self) -> None:
        if not self.held:
            return
        at, scores = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.waiting = [], 0
        self._count(at, scores)
        # Few scores are a new extreme once a cell has seen some.
        for ends, beyond, put in ((self.low, np.less, np.minimum), (self.high, np.greater, np.maximum)):
            new = np.flatnonzero(beyond(scores, ends[at]))
            put.at(ends, at[new], scores[new])

    def rows(self, names: list[str]) -> Iterator[pd.DataFrame]:
        self.flush()
        for flag, kind in self.kinds.items():
            if kind.hardest is None:
                continue
            first = self.size if flag else 0
            used = first + np.flatnonzero(self.pairs[first : first + self.size])
            if self.extremes:
                low, high = self.low, self.high
            else:
                low, high = np.full(len(self.pairs), np.inf), np.full(len(self.pairs), -np.inf)
                low[used[0]], high[used[-1]] = kind.least, kind.largest
            for i in range(0, len(used), 1 << 16):
                at = used[i : i + (1 << 16)]
                ends = (np.where(np.isfinite(e[at]), e[at], np.nan) for e in (low, high))
                part = pd.DataFrame({"same_label": flag, "cell": at - first - self.cells - 1, "pairs": self.pairs[at], "total": self.total[at]})
                part["low"], part["high"] = (pd.array(e, "Float64") for e in ends)
                yield part.reindex(columns=names).astype({"hardest": object, "a": object, "b": object}).replace({np.nan: None})
            worst, a, b = kind.hardest
            cell = int(np.rint(worst * self.cells))
            yield pd.DataFrame([(flag, cell, 0, 0.0, None, None, worst, a, b)], columns=names)


def pair_histogram(samples: DataFrame, block: int | None = None, cells: int = CELLS, extremes: bool = True) -> DataFrame:
    """Pairs per ``(same_label, cell)``: their number, sum, extremes, and the hardest pair.

    ``samples``: ``name``, ``label``, ``embedding``.  Pairs are never materialised: a task
    multiplies its block pairs and counts them all in one array of ``cells`` a unit.  A label
    with many samples is spread over blocks like everything else.  Only the cell is rounded;
    ``low``, ``high``, ``total`` and the hardest pair (lowest score inside a label, highest
    across labels, the first names among equals) come from the scores themselves.  Without
    ``extremes`` only the least ``low`` and the largest ``high`` of a kind are right.
    """
    kind = dict(samples.dtypes)["name"]
    schema = f"same_label boolean, cell bigint, pairs bigint, total double, low double, high double, hardest double, a {kind}, b {kind}"
    names = ["same_label", "cell", "pairs", "total", "low", "high", "hardest", "a", "b"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = _Histogram(cells, extremes)
        for tile in _tiles(batches):
            found.add(*tile)
        yield from found.rows(names)

    partial = _blocks(samples, block).mapInPandas(count, schema)
    sign = F.when(F.col("same_label"), 1).otherwise(-1)
    pair = F.when(F.col("a").isNotNull(), F.struct((F.col("hardest") * sign).alias("rank"), "a", "b", "hardest"))
    return partial.groupBy("same_label", "cell").agg(
        F.sum("pairs").alias("pairs"),
        F.sum("total").alias("total"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.min(pair).alias("pair"),
    )


def _inside(values: np.ndarray, path: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Values in the cell that ``path`` names, and how far (0 to 1) each lies in it.

    The first number of a path is a cell of the histogram, each further one a digit inside the cell
    before. Digits are powers of two, so all steps are exact.
    """
    scaled = values * CELLS
    here = np.rint(scaled) == path[0]
    values, rest = values[here], scaled[here] - path[0] + 0.5
    for digit in path[1:]:
        cut = np.minimum(np.floor(rest * RADIX), RADIX - 1)
        here = cut == digit
        values, rest = values[here], rest[here] * RADIX - digit
    return values, rest


def _paths(samples: DataFrame, block: int | None, paths: set, listed: bool) -> dict[tuple, list[tuple[float, int]]]:
    """For each (kind, path): pairs by next digit, or by score itself. Bounded, so it comes to the driver."""
    names = ["path", "value", "pairs"]
    ordered = sorted(paths)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = 2 * CELLS + 3
        wanted = sorted({path[0] + CELLS + 1 + size * flag for flag, path in ordered})
        found: dict[int, dict[float, int]] = {}
        for _, _, scores, same, counts in _tiles(batches):
            at = _cells(scores, CELLS, np.int16)
            np.add(at, np.int16(size), out=at, where=same)
            # Few scores lie in a cell that holds a wanted rank.
            near = at == wanted[0]
            for cell in wanted[1:]:
                near |= at == cell
            if counts is not None:
                near &= counts
            some = np.flatnonzero(near)
            flags, chosen = same.ravel()[some], scores.ravel()[some]
            for i, (kind, path) in enumerate(ordered):
                values = chosen[flags == kind]
                if not len(values):
                    continue
                here, rest = _inside(values, path)
                if not listed:
                    here = np.minimum(np.floor(rest * RADIX), RADIX - 1)
                seen = found.setdefault(i, {})
                for value, n in zip(*(x.tolist() for x in np.unique(here, return_counts=True))):
                    seen[value] = seen.get(value, 0) + n
        for i, seen in found.items():
            yield pd.DataFrame({"path": i, "value": list(seen.keys()), "pairs": list(seen.values())}, columns=names)

    counted = _blocks(samples, block).mapInPandas(count, "path int, value double, pairs bigint")
    rows = counted.groupBy("path", "value").agg(F.sum("pairs").alias("pairs")).collect()
    out: dict[tuple, list[tuple[float, int]]] = {p: [] for p in ordered}
    for r in sorted(rows):
        out[ordered[r.path]].append((r.value, r.pairs))
    return out


def _place(counts: list[tuple[float, int]], rank: int) -> tuple[float, int, int]:
    """Value that holds the pair of this rank (from zero), the rank inside it, and its pairs."""
    for value, n in counts:
        if rank < n:
            return value, rank, n
        rank -= n
    raise ValueError("a rank beyond the last pair")


def _order_statistics(samples: DataFrame, block: int | None, cells: dict, wanted: set) -> dict[tuple[bool, int], float]:
    """Scores of the wanted (kind, rank), all found in the same passes.

    Radix descent: the histogram names the cell of a rank, a pass over the pairs cuts the cells that
    still hold many of them, and the last pass reads the scores of the cells that are left.
    """
    at = {}
    for flag, rank in wanted:
        cell, inner, n = _place(cells[flag], rank)
        at[flag, rank] = ((int(cell),), inner, n)
    while True:
        wide = {(flag, path) for (flag, _), (path, _, n) in at.items() if n > LISTED and len(path) <= DIGITS}
        if not wide:
            break
        digits = _paths(samples, block, wide, listed=False)
        for (flag, rank), (path, inner, _) in list(at.items()):
            if (flag, path) in wide:
                digit, inner, n = _place(digits[flag, path], inner)
                at[flag, rank] = ((*path, int(digit)), inner, n)
    scores = _paths(samples, block, {(flag, path) for (flag, _), (path, _, _) in at.items()}, listed=True)
    return {key: _place(scores[key[0], path], inner)[0] for key, (path, inner, _) in at.items()}


def distribution(samples: DataFrame, block: int | None = None, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """min, percentiles (linear interpolation), mean and max of both kinds of pairs; all are exact."""
    labels = ["p10", "median", "p90", "p95"] if quantiles == QUANTILES else [f"q{i}" for i in range(len(quantiles))]
    # At most 4 099 cells of each kind.
    histogram = pair_histogram(samples, block, extremes=False).drop("pair").collect()
    kinds: dict[bool, list] = {}
    for r in sorted(histogram, key=lambda r: r.cell):
        kinds.setdefault(r.same_label, []).append(r)
    cells = {flag: [(r.cell, r.pairs) for r in found] for flag, found in kinds.items()}
    sizes = {flag: sum(n for _, n in found) for flag, found in cells.items()}
    spots = {(flag, q): (n - 1) * q for flag, n in sizes.items() for q in quantiles}
    wanted = {(flag, rank) for (flag, _), x in spots.items() for rank in (math.floor(x), math.ceil(x))}
    score = _order_statistics(samples, block, cells, wanted) if wanted else {}
    rows = []
    for flag, found in kinds.items():
        middle = []
        for q in quantiles:
            x = spots[flag, q]
            low, high = score[flag, math.floor(x)], score[flag, math.ceil(x)]
            middle.append(low + (high - low) * (x - math.floor(x)))
        mean = math.fsum(r.total for r in found) / sizes[flag]
        rows.append((flag, sizes[flag], min(r.low for r in found if r.low is not None), *middle, mean, max(r.high for r in found if r.high is not None)))
    columns = ", ".join(f"{c} double" for c in ("min", *labels, "mean", "max"))
    return samples.sparkSession.createDataFrame(rows, f"same_label boolean, n_pairs bigint, {columns}")


def hardest_pairs(histogram: DataFrame) -> DataFrame:
    """Lowest pair inside a label and highest pair across labels."""
    best = histogram.groupBy("same_label").agg(F.min("pair").alias("m"))
    return best.select(
        F.when(F.col("same_label"), "hardest_positive").otherwise("hardest_negative").alias("kind"),
        F.col("m.hardest").alias("score"),
        F.col("m.a").alias("a"),
        F.col("m.b").alias("b"),
    )


def eligible_identities(images: DataFrame, valid, per_identity: int) -> DataFrame:
    counts = images.where(valid).groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("available"))
    return counts.where(F.col("available") >= per_identity)


def balanced_sample(
    images: DataFrame, valid, identities: int, per_identity: int, seed: str
) -> DataFrame:
    """Pick identities, then images round-robin over their cameras, in a seeded order.

    The order is a digest of seed and name, so the same rows are picked on any cluster
    and for any partitioning.  Fewer eligible identities than asked for are an error.
    """
    short = sampling_shortage(images, valid, identities, per_identity).first()
    if short is not None:
        raise ValueError(f"{short.eligible} identities have {per_identity} valid images, {identities} are wanted")

    def digest(*parts):
        return F.md5(F.concat_ws("|", F.lit(seed), *parts))

    chosen = (
        eligible_identities(images, valid, per_identity)
        .withColumn("_order", digest("vehicle_id"))
        .orderBy("_order")
        .limit(identities)
        .select("vehicle_id")
    )
    camera = F.coalesce("camera_id", F.lit("(no camera)"))
    pool = images.where(valid).join(chosen, "vehicle_id").withColumn("_camera", camera)
    in_camera = Window.partitionBy("vehicle_id", "_camera").orderBy(digest("image_name"), "image_name")
    across = Window.partitionBy("vehicle_id").orderBy(
        "_round", digest("vehicle_id", "_camera"), "_camera"
    )
    return (
        pool.withColumn("_round", F.row_number().over(in_camera))
        .where(F.col("_round") <= per_identity)
        .withColumn("pick", F.row_number().over(across))
        .where(F.col("pick") <= per_identity)
        .drop("_camera", "_round")
    )


def sampling_shortage(images: DataFrame, valid, identities: int, per_identity: int) -> DataFrame:
    """One row with the number of eligible identities when there are too few."""
    eligible = eligible_identities(images, valid, per_identity).agg(F.count(F.lit(1)).alias("eligible"))
    return eligible.where(F.col("eligible") < identities)
