"""Cosine scores between two sets of vectors, or inside one set, by blocks.

No pair table is built.  Targets whose vectors were measured to fit ``BROADCAST_BYTES`` are
broadcast and multiplied with the candidates where these lie, so no candidate moves.
Beyond that rows are cut into blocks of a bounded size of vectors that lie near each other
(``metric_index``); pairs of blocks that cannot reach the floor are skipped, and a task
receives one block of each side, multiplies the two matrices and keeps only what the
caller can still use.  A camera, label or identity that holds a large share of all rows
simply has more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sightline.operators import metric_index
from sightline.operators.metric_index import units as _units

LEFT_BLOCK = 1024
RIGHT_BLOCK = 4096
# A candidate block of the large case: a target is copied once per so many candidates.
WIDE_BLOCK = 16_384
# Candidates and targets that are multiplied at once, whatever the size of a block or a batch.
TILE = (512, 2048)
# Most bytes of target vectors (as doubles) that are broadcast.
BROADCAST_BYTES = 64 << 20
SLACK = 1e-9


def nothing(columns: list[str]) -> pd.DataFrame:
    """No rows; object columns, because empty float columns do not convert to text."""
    return pd.DataFrame(columns=columns, dtype=object)


def _two_best(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the two largest entries of every row (first of equals)."""
    n, m = scores.shape
    rows = np.arange(n)
    first = scores.argmax(axis=1)
    if m == 1:
        return rows, first
    work = scores.copy()
    work[rows, first] = -np.inf
    second = work.argmax(axis=1)
    return np.concatenate([rows, rows]), np.concatenate([first, second])


def _pick(scores: np.ndarray, attempts: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Entries that can decide a match: two best per candidate and per target and attempt."""
    chosen = [np.stack(_two_best(scores))]
    starts = np.flatnonzero(np.r_[True, attempts[1:] != attempts[:-1]])
    for low, high in zip(starts, np.r_[starts[1:], len(attempts)]):
        cols, rows = _two_best(scores[low:high].T)
        chosen.append(np.stack([rows + low, cols]))
    rows, cols = np.concatenate(chosen, axis=1)
    both = np.divmod(np.unique(rows * scores.shape[1] + cols), scores.shape[1])
    keep = scores[both[0], both[1]]
    ok = np.isfinite(keep) & (keep >= floor)
    return both[0][ok], both[1][ok]


def scored_pairs(
    candidates: DataFrame,
    targets: DataFrame,
    same: list[str],
    floor: float | None = None,
    later_wins: bool = False,
    plates: bool = False,
    every: bool = False,
    ids: tuple[str, ...] = ("attempt", "track_id"),
    left_block: int = WIDE_BLOCK,
    right_block: int = RIGHT_BLOCK,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Scores that can take part in a match, out of all candidate/target pairs.

    ``candidates``: ``same``, ``attempt``, ``track_id``, ``embedding`` [, ``plate``];
    ``targets``: ``same``, ``target_id``, ``centroid`` [, ``plate_number``].  A pair is
    valid when ``same`` agrees, the dimensions agree and, with ``plates``, the two plates
    are not both known and different.

    Returned are, within each tile of a block, the two best targets of a candidate and the two best
    candidates of a target in an attempt, at or above ``floor``.  The overall first and
    second of every list is among them, which is all that thresholds and margins look at.
    With ``every`` all pairs at or above ``floor`` are returned instead, for callers that
    rule out more targets later; a candidate is then named by any ``ids``.
    """
    if every and floor is None:
        raise ValueError("every needs a floor")
    limit = -np.inf if floor is None else floor - SLACK
    types = dict(candidates.dtypes)
    out_types = [(c, types[c]) for c in [*same, *ids]]
    schema = ", ".join(f"`{c}` {t}" for c, t in out_types)
    schema += f", target_id {dict(targets.dtypes)['target_id']}, score double"
    columns_out = [*same, *ids, "target_id", "score"]

    def score(lpdf: pd.DataFrame, rpdf: pd.DataFrame, rights: dict | None = None) -> Iterator[pd.DataFrame]:
        """Pairs to send on, tile by tile: no task holds the scores of a whole block."""
        if not len(lpdf) or not len(rpdf):
            return
        if not every:
            lpdf = lpdf.sort_values(["attempt", "track_id"], ascending=[True, not later_wins])
        if rights is None:
            rpdf = rpdf.rename(columns=lambda c: c.removeprefix("r_")).sort_values("target_id")
            rights = _units(rpdf["centroid"])
        lefts = _units(lpdf["embedding"])
        named = lpdf[[*same, *ids]]
        for dim in lefts.keys() & rights.keys():
            lrows, lmat = lefts[dim]
            rrows, rmat = rights[dim]
            if plates:
                # Equal plates have equal numbers, unknown ones -1.
                both = pd.concat([lpdf["plate"].iloc[lrows], rpdf["plate_number"].iloc[rrows]], ignore_index=True)
                codes = pd.factorize(both)[0]
                a, b = codes[: len(lrows)], codes[len(lrows) :]
            for x in range(0, len(lrows), TILE[0]):
                for y in range(0, len(rrows), TILE[1]):
                    rows, columns = slice(x, x + TILE[0]), slice(y, y + TILE[1])
                    scores = lmat[rows] @ rmat[columns].T
                    if plates:
                        known = (a[rows] >= 0)[:, None] & (b[columns] >= 0)[None, :]
                        scores[known & (a[rows, None] != b[None, columns])] = -np.inf
                    if every:
                        i, j = np.nonzero(scores >= limit)
                    else:
                        i, j = _pick(scores, lpdf["attempt"].to_numpy()[lrows[rows]], limit)
                    if not len(i):
                        continue
                    part = named.iloc[lrows[rows][i]].reset_index(drop=True)
                    part["target_id"] = rpdf["target_id"].to_numpy()[rrows[columns][j]]
                    part["score"] = scores[i, j]
                    yield part[columns_out]

    left_cols = [*same, *ids, "embedding"] + (["plate"] if plates else [])
    right_cols = [*same, "target_id", "centroid"] + (["plate_number"] if plates else [])
    candidates, targets = candidates.select(*left_cols), targets.select(*right_cols)
    if _vector_bytes(targets) <= broadcast_bytes:
        shared = candidates.sparkSession.sparkContext.broadcast(_by_key(targets, same))

        def against_all(batches):
            for pdf in batches:
                for key, part in pdf.groupby(same, sort=False):
                    known = shared.value.get(key)
                    if known is not None:
                        yield from score(part, *known)

        return candidates.dropna(subset=same).mapInPandas(against_all, schema)

    left, right, reached = _reached(candidates, targets, same, ids, None if limit == -np.inf else limit, left_block, right_block)
    on = [*same, "_dim", "_lb", "_rb"]
    reached = reached.where("reachable").select(*on)
    left = left.drop("_angles").withColumnRenamed("_block", "_lb").join(reached, on[:-1])
    right = right.drop("_angles").withColumnRenamed("_block", "_rb").join(reached, [*on[:-2], "_rb"])
    # Both sides often come from one table; fresh names keep their keys apart.
    renamed = right.toDF(*[f"r_{c}" for c in right.columns])

    def together(lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        parts = list(score(lpdf, rpdf))
        return pd.concat(parts) if parts else nothing(columns_out)

    return (
        left.groupBy(*on)
        .cogroup(renamed.groupBy(*[f"r_{c}" for c in on]))
        .applyInPandas(together, schema)
    )


def _reached(
    candidates: DataFrame, targets: DataFrame, same: list[str], ids: tuple[str, ...], floor: float | None, left_block: int, right_block: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides in blocks, and the pairs of blocks with a flag where the floor can be reached."""
    chosen = metric_index.pivots(targets, ["target_id"], "centroid")
    left = metric_index.blocked(metric_index.angled(candidates, "embedding", chosen), same, list(ids), left_block)
    right = metric_index.blocked(metric_index.angled(targets, "centroid", chosen), same, ["target_id"], right_block)
    return left, right, metric_index.block_pairs(left, right, same, floor)


def reach(
    candidates: DataFrame,
    targets: DataFrame,
    same: list[str],
    floor: float,
    ids: tuple[str, ...] = ("attempt", "track_id"),
    left_block: int = WIDE_BLOCK,
    right_block: int = RIGHT_BLOCK,
) -> DataFrame:
    """``block_pairs, multiplied``: how many pairs of blocks ``scored_pairs`` has and multiplies."""
    _, _, reached = _reached(candidates, targets, same, ids, floor - SLACK, left_block, right_block)
    return reached.agg(F.count(F.lit(1)).alias("block_pairs"), F.coalesce(F.sum(F.col("reachable").cast("long")), F.lit(0)).alias("multiplied"))


def _vector_bytes(targets: DataFrame) -> int:
    """Size of all target vectors as doubles; one number."""
    size = targets.agg(F.sum(F.greatest(F.size("centroid"), F.lit(1)) * 8).alias("n")).first()["n"]
    return size or 0


def _by_key(targets: DataFrame, same: list[str]) -> dict[tuple, tuple[pd.DataFrame, dict]]:
    """Targets per key with their unit vectors; only called after their size was checked."""
    pdf = pd.DataFrame([tuple(r) for r in targets.toLocalIterator()], columns=targets.columns)
    found = {}
    for key, part in pdf.dropna(subset=same).sort_values("target_id").groupby(same, sort=False):
        part = part.reset_index(drop=True)
        # Every worker holds this: the vectors once, as a matrix.
        found[key] = (part.drop(columns="centroid"), _units(part["centroid"]))
    return found


def block_grid(df: DataFrame, keys: list[str], block_of: Column, blocks: Column) -> DataFrame:
    """Copy every row to each block pair it takes part in: ``_lo <= _hi``, own ``_b``."""
    return (
        df.withColumn("_b", block_of.cast("int"))
        .withColumn("_c", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
        .withColumn("_lo", F.least("_b", "_c"))
        .withColumn("_hi", F.greatest("_b", "_c"))
        .drop("_c")
    )


def _block_scores(pdf: pd.DataFrame, id_col: str, vec_col: str):
    """Yield ``(left rows, right rows, scores)`` with ``-inf`` where a pair does not count."""
    pdf = pdf.sort_values(id_col, ignore_index=True)
    own = pdf["_b"].to_numpy()
    low, high = int(pdf["_lo"].iloc[0]), int(pdf["_hi"].iloc[0])
    for rows, matrix in _units(pdf[vec_col]).values():
        side = own[rows]
        a, b = np.flatnonzero(side == low), np.flatnonzero(side == high)
        if not len(a) or not len(b):
            continue
        scores = matrix[a] @ matrix[b].T
        if low == high:
            scores[np.tril_indices(len(a))] = -np.inf
        yield pdf.iloc[rows[a]], pdf.iloc[rows[b]], scores


def _bank_grid(refs: DataFrame, keys: list[str], block: int) -> DataFrame:
    sizes = refs.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).alias("_n"))
    placed = refs.select(*keys, "embedding_index", "embedding").join(sizes, keys)
    home = F.pmod(F.xxhash64("embedding_index"), F.col("_n"))
    return block_grid(placed, keys, home, F.col("_n")).drop("_n")


def bank_pairs(refs: DataFrame, keys: list[str], block: int = LEFT_BLOCK) -> DataFrame:
    """Cosine of every unordered pair of references of an identity (``index_a < index_b``)."""
    types = dict(refs.dtypes)
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)
    index = types["embedding_index"]
    schema = f"{head}, index_a {index}, index_b {index}, score double"

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for left, right, scores in _block_scores(pdf, "embedding_index", "embedding"):
            i, j = np.nonzero(np.isfinite(scores))
            a = left["embedding_index"].to_numpy()[i]
            b = right["embedding_index"].to_numpy()[j]
            part = left.iloc[i][keys].reset_index(drop=True)
            part["index_a"], part["index_b"] = np.minimum(a, b), np.maximum(a, b)
            part["score"] = scores[i, j]
            parts.append(part)
        names = [*keys, "index_a", "index_b", "score"]
        return pd.concat(parts)[names] if parts else nothing(names)

    return _bank_grid(refs, keys, block).groupBy(*keys, "_lo", "_hi").applyInPandas(pairs, schema)


def redundancy(refs: DataFrame, keys: list[str], block: int = LEFT_BLOCK) -> DataFrame:
    """Largest cosine of each reference with another one of its identity; alone means 0."""
    types = dict(refs.dtypes)
    head = ", ".join(f"`{k}` {types[k]}" for k in keys)
    schema = f"{head}, embedding_index {types['embedding_index']}, score double"

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for left, right, scores in _block_scores(pdf, "embedding_index", "embedding"):
            for side, values in ((left, scores.max(axis=1)), (right, scores.max(axis=0))):
                part = side[[*keys, "embedding_index"]].reset_index(drop=True)
                part["score"] = values
                parts.append(part[np.isfinite(values)])
        names = [*keys, "embedding_index", "score"]
        return pd.concat(parts)[names] if parts else nothing(names)

    found = (
        _bank_grid(refs, keys, block)
        .groupBy(*keys, "_lo", "_hi")
        .applyInPandas(best, schema)
        .groupBy(*keys, "embedding_index")
        .agg(F.max("score").alias("redundancy"))
    )
    return refs.select(*keys, "embedding_index").join(found, [*keys, "embedding_index"], "left").withColumn(
        "redundancy", F.coalesce("redundancy", F.lit(0.0))
    )


def support(pairs: DataFrame, refs: DataFrame, on: list[str], top_k: int) -> DataFrame:
    """Add the mean of the ``top_k`` best reference similarities of each pair.

    ``pairs`` carries ``embedding`` and ``pair_key`` columns that identify it; all
    available references are used when there are fewer than ``top_k``.
    """
    from sightline.functions.vectors import cosine

    joined = pairs.join(refs.select(*on, F.col("embedding").alias("_ref")), on)
    scored = joined.withColumn("_s", cosine(F.col("embedding"), F.col("_ref"))).where(
        F.col("_s").isNotNull()
    )
    keep = [c for c in pairs.columns if c != "embedding"]
    order = Window.partitionBy(*keep).orderBy(F.desc("_s"))
    return (
        scored.withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= top_k)
        .groupBy(*keep)
        .agg(F.avg("_s").alias("support"))
    )
