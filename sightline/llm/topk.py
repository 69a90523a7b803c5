"""Exact top-k by inner product: columnar branch and bound over dimension blocks.

Vectors become whole numbers, floor(scale * x), so scores are exact. Candidates and queries
are dealt into blocks by a hash of their id; each pair of a candidate block and a query block
is one bounded task. Inside, candidates lie dimension by dimension (vertical layout). A query
visits the dimension blocks in the order of its own mass, adds up partial scores, and drops
every candidate whose partial score plus the largest possible rest (Cauchy-Schwarz over the
remaining mass of both vectors) is below the k-th best sure score; the survivors are compacted
before the next block. Each task gives at most k rows per query, and a window takes the best k
of these. Only the number of rows goes to the driver, to choose the number of blocks.

Defined results: vectors that are null, or hold a null, NaN or infinite component, and rows
without an id take no part; rows that repeat an id are candidates each, for queries of other ids,
and queries of one id share one list of k; a shorter vector counts as padded with zeros; ties go to
the smaller id; with fewer than k other rows there are fewer results; further columns do not matter.
Scores that do not fit a long raise an error.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 10
SCALE = 1024
#: Rows of a candidate block and of a query block, on average, and dimensions of a block.
CANDIDATE_ROWS, QUERY_ROWS, DIMENSIONS = 16_384, 4_096, 16
#: Sums below this are exact in double precision.
EXACT = float(1 << 52)

RESULT = "query_id long, vec_id long, score long"


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Whole-number vectors as columns: one row per dimension."""
    out = np.zeros((width, len(vectors)))
    for i, v in enumerate(vectors):
        out[: len(v), i] = v
    return out


def _by_mass(query: np.ndarray) -> list[slice]:
    blocks = [slice(a, a + DIMENSIONS) for a in range(0, len(query), DIMENSIONS)]
    return sorted(blocks, key=lambda b: -float(query[b] @ query[b]))


def best(query: np.ndarray, own: int, ids: np.ndarray, columns: np.ndarray, norms: np.ndarray, block_norms: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the candidates that can be among the best k of this block."""
    alive = np.flatnonzero(ids != own)
    partial = np.zeros(len(alive))
    rest_query, rest = float(query @ query), norms[alive].copy()
    for block in _by_mass(query):
        partial += query[block] @ columns[block][:, alive]
        rest_query -= float(query[block] @ query[block])
        rest -= block_norms[block.start][alive]
        if len(alive) > k:
            # One more than the rounded bound: roots are rounded, sums of whole numbers are not.
            bound = np.sqrt(np.maximum(rest, 0) * max(rest_query, 0.0)) + 1
            sure = np.partition(partial - bound, len(alive) - k)[len(alive) - k]
            keep = partial + bound >= sure
            if not keep.all():
                alive, partial, rest = alive[keep], partial[keep], rest[keep]
    order = np.lexsort((ids[alive], -partial))[:k]
    return ids[alive][order], partial[order].astype(np.int64)


def _exact(query: list, own: int, ids: np.ndarray, vectors: list, k: int) -> tuple[list, list]:
    """The same for numbers too large for exact doubles, with Python's whole numbers."""
    scores = [(-sum(int(a) * int(b) for a, b in zip(query, v)), int(i)) for i, v in zip(ids, vectors) if i != own]
    scores = sorted(scores)[:k]
    if any(abs(s) >= 1 << 63 for s, _ in scores):
        raise OverflowError("an inner product does not fit a long")
    return [i for _, i in scores], [-s for s, _ in scores]


def _search(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def search(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        if len(candidates) and len(queries):
            width = max(max(map(len, candidates["v"])), max(map(len, queries["v"])), 1)
            columns, ids = _matrix(candidates["v"], width), candidates["id"].to_numpy()
            wanted = _matrix(queries["v"], width)
            largest = float(np.abs(columns).max(initial=0)) * float(np.abs(wanted).max(initial=0))
            largest = max(largest, float(np.abs(columns).max(initial=0)) ** 2, float(np.abs(wanted).max(initial=0)) ** 2)
            if largest * width < EXACT:
                squares = columns * columns
                block_norms = {a: squares[a : a + DIMENSIONS].sum(axis=0) for a in range(0, width, DIMENSIONS)}
                norms = squares.sum(axis=0)
                for own, query in zip(queries["id"], wanted.T):
                    found.append((own, *best(query, own, ids, columns, norms, block_norms, k)))
            else:
                for own, query in zip(queries["id"], queries["v"]):
                    found.append((own, *_exact(query, own, ids, list(candidates["v"]), k)))
        return pd.DataFrame(
            {
                "query_id": np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64),
                "vec_id": np.concatenate([np.empty(0, np.int64), *(f[1] for f in found)]).astype(np.int64),
                "score": np.concatenate([np.empty(0, np.int64), *(np.asarray(f[2], np.int64) for f in found)]),
            }
        )

    return search


def top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    scale: int = SCALE,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row its k best among all other rows."""
    v = F.col(vector)
    # NaN and infinity are the values for which x - x is not 0.
    sound = v.isNotNull() & F.forall(v, lambda x: F.coalesce(x.cast("double") - x.cast("double") == 0, F.lit(False)))
    rows = vectors.where(sound & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"),
        F.transform(v, lambda x: F.floor(scale * x.cast("double")).cast("double")).alias("v"),
        is_query.alias("q"),
    )
    number = vectors.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    spread = vectors.sparkSession.sparkContext.defaultParallelism
    parts = max(min(4 * spread, number[0] // 512 + 1), -(-number[0] // CANDIDATE_ROWS))
    shares = max(1, -(-number[1] // QUERY_ROWS))

    def copies(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    candidates = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), copies(shares).alias("share"))
    queries = rows.where("q").select(
        "id", "v", copies(parts).alias("part"), F.pmod(F.xxhash64(F.lit("q"), "id"), F.lit(shares)).cast("int").alias("share")
    )
    found = candidates.groupBy("part", "share").cogroup(queries.groupBy("part", "share")).applyInPandas(_search(k), RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
