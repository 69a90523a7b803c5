import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import topk


def brute(rows, k):
    exact = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            exact.append((i, [math.floor(1024 * x) for x in v]))
    out = []
    for q in {i for i, _ in exact if i % 2 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(w, v)), c) for i, w in exact if i == q for c, v in exact if c != q)
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, k=3):
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, q int")
    return sorted(tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 2 == 0, k=k).collect())


def test_like_brute_force_with_odd_rows_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=40) * (1 + i % 3)).tolist()) for i in range(60)]
    rows += [(100 + i, rows[4][1]) for i in range(8)]
    # Ids with several rows: equal ones and different ones, of a candidate and of a query.
    rows += [(5, rows[5][1]), (7, rows[9][1]), (7, rows[11][1]), (8, rows[3][1]), (200, None), (201, [1.0, None]), (202, [math.nan] * 40), (203, [math.inf] * 40), (204, []), (206, [0.5]), (None, [1.0])]
    assert run(spark, rows) == brute(rows, 3)


def test_fewer_rows_than_k_and_empty(spark):
    rows = [(0, [0.1, 0.2]), (1, [0.3, -0.4])]
    assert run(spark, rows, k=10) == brute(rows, 10)
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []


def test_large_components_stay_exact(spark):
    rows = [(i, [3e5 + i, 2e5 - i, 1e5 + 3 * i]) for i in range(8)]
    assert run(spark, rows) == brute(rows, 3)


def test_too_large_scores_raise(spark):
    with pytest.raises(Exception, match="does not fit a long"):
        run(spark, [(0, [1e12]), (1, [1e12])])


def test_bounds_never_lose_a_candidate():
    rng = np.random.default_rng(5)
    for _ in range(50):
        columns = np.floor(rng.normal(size=(48, 200)) * 1024)
        query = np.floor(rng.normal(size=48) * rng.choice([1, 0.01], 48) * 1024)
        norms = (columns**2).sum(axis=0)
        blocks = {a: (columns[a : a + 16] ** 2).sum(axis=0) for a in range(0, 48, 16)}
        ids, scores = topk.best(query, -1, np.arange(200), columns, norms, blocks, 10)
        want = query @ columns
        order = np.lexsort((np.arange(200), -want))[:10]
        assert ids.tolist() == order.tolist() and scores.tolist() == want[order].astype(int).tolist()
