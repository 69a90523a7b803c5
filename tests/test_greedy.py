"""Greedy choices of crowded frames in rounds, against the plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sightline.operators import greedy


def walk_pairs(data):
    """What a walk over the pairs of each frame takes: best score first, then higher numbers."""
    used, want = set(), []
    for f, a, b, s in sorted(data, key=lambda r: (r[3], r[1], r[2]), reverse=True):
        if ("a", f, a) not in used and ("b", f, b) not in used:
            used |= {("a", f, a), ("b", f, b)}
            want.append((f, a, b, s))
    return want


def pairs(seed):
    """One frame with most of all pairs, a chain in which each pair is beaten by the next, usual frames."""
    rng = random.Random(seed)
    data = [(7, a, b, rng.choice([0.3, 0.5, 0.7, rng.random()])) for a in range(60) for b in range(60) if rng.random() < 0.3]
    data += [(8, (i + 1) // 2, 1000 + i // 2, i / 100) for i in range(40)]
    data += [(f, a, b, rng.random()) for f in range(5) for a in range(3) for b in range(3)]
    return data + [(None, a, b, rng.random()) for a in range(6) for b in range(6)]


@pytest.mark.parametrize("dense", [16, 256])
def test_pairs(spark, dense):
    data = pairs(1)
    df = spark.createDataFrame([(*r, "extra") for r in data], "frame_index bigint, a bigint, b bigint, iou double, _at string")
    df = df.withColumnRenamed("_at", "note")
    got = greedy.greedy_pairs(df, ["frame_index"], "a", "b", "iou", dense=dense)
    assert got.columns == df.columns
    key = lambda r: (r[0] is not None, r)
    assert sorted(map(tuple, got.drop("note").collect()), key=key) == sorted(walk_pairs(data), key=key)


def iou(p, q):
    w = max(0.0, min(p[2], q[2]) - max(p[0], q[0])) * max(0.0, min(p[3], q[3]) - max(p[1], q[1]))
    u = (p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - w
    return w / u if u > 0 else 0.0


def walk_boxes(data, limit):
    kept = []
    for r in sorted(data, key=lambda r: (-r[2], r[1])):
        if not any(k[0] == r[0] and iou(k[3:], r[3:]) > limit for k in kept):
            kept.append(r)
    return kept


def boxes(seed, n):
    """A crowd around a few places, piles of equal boxes, boxes of very different sizes, and usual frames."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        x, y, s = rng.choice([(0, 0), (40, 10), (300, 200)]), rng.random() * 30, rng.choice([4, 20, 22, 90, 5000])
        left = x[0] + rng.random() * 40
        data.append((1, i, round(rng.random(), 2), left, x[1] + y, left + s * rng.uniform(0.8, 1.2), x[1] + y + s))
    data += [(1, n + i, 0.5, 100.0, 100.0, 130.0, 140.0) for i in range(n // 4)]
    data += [(1, 9000, 0.9, 5.0, 5.0, 5.0, 9.0), (1, 9001, 0.9, -50.0, -20.0, -10.0, 3.0), (1, 9002, 0.8, -52.0, -21.0, -11.0, 3.0)]
    return data + [(f, i, rng.random(), x, 0.0, x + 10, 10.0) for f in range(2, 8) for i, x in enumerate([0.0, 1.0, 8.0, 30.0])]


@pytest.mark.parametrize("limit", [0.1, 0.5, 0.9, 0.0])
def test_boxes(spark, limit):
    data = boxes(2, 240)
    df = spark.createDataFrame(data, "frame int, i int, score double, x1 double, y1 double, x2 double, y2 double")
    got = greedy.suppress(df, ["frame"], [F.desc("score"), "i"], limit, dense=20)
    assert rows(got.select("frame", "i")) == sorted((r[0], r[1]) for r in walk_boxes(data, limit))
    assert got.columns == df.columns


def test_no_frame_is_gathered_beyond_the_limit(spark):
    """What is collected for a frame is bounded, and rounds read no array of a frame."""
    df = spark.range(2000).selectExpr("id div 10000 as frame_index", "id as a", "id as b", "cast(id % 10 as double) as iou")
    assert greedy.greedy_pairs(df, ["frame_index"], "a", "b", "iou").count() == 2000
    ranked = df.withColumn("_r", F.row_number().over(greedy.Window.partitionBy("frame_index").orderBy(F.desc("iou"))))
    plan = ranked.where(F.col("_r") <= greedy.DENSE + 1)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # ranks are limited before the shuffle


def test_empty(spark):
    df = spark.createDataFrame([], "frame int, i int, score double, x1 double, y1 double, x2 double, y2 double")
    assert greedy.suppress(df, ["frame"], ["i"], 0.5).count() == 0
