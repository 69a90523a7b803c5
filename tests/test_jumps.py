"""Marks along a key by chunks, tables and groups of tables, against the plain walk."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from sightline.operators import jumps, sequences


def walked(times, gap):
    kept = []
    for t in sorted(set(times)):
        if not kept or t - kept[-1] >= gap:
            kept.append(t)
    return kept


def data(seed):
    rng = random.Random(seed)
    keys = {"hot": [rng.randint(0, 4000) for _ in range(3000)], "even": list(range(0, 2600)), "one": [5], None: [rng.randint(-500, 500) for _ in range(60)]}
    keys["pauses"] = [b + rng.randint(0, 9) for b in (-900, 0, 3, 777, 778, 5000) for _ in range(6)]
    return keys


@pytest.mark.parametrize("gap, span, fan", [(5, 64, 1024), (7, 1, 2), (3, 2, 3), (100, 1, 4), (10_000, 64, 2)])
def test_marks(spark, monkeypatch, gap, span, fan):
    monkeypatch.setattr(jumps, "SPAN", span)
    monkeypatch.setattr(jumps, "FAN", fan)
    keys = data(gap)
    df = spark.createDataFrame([(k, t) for k, ts in keys.items() for t in ts] + [("one", None)], "k string, t int")
    got = jumps.marks(df, ["k"], "t", gap)
    assert dict(got.dtypes)["t"] == "int"
    found = got.collect()
    assert Counter(map(tuple, found)) == Counter((k, t) for k, ts in keys.items() for t in walked(ts, gap))


def test_a_hot_key_is_spread_over_tasks(spark):
    """One key with nearly all rows: no task of the walk reads more than twice the median."""
    df = spark.range(400_000).select(F.lit("hot").alias("k"), (F.col("id") * 3 % 400_000).alias("t"))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        times = df.withColumn("_c", F.floor(F.col("t") / (jumps.SPAN * 5)))
        sizes = [r["n"] for r in times.repartition("k", "_c").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == int(parts) and max(sizes) < 2 * np.median(sizes)
    assert jumps.marks(df, ["k"], "t", 5).count() == 80_000


def test_thin_keeps_one_row_of_a_moment(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 3, "x"), ("a", 6, "x"), (None, 2, "z")], "k string, t bigint, note string")
    got = sequences.thin(df, ["k"], "t", 5)
    assert got.columns == df.columns and sorted((str(r.k), r.t) for r in got.collect()) == [("None", 2), ("a", 1), ("a", 6)]
    assert sequences.thin(df.limit(0), ["k"], "t", 5).count() == 0


@pytest.mark.parametrize("span, fan", [(64, 1024), (1, 2)])
def test_segments(spark, monkeypatch, span, fan):
    monkeypatch.setattr(jumps, "SPAN", span)
    monkeypatch.setattr(jumps, "FAN", fan)
    rng = random.Random(9)
    frames = [(s, i, rng.randint(0, 900), rng.choice([1920, 1920, 1920, 1920, 640, None])) for s in ("a", "b") for i in range(150)]
    frames += [("c", i, i // 3, 640) for i in range(500)] + [("d", 0, 7, None)]
    df = spark.createDataFrame(frames, "source string, i bigint, t bigint, width int")
    want = []
    for s in "abcd":
        no, start, size = 0, None, ()
        for _, i, t, w in sorted([f for f in frames if f[0] == s], key=lambda f: (f[2], f[1])):
            if no == 0 or w != size or t - start >= 40:
                no, start, size = no + 1, t, w
            want.append((s, i, no, start))
    got = sequences.segments(df, ["source"], "t", ["width"], 40, ties=["i"])
    assert got.columns == [*df.columns, "segment", "segment_start"]
    assert rows(got.select("source", "i", "segment", "segment_start")) == sorted(want)
