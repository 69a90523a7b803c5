"""The pruned similarity join: all pairs above the floor, and how many block pairs it skips."""

import numpy as np
import pytest

from sightline.operators import metric_index, similarity


def clustered(rng, clusters, per, dim, spread):
    centres = rng.normal(size=(clusters, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return np.concatenate([c + spread * rng.normal(size=(per, dim)) for c in centres])


def frames(spark, left, right, domains=2):
    cands = [(f"d{i % domains}", i % 5, i, [float(x) for x in v]) for i, v in enumerate(left)]
    cands += [("d0", 0, -1, None), ("d0", 0, -2, [0.0] * len(left[0])), ("d0", 0, -3, [float("nan")] * len(left[0])), (None, 0, -4, [1.0] * len(left[0]))]
    targets = [(f"d{i % domains}", i, [float(x) for x in v]) for i, v in enumerate(right)]
    cdf = spark.createDataFrame(cands, "domain string, attempt bigint, track_id bigint, embedding array<double>")
    return cdf, spark.createDataFrame(targets, "domain string, target_id bigint, centroid array<double>")


def brute(left, right, floor, domains=2):
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (left, right))
    scores = a @ b.T
    same = (np.arange(len(a)) % domains)[:, None] == (np.arange(len(b)) % domains)[None, :]
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(same & (scores >= floor)))}


@pytest.mark.parametrize("kind", ["clustered", "random", "copies"])
def test_all_pairs_above_the_floor(spark, kind):
    rng = np.random.default_rng(7)
    if kind == "clustered":
        both = clustered(rng, 24, 50, 16, 0.05)
        rng.shuffle(both)
        left, right, floor = both[:800], both[800:], 0.8
    elif kind == "random":
        left, right, floor = rng.normal(size=(500, 6)), rng.normal(size=(300, 6)), 0.7
    else:
        left, right, floor = np.ones((400, 4)), np.concatenate([np.ones((200, 4)), rng.normal(size=(20, 4))]), 0.9
    cdf, tdf = frames(spark, left, right)
    found = similarity.scored_pairs(cdf, tdf, ["domain"], floor, every=True, left_block=40, right_block=25, broadcast_bytes=0)
    got = found.select("track_id", "target_id").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(left, right, floor)
    reach = similarity.reach(cdf, tdf, ["domain"], floor, left_block=40, right_block=25).first()
    assert 0 < reach.multiplied <= reach.block_pairs
    if kind == "clustered":
        assert reach.multiplied < 0.35 * reach.block_pairs


def test_other_dimensions_and_empty_sides(spark):
    """A dimension of which no target was drawn as a pivot is multiplied as it is."""
    rng = np.random.default_rng(3)
    left, right = rng.normal(size=(60, 5)), rng.normal(size=(40, 5))
    cdf, tdf = frames(spark, left, right, 1)
    chosen = metric_index.pivots(tdf, ["target_id"], "centroid")
    assert list(chosen) == [5] and chosen[5].shape == (metric_index.PIVOTS, 5)
    for given in (chosen, {}):
        a = metric_index.blocked(metric_index.angled(cdf, "embedding", given), ["domain"], ["track_id"], 16)
        b = metric_index.blocked(metric_index.angled(tdf, "centroid", given), ["domain"], ["target_id"], 16)
        assert a.count() == 60 and max(r["count"] for r in a.groupBy("domain", "_dim", "_block").count().collect()) <= 32
        pairs = metric_index.block_pairs(a, b, ["domain"], 0.99)
        assert given or pairs.where("not reachable").count() == 0
    none = tdf.limit(0)
    assert similarity.scored_pairs(cdf, none, ["domain"], 0.5, every=True, broadcast_bytes=-1).count() == 0
    assert similarity.reach(cdf, none, ["domain"], 0.5).first() == (0, 0)


def test_floor_of_one_finds_copies(spark):
    rng = np.random.default_rng(5)
    left = rng.normal(size=(120, 8))
    cdf, tdf = frames(spark, left, left * 3.0, 1)
    found = similarity.scored_pairs(cdf, tdf, ["domain"], 1.0, every=True, left_block=10, right_block=10, broadcast_bytes=0)
    assert {(r.track_id, r.target_id) for r in found.collect()} == {(i, i) for i in range(120)}


def test_small_keys_are_one_block(spark):
    """A key with few vectors is not cut by cells: a pair of blocks costs a task's turn."""
    rng = np.random.default_rng(9)
    left, right = rng.normal(size=(600, 8)), rng.normal(size=(120, 8))
    cdf, tdf = frames(spark, left, right, 30)
    reach = similarity.reach(cdf, tdf, ["domain"], 0.3, left_block=64, right_block=32).first()
    assert reach.block_pairs == 30
    found = similarity.scored_pairs(cdf, tdf, ["domain"], 0.3, every=True, left_block=64, right_block=32, broadcast_bytes=-1)
    assert {(r.track_id, r.target_id) for r in found.collect()} == brute(left, right, 0.3, 30)
