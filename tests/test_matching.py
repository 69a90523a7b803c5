"""Block scoring, margin matching and calibration against plain models."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from sightline.operators import calibration, hooks, matching, similarity
from sightline.policy import RecognitionPolicy


def greedy_model(scores, threshold, margin, later):
    """The rules, literally: best per target, gates, margins, then claims in order."""
    eligible = []
    for t in {t for t, _ in scores}:
        mine = sorted(((s, c) for (tt, c), s in scores.items() if tt == t), key=lambda x: (-x[0], -x[1] if later else x[1]))
        best, c = mine[0]
        rivals = sorted((s for (_, cc), s in scores.items() if cc == c), reverse=True)
        if best < threshold:
            continue
        if len(mine) > 1 and best - mine[1][0] < margin:
            continue
        if len(rivals) > 1 and best - rivals[1] < margin:
            continue
        eligible.append((-best, t, c))
    used_t, used_c, out = set(), set(), []
    for s, t, c in sorted(eligible):
        if t not in used_t and c not in used_c:
            used_t.add(t)
            used_c.add(c)
            out.append((t, c))
    return sorted(out)


@pytest.mark.parametrize("later", [False, True])
@pytest.mark.parametrize("margin", [0, 1, 2])
def test_windows_equal_the_greedy_rules(spark, margin, later):
    rng = random.Random(margin * 2 + later)
    data, want = [], []
    for case in range(150):
        scores = {
            (t, c): rng.randint(0, 9)
            for t in range(rng.randint(1, 4))
            for c in range(rng.randint(1, 4))
            if rng.random() < 0.85
        }
        if scores:
            data += [(case, t, c, float(s)) for (t, c), s in scores.items()]
            want += [(case, t, c) for t, c in greedy_model(scores, 4, margin, later)]
    df = spark.createDataFrame(data, "case bigint, target_id bigint, track_id bigint, score double")
    got = matching.margin_match(df, ["case"], 4.0, float(margin), later_wins=later)
    assert rows(got.select("case", "target_id", "track_id")) == sorted(want)


def vectors(rng, n, dim=8):
    return [[float(x) for x in rng.normal(size=dim)] for _ in range(n)]


def cos(a, b):
    a, b = np.asarray(a), np.asarray(b)
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


@pytest.mark.parametrize("blocks", [(3, 2, 0), (1000, 1000, 0), (1000, 1000, 1 << 20)])
@pytest.mark.parametrize("plates", [False, True])
def test_sparse_scores_lead_to_the_same_matches(spark, blocks, plates):
    rng = np.random.default_rng(4)
    cands = [("p", i % 3, i, v, [None, "A", "B"][i % 3]) for i, v in enumerate(vectors(rng, 30))]
    cands += [("p", 0, 90, None, None), ("p", 0, 91, [1.0, 2.0], None), ("p", 0, 92, [0.0] * 8, None)]
    targets = [("p", i, v, [None, "A"][i % 2]) for i, v in enumerate(vectors(rng, 7))]
    cdf = spark.createDataFrame(cands, "domain string, attempt bigint, track_id bigint, embedding array<double>, plate string")
    tdf = spark.createDataFrame(targets, "domain string, target_id bigint, centroid array<double>, plate_number string")
    want = []
    for attempt in range(3):
        scores = {
            (t, c): cos(v, e)
            for (_, t, v, q), (_, a, c, e, p) in itertools.product(targets, cands[:30])
            if a == attempt and not (plates and p and q and p != q)
        }
        want += [(attempt, t, c) for t, c in greedy_model(scores, 0.3, 0.05, False)]
    for floor in (0.25, None):
        pairs = similarity.scored_pairs(
            cdf, tdf, ["domain"], floor, plates=plates, left_block=blocks[0], right_block=blocks[1], broadcast_bytes=blocks[2]
        )
        got = matching.margin_match(pairs, ["domain", "attempt"], 0.3, 0.05)
        assert rows(got.select("attempt", "target_id", "track_id")) == sorted(want)
    assert want
    every = similarity.scored_pairs(
        cdf, tdf, ["domain"], -1.0, plates=plates, every=True, left_block=blocks[0], right_block=blocks[1], broadcast_bytes=blocks[2]
    )
    fit = [
        (a, c, t) for (_, t, v, q), (_, a, c, e, p) in itertools.product(targets, cands[:30]) if not (plates and p and q and p != q)
    ]
    assert rows(every.select("attempt", "track_id", "target_id")) == sorted(fit)


def test_hot_group_of_copies_stays_small(spark):
    """Identical candidates do not multiply what a block sends on."""
    same = [("p", 0, i, [1.0, 0.0]) for i in range(200)]
    cdf = spark.createDataFrame(same, "domain string, attempt bigint, track_id bigint, embedding array<double>")
    tdf = spark.createDataFrame([("p", 1, [1.0, 0.0])], "domain string, target_id bigint, centroid array<double>")
    pairs = similarity.scored_pairs(cdf, tdf, ["domain"], None, left_block=50, broadcast_bytes=0)
    # Every candidate keeps its best target; nothing is matched because of the margin.
    assert pairs.count() == 200
    assert matching.margin_match(pairs, ["domain", "attempt"], 0.5, 0.05).count() == 0
    assert matching.margin_match(pairs, ["domain", "attempt"], 0.5, 0.0).select("track_id").first()[0] == 0


def test_caller_filters(spark):
    cdf = spark.createDataFrame([("p", 0, 1, [1.0, 0.0], 5), ("p", 0, 2, [0.9, 0.1], 50)], "domain string, attempt bigint, track_id bigint, embedding array<double>, zone int")
    ids = spark.createDataFrame([("p", 7, True, [1.0, 0.0], 50)], "domain string, identity_id bigint, recognition_enabled boolean, centroid array<double>, zone int")
    policy = RecognitionPolicy(threshold=0.8, margin=0.0)
    got = hooks.recognize(cdf, ids, policy, ["domain", "attempt"])
    assert [r.track_id for r in got.collect()] == [1]
    got = hooks.recognize(cdf, ids, policy, ["domain", "attempt"], pair_condition=F.col("c.zone") == F.col("i.zone"))
    assert [r.track_id for r in got.collect()] == [2]
    assert hooks.recognize(cdf, ids, policy, ["domain", "attempt"], enabled=F.lit(False)).count() == 0


def test_support_is_a_mean_of_the_best(spark):
    refs = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.6, 0.8]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (2, [0.8, 0.6])], "target_id bigint, embedding array<double>")
    a, b = math.cos(math.radians(30)), math.sin(math.radians(30))
    pairs = spark.createDataFrame([(1, [a, b]), (2, [1.0, 0.0])], "target_id bigint, embedding array<double>")
    got = dict(rows(similarity.support(pairs, refs, ["target_id"], 3).select("target_id", "support")))
    assert got[1] < 0.80 and got[1] == pytest.approx((a + 0.6 * a + 0.8 * b + b) / 3)
    assert got[2] == pytest.approx(0.9)


def test_confirmation_counts_consecutive_hits(spark):
    data = [(1, f, p) for f, p in ((0, 5), (1, 5), (2, 5), (3, None), (4, 5), (5, 6), (6, 6), (90, 6), (91, 6))]
    df = spark.createDataFrame(data, "key bigint, frame_index bigint, partner bigint")
    got = matching.confirmation_hits(df, ["key"], "partner", hits=2, max_age=60)
    assert rows(got.where("confirmed").select("frame_index", "partner")) == [(1, 5), (6, 6), (91, 6)]


@pytest.mark.parametrize("block", [3, 1024])
def test_calibration_counts_pairs(spark, block):
    rng = np.random.default_rng(9)
    samples = [(f"s{i:02d}", i % 3, v) for i, v in enumerate(vectors(rng, 20))]
    df = spark.createDataFrame(samples, "name string, label bigint, embedding array<double>")
    hist = calibration.pair_histogram(df, block=block).persist()
    pos, neg = [], []
    for (na, la, a), (nb, lb, b) in itertools.combinations(samples, 2):
        (pos if la == lb else neg).append((cos(a, b), na, nb))
    stats = {r.same_label: r for r in calibration.distribution(df, block=block).collect()}
    for flag, values in ((True, pos), (False, neg)):
        s = np.array([v for v, _, _ in values])
        assert stats[flag].n_pairs == len(s)
        for name, q in (("p10", 10), ("median", 50), ("p90", 90), ("p95", 95)):
            assert stats[flag][name] == pytest.approx(np.percentile(s, q), abs=1e-12)
        assert (stats[flag].min, stats[flag].max) == pytest.approx((s.min(), s.max()), abs=1e-12)
    hard = {r.kind: (r.a, r.b) for r in calibration.hardest_pairs(hist).collect()}
    assert hard == {"hardest_positive": min(pos)[1:], "hardest_negative": max(neg)[1:]}


@pytest.mark.parametrize("listed", [1, 20, 4096])
def test_order_statistics_by_digits(spark, monkeypatch, listed):
    """Crowded cells are cut into digits; copies share a score, however small the cell."""
    monkeypatch.setattr(calibration, "LISTED", listed)
    rng = np.random.default_rng(11)
    near = np.array([1.0, 0.0, 0.0]) + 1e-4 * rng.normal(size=(40, 3))
    data = [(f"n{i:02d}", 1, [float(x) for x in v]) for i, v in enumerate(near)]
    data += [(f"c{i:02d}", 2, [0.6, 0.8, 0.0]) for i in range(12)] + [("bad", 2, [float("nan")] * 3), ("none", 2, None)]
    df = spark.createDataFrame(data, "name string, label bigint, embedding array<double>")
    got = {r.same_label: r for r in calibration.distribution(df, block=16, quantiles=(0.0, 0.13, 0.5, 0.77, 1.0)).collect()}
    for flag in (True, False):
        s = [cos(a[2], b[2]) for a, b in itertools.combinations(data[:52], 2) if (a[1] == b[1]) == flag]
        assert got[flag].n_pairs == len(s)
        for i, q in enumerate((0, 13, 50, 77, 100)):
            assert got[flag][f"q{i}"] == pytest.approx(np.percentile(s, q), abs=1e-14)
        assert got[flag].mean == pytest.approx(np.mean(s), abs=1e-12)
    rows_of_blocks = calibration.pair_histogram(df, block=16)
    assert rows_of_blocks.count() <= 2 * (2 * calibration.CELLS + 3)
    assert calibration.distribution(df.limit(0)).count() == 0


def test_known_calibration_case(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 1, [1.0, 0.0]), ("c", 2, [0.0, 1.0])], "name string, label bigint, embedding array<double>")
    got = {r.same_label: (r.n_pairs, r.min, r.max) for r in calibration.distribution(df).collect()}
    assert got == {True: (1, 1.0, 1.0), False: (2, 0.0, 0.0)}


@pytest.mark.parametrize("block", [2, 1024])
def test_redundancy_of_banks(spark, block):
    rng = np.random.default_rng(2)
    refs = [("p", 1, i, v) for i, v in enumerate(vectors(rng, 7))] + [("p", 2, 0, [1.0] * 8)]
    df = spark.createDataFrame(refs, "domain string, identity_id bigint, embedding_index bigint, embedding array<double>")
    got = {(r.identity_id, r.embedding_index): r.redundancy for r in similarity.redundancy(df, ["domain", "identity_id"], block).collect()}
    for _, i, j, v in refs:
        rest = [cos(v, w) for _, k, m, w in refs if k == i and m != j]
        assert got[i, j] == pytest.approx(max(rest) if rest else 0.0)
    assert similarity.bank_pairs(df, ["domain", "identity_id"], block).count() == 21


def test_sampling_spreads_over_cameras(spark):
    data = [(f"v{v}", f"c{i % 3}" if i % 5 else None, f"v{v}_{i}.jpg") for v in range(5) for i in range(12)]
    df = spark.createDataFrame(data, "vehicle_id string, camera_id string, image_name string")
    picked = calibration.balanced_sample(df, F.lit(True), 3, 4, "42")
    counts = picked.groupBy("vehicle_id").agg(F.count("*").alias("n"), F.countDistinct(F.coalesce("camera_id", F.lit("-"))).alias("c"))
    assert rows(counts.select("n", "c")) == [(4, 4)] * 3
    assert calibration.sampling_shortage(df, F.lit(True), 6, 4).first()["eligible"] == 5
    assert calibration.sampling_shortage(df, F.lit(True), 5, 4).count() == 0
    with pytest.raises(ValueError, match="5 identities"):
        calibration.balanced_sample(df, F.lit(True), 6, 4, "42")


def test_published_histogram_has_a_cell_per_millionth(spark, tmp_path):
    """Scores that differ by a few millionths are not counted together."""
    from sightline.plans.catalog import ORACLES, QUERIES
    from sightline.plans.compare import compare, connect

    angles = [0.3 + i * 3e-6 for i in range(12)] + [1.2 + i * 5e-6 for i in range(12)]
    data = [(i, [math.cos(x), math.sin(x), 0.0], i % 2) for i, x in enumerate(angles)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int")
    df.coalesce(1).write.parquet(f"{tmp_path}/made")
    next(tmp_path.glob("made/*.parquet")).rename(tmp_path / "embeddings.parquet")
    name = "a07_pair_histogram"
    assert compare(spark, str(tmp_path), name, QUERIES, ORACLES, connect(str(tmp_path)))[0] == "same"
    cells = QUERIES[name](spark, str(tmp_path)).collect()
    assert len(cells) > 40 and sum(r.pairs for r in cells) == 24 * 23 // 2


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_scores_are_held_by_tiles(spark, monkeypatch, broadcast):
    """However many candidates and targets meet, only a tile of their scores is held."""
    monkeypatch.setattr(similarity, "TILE", (16, 8))
    seen = spark.sparkContext.accumulator(0)
    whole = similarity._pick

    def pick(scores, attempts, floor):
        seen.add(int(scores.shape[0] > 16 or scores.shape[1] > 8))
        return whole(scores, attempts, floor)

    monkeypatch.setattr(similarity, "_pick", pick)
    rng = np.random.default_rng(6)
    cands = [("p", i // 9, i, v, [None, "A", "B"][i % 3]) for i, v in enumerate(vectors(rng, 90))]
    targets = [("p", i, v, [None, "A", "C"][i % 3]) for i, v in enumerate(vectors(rng, 50))]
    cdf = spark.createDataFrame(cands, "domain string, attempt bigint, track_id bigint, embedding array<double>, plate string").coalesce(1)
    tdf = spark.createDataFrame(targets, "domain string, target_id bigint, centroid array<double>, plate_number string")
    want = []
    for attempt in range(10):
        scores = {
            (t, c): cos(v, e) for (_, t, v, q), (_, a, c, e, p) in itertools.product(targets, cands) if a == attempt and not (p and q and p != q)
        }
        want += [(attempt, t, c) for t, c in greedy_model(scores, 0.3, 0.01, False)]
    pairs = similarity.scored_pairs(cdf, tdf, ["domain"], 0.29, plates=True, broadcast_bytes=broadcast)
    got = matching.margin_match(pairs, ["domain", "attempt"], 0.3, 0.01)
    assert rows(got.select("attempt", "target_id", "track_id")) == sorted(want) and want
    assert seen.value == 0


def test_broadcast_targets_hold_their_vectors_once(spark):
    """A worker has the targets of a broadcast as a matrix; lists of vectors beside it would be several times larger."""
    data = [(x, i, [1.0, float(i), 2.0], None) for x in ("p", "q") for i in range(5)]
    targets = spark.createDataFrame(data, "domain string, target_id bigint, centroid array<double>, plate_number string")
    for frame, units in similarity._by_key(targets, ["domain"]).values():
        assert list(frame.columns) == ["domain", "target_id", "plate_number"]
        assert units[3][1].shape == (5, 3)


def test_one_domain_of_recognition(spark, tmp_path, monkeypatch):
    """u05 multiplies a domain's candidates with that domain's targets only, once."""
    from sightline.plans.catalog import QUERIES

    rng = np.random.default_rng(2)
    data = [(i, v, i % 3) for i, v in enumerate(vectors(rng, 160))]
    spark.createDataFrame(data, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    seen, whole = [], similarity.scored_pairs

    def scored(candidates, targets, *args, **options):
        seen.append([sorted({r.domain for r in x.select("domain").collect()}) for x in (candidates, targets)])
        return whole(candidates, targets, *args, **options)

    monkeypatch.setattr(similarity, "scored_pairs", scored)
    QUERIES["u05_domain_adapter"](spark, str(tmp_path))
    assert seen == [[["person"]] * 2, [["vehicle"]] * 2]


def test_tiles_of_the_histogram_like_all_pairs(spark, monkeypatch):
    """Small tiles and buffers, labels that are null, copies: cells, sums, extremes and hardest pairs."""
    monkeypatch.setattr(calibration, "TILE", (4, 8))
    monkeypatch.setattr(calibration, "HELD", 50)
    rng = np.random.default_rng(4)
    made = [list(map(float, v)) for v in vectors(rng, 40)]
    data = [(i, [None, "a", "b"][i % 3], made[i % 35]) for i in range(40)]
    df = spark.createDataFrame(data, "name bigint, label string, embedding array<double>")
    want = {}
    for (a, la, x), (b, lb, y) in itertools.combinations(data, 2):
        want.setdefault(la is not None and la == lb, []).append((cos(x, y), a, b))
    for extremes in (True, False):
        found = calibration.pair_histogram(df, 16, cells=100, extremes=extremes).collect()
        for flag, pairs in want.items():
            mine, scores = [r for r in found if r.same_label == flag], [x for x, _, _ in pairs]
            assert sum(r.pairs for r in mine) == len(pairs)
            assert sum(r.total for r in mine) == pytest.approx(sum(scores))
            assert min(r.low for r in mine if r.low is not None) == pytest.approx(min(scores))
            assert max(r.high for r in mine if r.high is not None) == pytest.approx(max(scores))
            for r in mine if extremes else ():
                cell = [x for x in scores if round(x * 100) == r.cell]
                assert (r.pairs, r.low, r.high) == (len(cell), pytest.approx(min(cell)), pytest.approx(max(cell)))
    stats = {r.same_label: r for r in calibration.distribution(df, 16).collect()}
    for flag, pairs in want.items():
        assert stats[flag].median == pytest.approx(np.percentile([x for x, _, _ in pairs], 50), abs=1e-12)
