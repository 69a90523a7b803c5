"""Box arithmetic, gates and overlaps on hand-made boxes."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from sightline import policy as pol
from sightline.functions import geometry as g
from sightline.operators import overlap, quality

BOXES = "camera_id string, frame_index bigint, track_id bigint, class_id int, x1 double, y1 double, x2 double, y2 double, conf double"


def boxes(spark, *items, frame=0):
    data = [("a", frame, t, 0, *map(float, b), c) for t, b, c in items]
    return (
        spark.createDataFrame(data, BOXES).withColumn("frame_width", F.lit(100)).withColumn("frame_height", F.lit(120))
    )


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(float(v)).alias(k) for k, v in values.items()])
    return df.select(column.alias("v")).first()["v"]


def test_iou_of_known_boxes(spark):
    a = g.Box(*(F.lit(float(v)) for v in (0, 0, 100, 100)))
    b = g.Box(*(F.lit(float(v)) for v in (10, 0, 110, 100)))
    far = g.Box(*(F.lit(float(v)) for v in (500, 500, 600, 600)))
    bad = g.Box(F.lit(float("nan")), *(F.lit(1.0),) * 3)
    got = spark.range(1).select(g.iou(a, a), g.iou(a, b), g.iou(a, far), g.iou(a, bad)).first()
    assert got[0] == 1.0 and got[1] == pytest.approx(90 / 110) and got[2] == 0.0 and got[3] == 0.0


def test_display_round_trip(spark):
    view = g.display_of(F.lit(1920), F.lit(1080))
    roi = g.Box(*(F.lit(float(v)) for v in (100, 50, 300, 250)))
    back = g.to_source(roi, view)
    got = spark.range(1).select(view.display_width, view.display_height, *back).first()
    assert tuple(got) == (1280, 720, 150, 75, 450, 375)


def test_display_never_enlarges(spark):
    view = g.display_of(F.lit(640), F.lit(480))
    assert tuple(spark.range(1).select(view.display_width, view.display_height).first()) == (640, 480)


def test_rounding_is_half_even(spark):
    crop = g.rounded_crop(g.Box(*(F.lit(v) for v in (0.5, 1.5, 2.5, 9.5))), F.lit(100), F.lit(100))
    assert tuple(spark.range(1).select(crop.alias("c")).first()["c"]) == (0, 2, 2, 10)


def test_empty_and_infinite_crops(spark):
    for corners in ((200, 0, 300, 50), (float("inf"), 0, 10, 10)):
        crop = g.outer_crop(g.Box(*(F.lit(float(v)) for v in corners)), F.lit(100), F.lit(100))
        assert spark.range(1).select(crop.alias("c")).first()["c"] is None


SMALL = pol.QualityPolicy(min_crop_width=20, min_crop_height=50, edge_margin=0.01, max_overlap=0.40)


@pytest.mark.parametrize(
    "box, conf, reason",
    [
        ((10, 5, 50, 110), 0.9, None),
        ((10, 5, 50, 110), 0.2, "low_confidence"),
        ((10, 5, 50, 110), float("nan"), "low_confidence"),
        ((10, 10, 20, 50), 0.9, "small_crop"),
        ((-20, 0, 20, 110), 0.9, "edge_truncated"),
        ((0, 10, 40, 110), 0.9, "frame_edge"),
        ((60, 10, 100, 110), 0.9, "frame_edge"),
        ((10, 0, 50, 110), 0.9, "frame_edge"),
        ((10, 10, 50, 120), 0.9, "frame_edge"),
        ((1, 10, 40, 110), 0.9, "frame_edge"),
        ((2, 10, 40, 110), 0.9, None),
        ((200, 10, 240, 110), 0.9, "outside_frame"),
        ((50, 10, 50, 110), 0.9, "invalid_bbox"),
        ((float("nan"), 10, 40, 110), 0.9, "invalid_bbox"),
    ],
)
def test_gate_reasons(spark, box, conf, reason):
    judged = quality.assess(boxes(spark, (1, box, conf)), SMALL)
    assert judged.first()["reason"] == reason


@pytest.mark.parametrize(
    "left, reason", [(30, "person_overlap"), (45, None), (34.4, None), (33.6, "person_overlap")]
)
def test_overlap_is_share_of_the_target(spark, left, reason):
    judged = quality.assess(boxes(spark, (1, (10, 5, 50, 110), 0.9), (2, (left, 5, 50, 110), 0.9)), SMALL)
    assert judged.where("track_id = 1").first()["reason"] == reason


def test_crop_size_of_accepted_box(spark):
    crop = quality.assess(boxes(spark, (1, (10, 5, 50, 110), 0.9)), SMALL).first()["crop"]
    assert (crop.y2 - crop.y1, crop.x2 - crop.x1) == (105, 40)


def test_strangers_do_not_count_as_partners(spark):
    df = boxes(spark, (1, (10, 5, 50, 110), 0.9), (2, (10, 5, 50, 110), 0.9))
    df = df.withColumn("class_id", F.when(F.col("track_id") == 2, 2).otherwise(0))
    got = {r.track_id: r.reason for r in quality.assess(df, SMALL).collect()}
    assert got == {1: None, 2: "not_person"}


def test_domains_are_judged_together_as_apart(spark):
    rng = random.Random(3)
    data = []
    for t in range(40):
        x, y = rng.randint(0, 60), rng.randint(0, 40)
        data.append((t, (x, y, x + rng.randint(10, 40), y + rng.randint(20, 80)), rng.random()))
    df = boxes(spark, *data).withColumn("class_id", F.when(F.col("track_id") % 2 == 0, 0).otherwise(2))
    df = df.withColumn("domain", F.when(F.col("class_id") == 0, "person").otherwise("vehicle"))
    both = {"person": SMALL, "vehicle": pol.QualityPolicy("vehicle", 0.35, 0.3, 0.6, 0.01, 10, 10)}
    joint = {r.track_id: r.reason for r in quality.assess(df, both).collect()}
    for domain, p in both.items():
        for r in quality.assess(df, p).where(F.col("domain") == domain).collect():
            assert joint[r.track_id] == r.reason


def brute_overlap(items, ratio):
    best = {}
    for (i, a), (j, b) in itertools.permutations(items.items(), 2):
        w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
        h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        areas = [(v[2] - v[0]) * (v[3] - v[1]) for v in (a, b)]
        base = areas[0] if ratio is g.cover_ratio else min(areas)
        best[i] = max(best.get(i, 0.0), w * h / base)
    return best


@pytest.mark.parametrize("ratio", [g.cover_ratio, g.min_area_overlap])
@pytest.mark.parametrize("dense", [0, 10, 1000])
def test_crowded_frames_give_the_same_overlap(spark, ratio, dense):
    rng = random.Random(7)
    items = {}
    for t in range(60):
        if t % 6 == 5:
            items[t] = items[t - 1]  # copies of a box
            continue
        x, y = rng.randint(-50, 900), rng.randint(-50, 500)
        items[t] = (x, y, x + rng.randint(20, 300), y + rng.randint(20, 300))
    data = [("a", 0, t, 0, *map(float, b), 0.9) for t, b in items.items()]
    df = spark.createDataFrame(data, BOXES)
    got = overlap.max_overlap(df, ["camera_id", "frame_index"], ratio=ratio, dense=dense)
    want = brute_overlap(items, ratio)
    for r in got.collect():
        assert r.overlap == pytest.approx(want.get(r.track_id, 0.0))


def test_partners_are_ordered_and_limited(spark):
    shares = {12: 0.50, 13: 0.35, 14: 0.20, 15: 0.17, 16: 0.14}
    items = [(11, (0, 0, 100, 100), 0.9)]
    items += [(t, (100 - 100 * s, 0, 200 - 100 * s, 100), 0.9) for t, s in shares.items()]
    found = overlap.overlap_partners(boxes(spark, *items), ["camera_id", "frame_index"], 0.15, 2)
    got = rows(found.where("track_id = 11").select("partner_rank", "partner_id"))
    assert got == [(1, 12), (2, 13)]


@pytest.mark.parametrize("dense", [0, 1000])
def test_partners_of_crowded_frames(spark, dense):
    rng = random.Random(11)
    items = []
    for t in range(50):
        x, y = rng.randint(0, 500), rng.randint(0, 300)
        items.append((t, (x, y, x + rng.randint(20, 200), y + rng.randint(20, 200)), 0.9))
    got = rows(overlap.overlap_partners(boxes(spark, *items), ["camera_id", "frame_index"], 0.1, 3, dense=dense))
    plain = rows(overlap.overlap_partners(boxes(spark, *items), ["camera_id", "frame_index"], 0.1, 3))
    assert got == plain and got


def test_a_pile_of_equal_boxes_is_not_paired_up(spark):
    """20 000 copies of a box in one frame: two shapes meet, not 4 * 10**8 boxes."""
    pile = spark.range(20_000).select(
        F.lit("a").alias("camera_id"), F.lit(0).alias("frame_index"), F.col("id").alias("track_id"),
        *[F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (0.0, 0.0, 50.0, 50.0))],
    )
    one = pile.limit(1).withColumn("track_id", F.lit(10**6)).withColumn("x2", F.lit(25.0))
    every, keys = pile.unionByName(one), ["camera_id", "frame_index"]
    most = overlap.max_overlap(every, keys)
    assert rows(most.groupBy("overlap").count()) == [(1.0, 20_001)]
    found = overlap.overlap_partners(every, keys, 0.1, 3)
    assert found.count() == 3 * 20_001
    # The half box lies wholly inside the others, so all ratios are equal and ids decide.
    assert rows(found.where("track_id = 7").select("partner_rank", "partner_id")) == [(1, 0), (2, 1), (3, 2)]
    assert rows(found.where("track_id = 1").select("partner_rank", "partner_id")) == [(1, 0), (2, 2), (3, 3)]


def test_parse_filter_drops_nan_and_infinity(spark):
    df = boxes(spark, (1, (0, 0, 5, 5), 0.5), (2, (float("inf"), 0, 5, 5), 0.5), (3, (0, 0, 5, 5), float("nan")))
    kept = quality.parse_filter(df, (0,), ["x1", "y1", "x2", "y2", "conf"])
    assert [r.track_id for r in kept.collect()] == [1]
