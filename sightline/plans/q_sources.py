"""Sources parsed from columns, and the callers' own models and rules."""

from __future__ import annotations

import json
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from sightline import policy as pol
from sightline.functions import vectors as v
from sightline.operators import hooks, matching
from sightline.plans import derived as d
from sightline.plans.q_matching import _FREE, _match_sql, bindings
from sightline.plans.q_sequences import images
from sightline.plans.q_vectors import MARGIN, THRESHOLD
from sightline.plans.registry import query
from sightline.sources import embeddings as codec, labels
from sightline.streaming import stream

_NAMES = """n as (select doc_id, case when doc_id % 13 = 0 then '' when doc_id % 17 = 0 then '../' || doc_id || '.jpg' when doc_id % 19 = 0 then '/abs/' || doc_id || '.jpg' else 'img' || doc_id || '.jpg' end as image_name,
  case when doc_id % 23 = 0 then '' else lpad(cast(doc_id // 12 as varchar), 5, '0') end as vehicle_id, case when doc_id % 10 = 0 then null else source end as camera_id from documents)"""


@query(
    "s17_label_items",
    f"""with {_NAMES} select image_name, vehicle_id, camera_id, case when image_name = '' or vehicle_id = '' then 'missing_attribute'
      when image_name like '../%' or image_name like '/%' then 'unsafe_path' else 'usable' end as outcome from n""",
)
def label_items(spark, sf):
    i = F.col("doc_id")
    n = i.cast("string")
    name = (
        F.when(i % 13 == 0, "")
        .when(i % 17 == 0, F.concat(F.lit("../"), n, F.lit(".jpg")))
        .when(i % 19 == 0, F.concat(F.lit("/abs/"), n, F.lit(".jpg")))
        .otherwise(F.concat(F.lit("img"), n, F.lit(".jpg")))
    )
    vehicle = F.when(i % 23 == 0, "").otherwise(F.lpad(F.floor(i / 12).cast("string"), 5, "0"))
    camera = F.when(i % 10 == 0, "").otherwise(F.col("source"))
    line = F.concat(
        F.lit('<Item imageName="'), name, F.lit('" vehicleID="'), vehicle, F.lit('" cameraID="'), camera, F.lit('"/>')
    )
    good, bad = labels.parse_items(d.table(spark, sf, "documents").select(line.alias("line")), "line")
    return good.withColumn("outcome", F.lit("usable")).unionByName(bad.withColumnRenamed("reason", "outcome"))


@query(
    "s18_labelled_paths",
    """with p as (select 'v' || (doc_id // 12) as vehicle_id, 'img' || doc_id || case lang when 'en' then '.jpg' when 'de' then '.png' when 'es' then '.JPEG' else '.txt' end as image_name from documents)
    select vehicle_id, image_name, '/data/' || vehicle_id || '/' || image_name as path from p where image_name not like '%.txt'""",
)
def labelled_paths(spark, sf):
    files = images(spark, sf).select(F.concat(F.lit("/data/"), "vehicle_id", F.lit("/"), "image_name").alias("path"))
    return labels.label_paths(files)


@query(
    "s19_source_status",
    """select event_id, case when event_type <> 'error' then 'FRAME' when user_id % 3 <> 0 then 'TEMPORARY_FAILURE' else 'EOF' end as status from events""",
)
def source_status(spark, sf):
    reads = d.table(spark, sf, "events").select(
        "event_id", (F.col("event_type") != "error").alias("ok"), (F.col("user_id") % 3 != 0).alias("is_camera")
    )
    return stream.source_status(reads).select("event_id", "status")


def _unit_rows(crops: list) -> np.ndarray:
    """Stand-in for a model: the crop bytes are a vector already."""
    m = np.stack([np.frombuffer(bytes(c), dtype="<f4").astype(np.float64) for c in crops])
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


@query(
    "u01_embedding_provider",
    "select vec_id, 64 as dim, round(cast(embedding[3] as double), 4) as third from embeddings",
)
def embedding_provider(spark, sf):
    crops = d.table(spark, sf, "embeddings").select("vec_id", codec.encode_blob("embedding").alias("crop"))
    got = hooks.extract_embeddings(crops, ["vec_id"], "crop", _unit_rows)
    third = v.as_double(F.col("embedding"))[2]
    return got.select("vec_id", F.size("embedding").alias("dim"), F.round(third, 4).alias("third"))


def _props_reader(crop: str) -> list:
    """Stand-in for a reader: fails on some crops, finds one or no plate on others."""
    k = json.loads(crop)["k"]
    if k % 10 == 3:
        raise ValueError(f"unreadable {k}")
    return [(f"B{k}", k / 100, 1, 2, 3, 4)] if k % 2 else []


@query(
    "u02_plate_provider",
    """with k as (select event_id, cast(json_extract(props, '$.k') as integer) as k from events)
    select event_id, case when k % 10 = 3 then null else 'B' || k end as plate, case when k % 10 = 3 then 'ValueError: unreadable ' || k end as error from k where k % 2 = 1 or k % 10 = 3""",
)
def plate_provider(spark, sf):
    crops = d.table(spark, sf, "events").select("event_id", "props")
    return hooks.read_plates(crops, ["event_id"], "props", _props_reader).select("event_id", "plate", "error")


@query(
    "u04_caller_filters",
    f"with {_FREE}, " + _match_sql("domain, attempt", False, "asc")
    + " select domain, attempt, target_id, track_id, round(score, 6) as score from matches",
)
def caller_filters(spark, sf):
    """The plate rule written as a caller's own pair condition."""
    refs = d.references(spark, sf)
    g = d.gallery(refs)
    free = matching.free_identities(g, bindings(g))
    policy = replace(pol.PERSON_RECOGNITION, threshold=THRESHOLD, margin=MARGIN)
    plate, stored = F.col("c.plate"), F.col("i.plate_number")
    matched = hooks.recognize(
        d.candidates(refs),
        free,
        policy,
        ["domain", "attempt"],
        enabled=F.col("recognition_enabled"),
        pair_condition=plate.isNull() | stored.isNull() | (plate == stored),
    )
    return matched.select("domain", "attempt", "target_id", "track_id", F.round("score", 6).alias("score"))
