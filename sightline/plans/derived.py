"""Tables of the track domain derived from the given star-schema tables.

Every derived table uses all rows of its source.  Each one exists twice: as a DataFrame
for the Spark queries and as a CTE text for the reference SQL.

An order is a frame: a camera covers 1000 consecutive orders, and a line of an order is a
box in that frame.  Vectors are both the stored references (eight per identity) and the
candidates that are compared with them.  User events are plate readings, identity events,
timings and source states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sightline.functions import text, vectors
from sightline.operators import scan

FRAME_WIDTH, FRAME_HEIGHT = 1920, 1080


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def epoch_micros(ts):
    """Microseconds since 1970 of a time without zone, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def _box_columns(k):
    return [
        ((k * 7) % 1700).cast("double").alias("x1"),
        ((k * 13) % 800).cast("double").alias("y1"),
        ((k * 7) % 1700 + 40 + k % 300).cast("double").alias("x2"),
        ((k * 13) % 800 + 80 + (k * 3) % 320).cast("double").alias("y2"),
        ((F.lit(30) + k % 70).cast("double") / 100.0).alias("conf"),
    ]


def _camera():
    return [
        F.floor(F.col("ord") / 1000).cast("string").alias("camera_id"),
        (F.col("ord") % 1000).alias("frame_index"),
    ]


_K = "l_partkey * 1000000 + l_suppkey * 1000 + cast(l_quantity as bigint)"

_BOX_SQL = """cast((k*7)%1700 as double) as x1, cast((k*13)%800 as double) as y1,
    cast((k*7)%1700+40+k%300 as double) as x2, cast((k*13)%800+80+(k*3)%320 as double) as y2,
    cast(30+k%70 as double)/100.0 as conf"""

TRACKS_SQL = f"""det as (
  select l_orderkey as ord, cast(l_linenumber as bigint) as track_id, min({_K}) as k
  from lineitem group by 1, 2),
tracks as (
  select cast(ord // 1000 as varchar) as camera_id, ord % 1000 as frame_index, track_id,
    case when track_id%4=0 then 0 when track_id%4=1 then 2 when track_id%4=2 then 0 else 5 end as class_id,
    case when track_id%2=0 then 'person' else 'vehicle' end as domain,
    k, {_BOX_SQL}
  from det)"""


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """camera_id, frame_index, track_id, class_id, domain, k, box, conf."""
    det = (
        table(spark, sf, "lineitem")
        .groupBy(
            F.col("l_orderkey").alias("ord"),
            F.col("l_linenumber").cast("bigint").alias("track_id"),
        )
        .agg(F.min(F.expr(_K)).alias("k"))
    )
    t = F.col("track_id")
    class_id = F.when(t % 4 == 0, 0).when(t % 4 == 1, 2).when(t % 4 == 2, 0).otherwise(5)
    return det.select(
        *_camera(),
        "track_id",
        class_id.alias("class_id"),
        text.domain_of_class(class_id).alias("domain"),
        "k",
        *_box_columns(F.col("k")),
    )


def sized(df: DataFrame) -> DataFrame:
    return df.withColumn("frame_width", F.lit(FRAME_WIDTH)).withColumn(
        "frame_height", F.lit(FRAME_HEIGHT)
    )


# Every line as a raw detection: unlisted classes, infinite corners and NaN scores included.
DETECTIONS_SQL = f"""line as (
  select l_orderkey as ord, l_linenumber as ln, {_K} as k from lineitem),
detections as (
  select cast(ord // 1000 as varchar) as camera_id, ord % 1000 as frame_index, ln, k,
    case ln when 1 then 2 when 2 then 0 when 3 then 5 when 4 then 0 when 5 then 7 when 6 then 0 else 1 end as class_id,
    case when k%89=0 then cast('inf' as double) else cast((k*7)%1700 as double) end as x1,
    cast((k*13)%800 as double) as y1,
    cast((k*7)%1700+40+k%300 as double) as x2, cast((k*13)%800+80+(k*3)%320 as double) as y2,
    case when k%97=0 then cast('nan' as double) else cast(30+k%70 as double)/100.0 end as conf
  from line)"""


def detections(spark: SparkSession, sf: str) -> DataFrame:
    k, ln = F.col("k"), F.col("ln")
    boxes = {n: c for n, c in zip(("x1", "y1", "x2", "y2", "conf"), _box_columns(k))}
    return (
        table(spark, sf, "lineitem")
        .select(
            F.col("l_orderkey").alias("ord"),
            F.col("l_linenumber").alias("ln"),
            F.expr(_K).alias("k"),
        )
        .select(
            *_camera(),
            "ln",
            "k",
            F.when(ln == 1, 2).when(ln == 3, 5).when(ln == 5, 7).when(ln == 7, 1).otherwise(0).alias("class_id"),
            F.when(k % 89 == 0, F.lit(float("inf"))).otherwise(boxes["x1"]).alias("x1"),
            boxes["y1"],
            boxes["x2"],
            boxes["y2"],
            F.when(k % 97 == 0, F.lit(float("nan"))).otherwise(boxes["conf"]).alias("conf"),
        )
    )


FRAMES_SQL = """frames as (
  select cast(o_orderkey // 1000 as varchar) as camera_id, o_orderkey % 1000 as frame_index,
    o_custkey as c from orders)"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """One row per processed frame, with or without boxes."""
    return table(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / 1000).cast("string").alias("camera_id"),
        (F.col("o_orderkey") % 1000).alias("frame_index"),
        F.col("o_custkey").alias("c"),
    )


# A second run of the same source: shifted right edges, some boxes missing.
SECOND_SQL = """second as (
  select camera_id, frame_index, track_id, class_id, k, x1, y1,
    x2 + k%160 as x2, y2, conf from tracks where k%11 <> 0)"""


def in_second_run() -> Column:
    return F.col("k") % 11 != 0


def second_run(first: DataFrame) -> DataFrame:
    return first.where(in_second_run()).withColumn("x2", F.col("x2") + F.col("k") % 160)


GALLERY_SQL = """refs as (
  select case when (vec_id // 8) % 2 = 0 then 'person' else 'vehicle' end as domain,
    vec_id // 8 + 1 as identity_id, vec_id % 8 as embedding_index, vec_id,
    cast(embedding as double[]) as embedding
  from embeddings),
unrolled as (
  select domain, identity_id, unnest(range(1, len(embedding) + 1)) as pos, unnest(embedding) as v
  from refs),
means as (
  select domain, identity_id, pos, avg(v) as m from unrolled group by 1, 2, 3),
mean_lists as (
  select domain, identity_id, list(m order by pos) as c, sqrt(sum(m*m)) as n from means group by 1, 2),
gallery as (
  select domain, identity_id, 'Target ' || identity_id as label,
    case when identity_id % 3 = 0 then null else 'B' || (identity_id % 4) end as plate_number,
    identity_id % 5 <> 0 as recognition_enabled,
    case when identity_id % 7 = 0 then null else '2024-01-01 00:00:00' end as created_at,
    list_transform(c, lambda x: x / n) as centroid
  from mean_lists),
candidates as (
  select domain, (identity_id - 1) // 10 as camera_id, vec_id // 20 as attempt, vec_id as track_id,
    case when vec_id % 4 = 0 then null else 'B' || (vec_id % 3) end as plate, embedding
  from refs)"""


def references(spark: SparkSession, sf: str) -> DataFrame:
    """domain, identity_id, embedding_index, vec_id, embedding."""
    block = F.floor(F.col("vec_id") / 8)
    return table(spark, sf, "embeddings").select(
        F.when(block % 2 == 0, "person").otherwise("vehicle").alias("domain"),
        (block + 1).alias("identity_id"),
        (F.col("vec_id") % 8).alias("embedding_index"),
        "vec_id",
        "embedding",
    )


def gallery(refs: DataFrame) -> DataFrame:
    """One row per identity with the normalised mean of its references."""
    i = F.col("identity_id")
    return (
        refs.groupBy("domain", "identity_id")
        .agg(vectors.mean_vector(F.col("embedding")).alias("mean"))
        .select(
            "domain",
            "identity_id",
            F.concat(F.lit("Target "), i.cast("string")).alias("label"),
            F.when(i % 3 != 0, F.concat(F.lit("B"), (i % 4).cast("string"))).alias("plate_number"),
            (i % 5 != 0).alias("recognition_enabled"),
            F.when(i % 7 != 0, "2024-01-01 00:00:00").alias("created_at"),
            vectors.normalized(F.col("mean")).alias("centroid"),
        )
    )


def candidates(refs: DataFrame) -> DataFrame:
    v = F.col("vec_id")
    return refs.select(
        "domain",
        F.floor((F.col("identity_id") - 1) / 10).alias("camera_id"),
        F.floor(v / 20).alias("attempt"),
        v.alias("track_id"),
        F.when(v % 4 != 0, F.concat(F.lit("B"), (v % 3).cast("string"))).alias("plate"),
        "embedding",
    )


# Track numbers repeat across cameras.  A frame in which the track was not visible has no
# reading; a track's epoch counts its uninterrupted appearances.
PLATES_SQL = """readings as (
  select cast(user_id % 3 as varchar) as camera_id, 'vehicle' as domain, user_id // 3 as track_id,
    row_number() over (partition by user_id order by ts, event_id) as frame_index,
    event_id as obs_idx, 'b ' || event_type as plate,
    least(0.99, 0.5 + value/200) as conf,
    5 as x1, 5 as y1,
    5 + 50 + cast(json_extract(props, '$.k') as integer) as x2, 30 as y2,
    cast(60 + event_id % 60 as double) as sharpness, 140 as crop_w, 80 as crop_h
  from events),
islands as (
  select *, frame_index - row_number() over (partition by camera_id, domain, track_id order by frame_index) as island
  from readings where obs_idx % 13 <> 0),
plate_obs as (
  select * exclude (island), dense_rank() over (partition by camera_id, domain, track_id order by island) as track_epoch from islands)"""
TRACK = ["camera_id", "domain", "track_id"]


def track_of(user: Column) -> list[Column]:
    """Camera, domain and track number of a user of the event table."""
    return [
        (user % 3).cast("string").alias("camera_id"),
        F.lit("vehicle").alias("domain"),
        F.floor(user / 3).alias("track_id"),
    ]


def plate_obs(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").withColumn("at", epoch_micros(F.col("ts")))
    placed = scan.with_position(
        ev, ["user_id"], "at", ["event_id"], chunk=86_400_000_000, name="frame_index"
    )
    k = F.get_json_object("props", "$.k").cast("int")
    readings = placed.where(F.col("event_id") % 13 != 0).select(
        *track_of(F.col("user_id")),
        "frame_index",
        F.col("event_id").alias("obs_idx"),
        F.concat(F.lit("b "), F.col("event_type")).alias("plate"),
        F.least(F.lit(0.99), 0.5 + F.col("value") / 200).alias("conf"),
        F.lit(5).alias("x1"),
        F.lit(5).alias("y1"),
        (F.lit(55) + k).alias("x2"),
        F.lit(30).alias("y2"),
        (F.lit(60) + F.col("event_id") % 60).cast("double").alias("sharpness"),
        F.lit(140).alias("crop_w"),
        F.lit(80).alias("crop_h"),
    )
    epochs = scan.with_runs(readings, TRACK).drop("run_start")
    return epochs.withColumnRenamed("run_no", "track_epoch")


LOG_SQL = """log_in as (
  select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as event_time,
    case when user_id % 2 = 0 then 'person' else 'vehicle' end as domain,
    user_id + 1 as identity_id,
    case when event_type in ('click', 'view') then 'recognition'
         when event_type = 'purchase' then 'recovery' else event_type end as event_type,
    least(1.0, value/500) as similarity, event_id % 64 as track_id,
    case when event_id % 9 = 0 then null else 'cam' || (user_id % 5) end as source_label,
    case when user_id % 2 = 1 and event_id % 3 <> 0 then 'B' || (user_id % 7) end as plate_number
  from events),
log_ok as (
  select * from log_in where domain in ('person', 'vehicle') and event_type in ('recognition', 'recovery'))"""


def log_events(spark: SparkSession, sf: str) -> DataFrame:
    """Identity events before validation."""
    u, e, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    return table(spark, sf, "events").select(
        "event_id",
        text.event_time_text(F.col("ts")).alias("event_time"),
        F.when(u % 2 == 0, "person").otherwise("vehicle").alias("domain"),
        (u + 1).alias("identity_id"),
        F.when(kind.isin("click", "view"), "recognition")
        .when(kind == "purchase", "recovery")
        .otherwise(kind)
        .alias("event_type"),
        F.least(F.lit(1.0), F.col("value") / 500).alias("similarity"),
        (e % 64).alias("track_id"),
        F.when(e % 9 != 0, F.concat(F.lit("cam"), (u % 5).cast("string"))).alias("source_label"),
        F.when((u % 2 == 1) & (e % 3 != 0), F.concat(F.lit("B"), (u % 7).cast("string"))).alias(
            "plate_number"
        ),
    )
