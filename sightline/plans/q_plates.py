"""Identifiers, names, plates and late results."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import policy as pol
from sightline.functions import text
from sightline.operators import plates, quality
from sightline.plans import derived as d
from sightline.plans.registry import query

P = pol.PLATE
PO = d.PLATES_SQL
_GATED = f"""{PO}, gated as (select *, upper(regexp_replace(plate, '\\s+', '', 'g')) as np from plate_obs
  where upper(regexp_replace(plate, '\\s+', '', 'g')) <> '' and conf >= {P.min_confidence}
    and least(crop_w, x2) - greatest(0, x1) >= {P.min_width} and least(crop_h, y2) - greatest(0, y1) >= {P.min_height} and sharpness >= {P.min_sharpness})"""


@query(
    "p20_identity_ids",
    """with c as (select c_custkey, case when c_nationkey % 2 = 0 then 'person' else 'vehicle' end as domain, c_custkey from customer),
    t as (select c_custkey, case c_custkey % 5 when 0 then 'P' || lpad(cast(c_custkey as varchar), 3, '0') when 1 then 'p' || c_custkey when 2 then ' ' || c_custkey || ' '
       when 3 then 'V' || c_custkey else '-' || c_custkey end as raw from customer)
    select c.c_custkey, case when c.c_custkey >= 1 then case domain when 'person' then 'P' else 'V' end || lpad(cast(c.c_custkey as varchar), cast(greatest(3, length(cast(c.c_custkey as varchar))) as integer), '0') end as display_id,
      coalesce(nullif(try_cast(nullif(regexp_extract(upper(trim(raw)), '^P?([0-9]+)$', 1), '') as bigint), 0), -1) as parsed
    from c join t using (c_custkey)""",
)
def identity_ids(spark, sf):
    c = F.col("c_custkey")
    n = c.cast("string")
    raw = (
        F.when(c % 5 == 0, F.concat(F.lit("P"), F.lpad(n, 3, "0")))
        .when(c % 5 == 1, F.concat(F.lit("p"), n))
        .when(c % 5 == 2, F.concat(F.lit(" "), n, F.lit(" ")))
        .when(c % 5 == 3, F.concat(F.lit("V"), n))
        .otherwise(F.concat(F.lit("-"), n))
    )
    domain = F.when(F.col("c_nationkey") % 2 == 0, "person").otherwise("vehicle")
    # Numbers of four and more digits are cut by lpad above; both sides cut alike.
    return d.table(spark, sf, "customer").select(
        "c_custkey",
        text.display_id(domain, c).alias("display_id"),
        F.coalesce(text.parse_display_id(raw, "P"), F.lit(-1)).alias("parsed"),
    )


@query(
    "p21_normalize_plate",
    r"""select event_id, nullif(upper(regexp_replace(case when event_id % 9 = 0 then '   ' else ' 京 a' || event_type || chr(9) || user_id end, '\s+', '', 'g')), '') as plate from events""",
)
def normalize_plate(spark, sf):
    raw = F.when(F.col("event_id") % 9 == 0, "   ").otherwise(
        F.concat(F.lit(" 京 a"), "event_type", F.lit("\t"), F.col("user_id").cast("string"))
    )
    return d.table(spark, sf, "events").select("event_id", text.normalize_plate(raw).alias("plate"))


@query(
    "p22_adapt_readings",
    """with r as (select *, event_id % 6 as shape, cast(json_extract(props, '$.k') as integer) as k from events)
    select event_id, 'B' || user_id as plate, value as conf, cast(1 as integer) as x1, cast(2 as integer) as y1, cast(round_even(k + 10.5, 0) as integer) as x2, cast(40 as integer) as y2
    from r where shape < 4""",
)
def adapt_readings(spark, sf):
    """Provider results in four complete shapes and two incomplete ones."""
    k = F.get_json_object("props", "$.k").cast("int")
    n, v = F.col("user_id").cast("string"), F.col("value").cast("string")
    right = (k + 10.5).cast("string")
    box = F.concat(F.lit("[1, 2, "), right, F.lit(", 40]"))
    shape = F.col("event_id") % 6
    raw = (
        F.when(shape == 0, F.concat(F.lit('{"plate_number": "b '), n, F.lit('", "confidence": '), v, F.lit(', "bbox": '), box, F.lit("}")))
        .when(shape == 1, F.concat(F.lit('{"text": "B'), n, F.lit('", "score": '), v, F.lit(', "box": '), box, F.lit("}")))
        .when(shape == 2, F.concat(F.lit('["B '), n, F.lit('", '), v, F.lit(", "), box, F.lit("]")))
        .when(shape == 3, F.concat(F.lit('["b'), n, F.lit('", '), v, F.lit(", 1, 2, "), right, F.lit(", 40]")))
        .when(shape == 4, F.concat(F.lit('{"code": "B'), n, F.lit('", "confidence": '), v, F.lit("}")))
        .otherwise(F.concat(F.lit('{"confidence": '), v, F.lit(', "bbox": '), box, F.lit("}")))
    )
    rows = d.table(spark, sf, "events").select("event_id", raw.alias("raw"))
    return plates.adapt_readings(rows, F.col("raw")).drop("raw")


@query(
    "p25_recording_names",
    """with n as (select event_id, case event_id % 5 when 0 then strftime(ts, '%Y-%m-%d_%H-%M-%S') || '.mp4' when 1 then strftime(ts, '%Y-%m-%d_%H-%M-%S') || '_' || (event_id % 13) || '.mp4'
        when 2 then '2024-13-01_00-00-00.mp4' when 3 then 'clip_' || event_id || '.mp4' else strftime(ts, '%Y-%m-%d_%H-%M-%S') || '.avi' end as name from events),
    p as (select *, try_strptime(nullif(regexp_extract(name, '^(\\d{4}-\\d{2}-\\d{2}_\\d{2}-\\d{2}-\\d{2})(?:_(\\d+))?\\.mp4$', 1), ''), '%Y-%m-%d_%H-%M-%S') as t from n)
    select event_id, name, t is not null as managed, strftime(t, '%Y-%m-%d %H:%M:%S') as started,
      coalesce(try_cast(nullif(regexp_extract(name, '^(\\d{4}-\\d{2}-\\d{2}_\\d{2}-\\d{2}-\\d{2})(?:_(\\d+))?\\.mp4$', 2), '') as bigint), 0) as suffix from p""",
)
def recording_names(spark, sf):
    named = recordings(spark, sf)
    at = text.recording_time(F.col("name"))
    return named.select(
        "event_id",
        "name",
        at.isNotNull().alias("managed"),
        text.event_time_text(at).alias("started"),
        text.recording_suffix(F.col("name")).alias("suffix"),
    )


def recordings(spark, sf):
    e = F.col("event_id")
    stem = F.date_format("ts", "yyyy-MM-dd_HH-mm-ss")
    name = (
        F.when(e % 5 == 0, F.concat(stem, F.lit(".mp4")))
        .when(e % 5 == 1, F.concat(stem, F.lit("_"), (e % 13).cast("string"), F.lit(".mp4")))
        .when(e % 5 == 2, "2024-13-01_00-00-00.mp4")
        .when(e % 5 == 3, F.concat(F.lit("clip_"), e.cast("string"), F.lit(".mp4")))
        .otherwise(F.concat(stem, F.lit(".avi")))
    )
    return d.table(spark, sf, "events").select("event_id", F.col("user_id").alias("folder"), name.alias("name"))


@query(
    "p26_usable_fps",
    """with v as (select event_id, case when event_id % 7 = 0 then cast('nan' as double) when event_id % 7 = 1 then cast('inf' as double) when event_id % 7 = 2 then -value else value end as fps from events)
    select event_id, case when isfinite(fps) and fps > 0 and fps <= 240 then fps else 25.0 end as fps from v""",
)
def usable_fps(spark, sf):
    e = F.col("event_id") % 7
    fps = (
        F.when(e == 0, F.lit(float("nan")))
        .when(e == 1, F.lit(float("inf")))
        .when(e == 2, -F.col("value"))
        .otherwise(F.col("value"))
    )
    return d.table(spark, sf, "events").select("event_id", text.usable_fps(fps, 25.0).alias("fps"))


@query(
    "p27_batch_plan",
    """select o_orderkey, array_to_string(list_concat(list_concat(list_concat(list_transform(range(n // 8), lambda x: 8), list_transform(range((n % 8) // 4), lambda x: 4)),
      list_transform(range((n % 4) // 2), lambda x: 2)), list_transform(range(n % 2), lambda x: 1)), ',') as batches from (select o_orderkey, o_custkey % 40 as n from orders)""",
)
def batch_plan(spark, sf):
    n = (F.col("o_custkey") % 40).cast("int")
    plan = F.array_join(F.transform(text.batch_plan(n), lambda x: x.cast("string")), ",")
    return d.table(spark, sf, "orders").select("o_orderkey", plan.alias("batches"))


@query("p28_event_time_text", "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as event_time from events")
def event_time_text(spark, sf):
    return d.table(spark, sf, "events").select("event_id", text.event_time_text(F.col("ts")).alias("event_time"))


def gated_plates(spark, sf):
    return quality.plate_gate(d.plate_obs(spark, sf), P)


@query("f04_plate_gate", f"with {_GATED} select camera_id, track_id, frame_index, obs_idx, np as plate, conf from gated")
def plate_gate(spark, sf):
    return gated_plates(spark, sf).select("camera_id", "track_id", "frame_index", "obs_idx", "plate", "conf")


@query(
    "a23_plate_vote",
    f"""with {_GATED}, h as (select camera_id, track_id, np, count(*) as hits from gated group by 1, 2, 3),
    r as (select *, row_number() over (partition by camera_id, track_id order by hits desc, np desc) as rn from h)
    select camera_id, track_id, np as plate, hits from r where rn = 1""",
)
def plate_vote(spark, sf):
    return plates.vote(gated_plates(spark, sf), ["camera_id", "track_id"])


@query(
    "a24_best_reading",
    f"""with {_GATED}, r as (select *, frame_index // 4 as step, row_number() over (partition by camera_id, track_id, frame_index // 4 order by conf desc, obs_idx) as rn from gated)
    select camera_id, track_id, step, obs_idx, np as plate, conf from r where rn = 1""",
)
def best_reading(spark, sf):
    obs = gated_plates(spark, sf).select(
        "camera_id", "track_id", F.floor(F.col("frame_index") / 4).alias("step"), "obs_idx", "plate", "conf"
    )
    return plates.best_reading(obs, ["camera_id", "track_id", "step"])


_KEY = "camera_id, domain, track_id"
# Every second track is bound to a target and keeps its plate through interruptions.
_CONFIRM = f"""{_GATED}, g1 as (select *, case when frame_index - lag(frame_index) over (partition by {_KEY}, track_epoch order by frame_index) <= {P.pending_max_age} then 0 else 1 end as b from gated),
g2 as (select *, sum(b) over (partition by {_KEY}, track_epoch order by frame_index) as run from g1),
g3 as (select *, row_number() over (partition by {_KEY}, track_epoch, run, np order by frame_index) as vote from g2),
g4 as (select *, row_number() over (partition by {_KEY}, case when track_id % 2 = 0 then -1 else track_epoch end order by frame_index) as first from g3 where vote = {P.hits}),
confirmed as (select {_KEY}, track_epoch, frame_index, np as plate, conf, sharpness from g4 where first = 1)"""


def confirmed_plates(spark, sf):
    bound = F.col("track_id") % 2 == 0
    return plates.confirmations(gated_plates(spark, sf), d.TRACK, P, epoch="track_epoch", bound=bound)


@query("t07_plate_confirmation", f"with {_CONFIRM} select * from confirmed")
def plate_confirmation(spark, sf):
    return confirmed_plates(spark, sf)


# Results of background readings: each event is one, arriving a few frames later.
_RESULTS = """res as (select event_id as task_id, cast(user_id % 3 as varchar) as camera_id, user_id // 3 as track_id, frame_no as submit_frame, frame_no + event_id % 19 as arrive_frame, event_id % 3 as track_epoch,
    case when event_id % 4 = 0 then null else user_id % 5 end as target_id, case when event_id % 2 = 0 then 'B1' end as plate_at_submit, event_id % 23 <> 0 as task_known,
    case when event_type = 'error' then 'Timeout' end as error
  from (select *, row_number() over (partition by user_id order by ts, event_id) as frame_no from events)),
states as (select cast(user_id % 3 as varchar) as camera_id, user_id // 3 as track_id, frame_no as frame_index, case when event_type = 'signup' then 0 else 2 end as class_id, event_id % 3 as track_epoch,
    case when event_id % 6 = 0 then null else user_id % 5 end as target_id, case event_id % 5 when 0 then 'B1' when 1 then 'B2' end as stable_plate
  from (select *, row_number() over (partition by user_id order by ts, event_id) as frame_no from events))"""


def late_results(spark, sf):
    from sightline.operators import scan

    ev = d.table(spark, sf, "events").withColumn("at", d.epoch_micros(F.col("ts")))
    ev = scan.with_position(ev, ["user_id"], "at", ["event_id"], chunk=86_400_000_000, name="frame_no")
    e, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    results = ev.select(
        e.alias("task_id"),
        *d.track_of(u),
        F.col("frame_no").alias("submit_frame"),
        (F.col("frame_no") + e % 19).alias("arrive_frame"),
        (e % 3).alias("track_epoch"),
        F.when(e % 4 != 0, u % 5).alias("target_id"),
        F.when(e % 2 == 0, "B1").alias("plate_at_submit"),
        (e % 23 != 0).alias("task_known"),
        F.when(kind == "error", "Timeout").alias("error"),
    )
    states = ev.select(
        *d.track_of(u),
        F.col("frame_no").alias("frame_index"),
        F.when(kind == "signup", 0).otherwise(2).alias("class_id"),
        (e % 3).alias("track_epoch"),
        F.when(e % 6 != 0, u % 5).alias("target_id"),
        F.when(e % 5 == 0, "B1").when(e % 5 == 1, "B2").alias("stable_plate"),
    )
    return results, states


@query(
    "t08_late_results",
    f"""with {_RESULTS} select r.task_id, case when not task_known then 'unknown_task' when error is not null then 'failed' when s.track_id is null then 'track_missing'
      when s.class_id not in (2, 5, 7) then 'class_changed' when arrive_frame - submit_frame > {P.max_result_age} then 'result_expired'
      when s.track_epoch is distinct from r.track_epoch then 'track_epoch_changed' when r.target_id is not null and s.target_id is distinct from r.target_id then 'target_changed'
      when s.stable_plate is not null and s.stable_plate is distinct from r.plate_at_submit then 'plate_state_changed' else 'usable' end as outcome
    from res r left join states s on s.camera_id = r.camera_id and s.track_id = r.track_id and s.frame_index = r.arrive_frame""",
)
def late_result_reasons(spark, sf):
    results, states = late_results(spark, sf)
    judged = plates.stale_reason(results, states, P)
    return judged.select("task_id", F.coalesce("reason", F.lit("usable")).alias("outcome"))


@query(
    "t09_latest_only_slot",
    """with t as (select user_id as worker_id, event_id // 500 as batch_no, event_id as task_id, case when event_type = 'purchase' then 'external' else 'live' end as kind from events)
    select worker_id, batch_no, kind, case when kind = 'external' then min(task_id) else max(task_id) end as task_id, count(*) - 1 as dropped from t group by 1, 2, 3""",
)
def latest_only_slot(spark, sf):
    tasks = d.table(spark, sf, "events").select(
        F.col("user_id").alias("worker_id"),
        F.floor(F.col("event_id") / 500).alias("batch_no"),
        F.col("event_id").alias("task_id"),
        F.when(F.col("event_type") == "purchase", "external").otherwise("live").alias("kind"),
    )
    return plates.latest_only(tasks, ["worker_id", "batch_no"], ["task_id"]).select(
        "worker_id", "batch_no", "kind", "task_id", "dropped"
    )


_BOUND = f"""{_CONFIRM}, bound as (select distinct cast(user_id % 3 as varchar) as camera_id, 'vehicle' as domain, user_id // 3 as track_id, user_id // 2 as target_id, case when user_id // 2 % 4 <> 0 then user_id // 2 end as identity_id,
    user_id % 3 * 2 as from_frame, case when user_id % 2 = 0 then user_id % 3 * 2 + 30 end as to_frame from events),
ident as (select distinct user_id // 2 as identity_id, case when user_id // 2 % 5 = 0 then 'KNOWN' end as plate_number from events),
seen as (select * from confirmed join bound using (camera_id, domain, track_id) where frame_index >= from_frame and (to_frame is null or frame_index <= to_frame))"""


@query(
    "t10_plate_propagation",
    f"""with {_BOUND}, t as (select 'target' as kind, target_id as id, plate, row_number() over (partition by target_id order by frame_index, camera_id, domain, track_id, plate) as rn from seen),
    f as (select identity_id, plate, row_number() over (partition by identity_id order by frame_index, camera_id, domain, track_id, plate) as rn from seen where identity_id is not null)
    select kind, id, plate from t where rn = 1 union all
    select 'identity', i.identity_id, coalesce(i.plate_number, f.plate) from ident i left join f on f.identity_id = i.identity_id and f.rn = 1 where coalesce(i.plate_number, f.plate) is not null""",
)
def plate_propagation(spark, sf):
    u = F.col("user_id")
    users = d.table(spark, sf, "events").select("user_id").distinct()
    target = F.floor(u / 2)
    bound = users.select(
        *d.track_of(u),
        target.alias("target_id"),
        F.when(target % 4 != 0, target).alias("identity_id"),
        (u % 3 * 2).alias("from_frame"),
        F.when(u % 2 == 0, u % 3 * 2 + 30).alias("to_frame"),
    )
    identities = users.select(target.alias("identity_id")).distinct().withColumn(
        "plate_number", F.when(F.col("identity_id") % 5 == 0, "KNOWN")
    )
    targets, filled = plates.propagate(
        confirmed_plates(spark, sf).select(*d.TRACK, "frame_index", "plate"), bound, identities
    )
    known = filled.where(F.col("plate_number").isNotNull())
    return targets.select(F.lit("target").alias("kind"), F.col("target_id").alias("id"), "plate").unionByName(
        known.select(F.lit("identity").alias("kind"), F.col("identity_id").alias("id"), F.col("plate_number").alias("plate"))
    )


@query(
    "a18_reader_stats",
    """with t as (select user_id as worker_id, value as elapsed_ms, epoch(ts) as submitted_at, case event_type when 'error' then 'failed' when 'signup' then 'dropped' when 'view' then 'expired' else 'completed' end as status from events)
    select worker_id, count(*) as submitted, count(*) filter (where status <> 'dropped') as completed, count(*) filter (where status = 'failed') as failed,
      count(*) filter (where status = 'dropped') as dropped, count(*) filter (where status = 'expired') as expired,
      round(case when max(submitted_at) > min(submitted_at) then count(*) filter (where status <> 'dropped') / (max(submitted_at) - min(submitted_at)) else 0.0 end, 10) as actual_hz,
      round(avg(elapsed_ms) filter (where status <> 'dropped'), 9) as avg_ms, max(elapsed_ms) filter (where status <> 'dropped') as max_ms from t group by 1""",
)
def reader_stats(spark, sf):
    status = text.choose(
        F.col("event_type"), {"error": "failed", "signup": "dropped", "view": "expired"}, F.lit("completed")
    )
    tasks = d.table(spark, sf, "events").select(
        F.col("user_id").alias("worker_id"),
        F.col("value").alias("elapsed_ms"),
        (d.epoch_micros(F.col("ts")) / 1e6).alias("submitted_at"),
        status.alias("status"),
    )
    out = plates.worker_stats(tasks, ["worker_id"])
    return out.withColumn("actual_hz", F.round("actual_hz", 10)).withColumn("avg_ms", F.round("avg_ms", 9))
