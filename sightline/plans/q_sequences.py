"""Runs, ages, histories, thinning and run statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import policy as pol
from sightline.functions import text
from sightline.operators import calibration, diagnostics, scan, sequences
from sightline.plans import derived as d
from sightline.plans.q_matching import AGES_SQL
from sightline.plans.registry import query
from sightline.session import cut_lineage

T = d.TRACKS_SQL
TRACK = ["camera_id", "domain", "track_id"]


@query("w01_track_age", f"with {AGES_SQL} select camera_id, domain, track_id, frame_index, age from aged")
def track_age(spark, sf):
    return sequences.track_age(d.tracks(spark, sf), TRACK).select(*TRACK, "frame_index", "age")


_EPOCH = f"""{T}, gaps as (select *, case when frame_index - lag(frame_index) over w = 1 then 0 else 1 end as g from tracks
  window w as (partition by camera_id, domain, track_id order by frame_index)),
epochs as (select *, sum(g) over (partition by camera_id, domain, track_id order by frame_index) as epoch from gaps)"""


@query("w02_track_epoch", f"with {_EPOCH} select camera_id, domain, track_id, frame_index, cast(epoch as bigint) as epoch from epochs")
def track_epoch(spark, sf):
    return sequences.track_age(d.tracks(spark, sf), TRACK).select(*TRACK, "frame_index", "epoch")


@query(
    "w03_presence_changes",
    f"""with {T}, {d.FRAMES_SQL}, pos as (select camera_id, frame_index, row_number() over (partition by camera_id order by frame_index) as p from frames),
    s as (select t.camera_id, t.track_id, p.p from tracks t join pos p using (camera_id, frame_index)),
    c as (select camera_id, p, count(*) as created, 0 as ended from s where not exists (select 1 from s z where z.camera_id = s.camera_id and z.track_id = s.track_id and z.p = s.p - 1) group by 1, 2),
    e as (select camera_id, p + 1 as p, 0 as created, count(*) as ended from s where not exists (select 1 from s z where z.camera_id = s.camera_id and z.track_id = s.track_id and z.p = s.p + 1) group by 1, 2),
    b as (select camera_id, p, cast(sum(created) as bigint) as created, cast(sum(ended) as bigint) as ended from (select * from c union all select * from e) group by 1, 2)
    select pos.camera_id, pos.frame_index, created, ended from b join pos using (camera_id, p)""",
)
def presence_changes(spark, sf):
    return sequences.presence_changes(d.tracks(spark, sf), d.frames(spark, sf), ["camera_id"])


_LOST = f"""{T}, {d.FRAMES_SQL}, pos as (select camera_id, frame_index, row_number() over (partition by camera_id order by frame_index) as p from frames),
s as (select t.camera_id, t.domain, t.track_id, p.p, lead(p.p) over (partition by t.camera_id, t.domain, t.track_id order by p.p) as nx from tracks t join pos p using (camera_id, frame_index)),
lp as (select camera_id, domain, track_id, min(p) + 5 as p from s where nx is null or nx - p > 5 group by 1, 2, 3),
lost as (select lp.camera_id, lp.domain, lp.track_id, pos.frame_index as lost_frame from lp join pos using (camera_id, p))"""


@query("w04_lost_periods", f"with {_LOST} select * from lost")
def lost_periods(spark, sf, tracks=None):
    # Frames belong to the camera; the domain only splits the tracks.
    tracks = (d.tracks(spark, sf) if tracks is None else tracks).withColumn("target", F.struct("domain", "track_id"))
    lost = sequences.lost_periods(
        tracks, d.frames(spark, sf), ["camera_id"], pol.PERSON_RECOVERY.lost_grace_frames, track="target"
    )
    return lost.select("camera_id", "target.domain", "target.track_id", "lost_frame")


_HISTORY = f"""{T}, m as (select camera_id, track_id, frame_index, x2-x1 as w, (x2-x1)*(y2-y1) as a, (x1+x2)/2 as x, (y1+y2)/2 as y,
    sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) as dg from tracks where class_id = 0),
md as (select *, quantile_cont(w, 0.5) over q as mw, quantile_cont(a, 0.5) over q as ma, quantile_cont(x, 0.5) over q as mx,
    quantile_cont(y, 0.5) over q as my, quantile_cont(dg, 0.5) over q as md from m
    window q as (partition by camera_id, track_id order by frame_index rows between 5 preceding and 1 preceding)),
ratios as (select camera_id, track_id, frame_index, case when mw is null then 1.0 else w/greatest(mw, 1e-6) end as width_ratio, case when mw is null then 1.0 else a/greatest(ma, 1e-6) end as area_ratio,
    case when mw is null then 0.0 else sqrt((x-mx)*(x-mx)+(y-my)*(y-my))/greatest(md, 1e-6) end as center_shift from md)"""


def _history(spark, sf):
    people = d.tracks(spark, sf).where(F.col("class_id") == 0)
    boxes = people.select("camera_id", "track_id", "frame_index", "x1", "y1", "x2", "y2")
    return sequences.geometry_history(boxes, ["camera_id", "track_id"], pol.GUARD)


@query(
    "w05_geometry_history",
    f"with {_HISTORY} select camera_id, track_id, frame_index, round(width_ratio, 6) as width_ratio, round(area_ratio, 6) as area_ratio, round(center_shift, 6) as center_shift from ratios",
)
def geometry_history(spark, sf):
    return _history(spark, sf).select(
        "camera_id",
        "track_id",
        "frame_index",
        *[F.round(c, 6).alias(c) for c in ("width_ratio", "area_ratio", "center_shift")],
    )


@query(
    "f08_geometry_anomaly",
    f"with {_HISTORY} select camera_id, track_id, frame_index, width_ratio > 1.45 or area_ratio > 1.70 or center_shift > 0.35 as anomalous from ratios",
)
def geometry_anomaly(spark, sf):
    return sequences.anomalies(_history(spark, sf), pol.GUARD).select(
        "camera_id", "track_id", "frame_index", "anomalous"
    )


@query(
    "w09_interval_thinning",
    f"""with recursive {T}, kept as (
      select camera_id, domain, track_id, min(frame_index) as frame_index from tracks group by 1, 2, 3
      union all
      select camera_id, domain, track_id, nx from (
        select k.camera_id, k.domain, k.track_id, (select min(t.frame_index) from tracks t where t.camera_id = k.camera_id and t.domain = k.domain
          and t.track_id = k.track_id and t.frame_index >= k.frame_index + 5) as nx from kept k) where nx is not null)
    select * from kept""",
)
def interval_thinning(spark, sf):
    rows = d.tracks(spark, sf).select(*TRACK, "frame_index")
    return sequences.thin(rows, TRACK, "frame_index", pol.PERSON_RECOVERY.interval)


@query(
    "w10_retry_cooldown",
    f"""with recursive {_EPOCH}, a as (select camera_id, domain, track_id, epoch, frame_index // 100 as gallery_version, frame_index, conf >= 0.5 as matched,
        row_number() over (partition by camera_id, domain, track_id, epoch, frame_index // 100 order by frame_index) as n from epochs),
    f as (select camera_id, domain, track_id, epoch, gallery_version, frame_index, n, matched, true as attempted,
        case when matched then -1 else frame_index + 15 end as retry_until from a where n = 1
      union all
      select a.camera_id, a.domain, a.track_id, a.epoch, a.gallery_version, a.frame_index, a.n, a.matched, a.frame_index >= f.retry_until,
        case when a.frame_index < f.retry_until then f.retry_until when a.matched then f.retry_until else a.frame_index + 15 end
      from f join a on a.camera_id = f.camera_id and a.domain = f.domain and a.track_id = f.track_id and a.epoch = f.epoch and a.gallery_version = f.gallery_version and a.n = f.n + 1)
    select camera_id, domain, track_id, frame_index, attempted from f""",
)
def retry_cooldown(spark, sf):
    from sightline.streaming import batch

    attempts = d.tracks(spark, sf).select(
        *TRACK,
        "frame_index",
        F.floor(F.col("frame_index") / 100).alias("gallery_version"),
        (F.col("conf") >= 0.5).alias("matched"),
    )
    return batch.retry_cooldown(attempts, TRACK, pol.PERSON_RECOGNITION.retry_interval).select(
        *TRACK, "frame_index", "attempted"
    )


_SOURCE = """src as (select user_id as source_id, event_id, cast(floor(epoch(ts)) as bigint) as tsec,
    case when event_id % 10 < 8 then 1920 else 1280 end as width, case when event_id % 10 < 8 then 1080 else 720 end as height from events)"""


@query(
    "w11_recording_segments",
    f"""with recursive {_SOURCE}, o as (select *, row_number() over (partition by source_id order by tsec, event_id) as n from src),
    f as (select source_id, event_id, n, tsec, width, height, 1 as segment, tsec as segment_start from o where n = 1
      union all
      select o.source_id, o.event_id, o.n, o.tsec, o.width, o.height,
        case when o.width <> f.width or o.height <> f.height or o.tsec - f.segment_start >= 172800 then f.segment + 1 else f.segment end,
        case when o.width <> f.width or o.height <> f.height or o.tsec - f.segment_start >= 172800 then o.tsec else f.segment_start end
      from f join o on o.source_id = f.source_id and o.n = f.n + 1)
    select source_id, event_id, cast(segment as bigint) as segment, segment_start from f""",
)
def recording_segments(spark, sf):
    e = F.col("event_id")
    frames = d.table(spark, sf, "events").select(
        F.col("user_id").alias("source_id"),
        "event_id",
        F.floor(d.epoch_micros(F.col("ts")) / 1_000_000).alias("at"),
        F.when(e % 10 < 8, 1920).otherwise(1280).alias("width"),
        F.when(e % 10 < 8, 1080).otherwise(720).alias("height"),
    )
    # Ties in the second are broken by the event number.
    out = sequences.segments(frames, ["source_id"], "at", ["width", "height"], 172800, ties=["event_id"])
    return out.select("source_id", "event_id", "segment", "segment_start")


@query(
    "w12_name_suffix",
    """with s as (select o_orderkey, strftime(o_orderdate, '%Y-%m-%d_%H-%M-%S') as stem,
        row_number() over (partition by o_orderpriority, o_orderdate order by o_orderkey) - 1 as n, o_orderpriority as folder from orders)
    select o_orderkey, folder, stem || case when n = 0 then '' else '_' || n end || '.mp4' as name from s""",
)
def name_suffix(spark, sf):
    starts = d.table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_orderpriority").alias("folder"),
        F.date_format("o_orderdate", "yyyy-MM-dd_HH-mm-ss").alias("stem"),
    )
    named = sequences.name_suffix(starts, ["folder"], "stem", ["o_orderkey"])
    tail = F.when(F.col("suffix") > 0, F.concat(F.lit("_"), F.col("suffix").cast("string"))).otherwise("")
    return named.select("o_orderkey", "folder", F.concat("stem", tail, F.lit(".mp4")).alias("name"))


@query(
    "w13_moving_fps",
    """with a as (select user_id, event_id, avg(value/1000) over (partition by user_id order by event_id rows between 29 preceding and current row) as m from events)
    select user_id, event_id, round(1.0/m, 6) as fps from a""",
)
def moving_fps(spark, sf):
    times = d.table(spark, sf, "events").select("user_id", "event_id", (F.col("value") / 1000).alias("seconds"))
    out = sequences.moving_mean(times, ["user_id"], "event_id", "seconds", pol.FPS_WINDOW)
    # The SQL divides by whatever the mean is: by zero it is infinite, without times null.
    fps = F.when(F.col("mean") == 0.0, F.lit(float("inf"))).otherwise(1.0 / F.col("mean"))
    return out.select("user_id", "event_id", F.round(fps, 6).alias("fps"))


@query(
    "w14_failure_runs",
    """with recursive p as (select user_id as source_id, event_id, event_type in ('error', 'signup') as failed,
        row_number() over (partition by user_id order by event_id) as n from events),
    q as (select *, n - row_number() over (partition by source_id order by n) as isl from p where failed),
    r as (select source_id, isl, min(event_id) as first_failure, max(n) as last_n, count(*) as failures from q group by 1, 2),
    e as (select source_id, max(n) as end_n from p group by 1),
    tries as (select source_id, isl, min(event_id) as event_id from q group by 1, 2
      union all select source_id, isl, nx from (select t.source_id, t.isl, (select min(q.event_id) from q where q.source_id = t.source_id and q.isl = t.isl and q.event_id >= t.event_id + 200) as nx from tries t) where nx is not null),
    tc as (select source_id, isl, count(*) as attempts from tries group by 1, 2)
    select source_id, row_number() over (partition by source_id order by first_failure) as run_no, first_failure, failures, last_n < end_n as recovered, attempts as reconnect_attempts
    from r join e using (source_id) join tc using (source_id, isl)""",
)
def failure_runs(spark, sf):
    status = d.table(spark, sf, "events").select(F.col("user_id").alias("source_id"), "event_id", "event_type")
    failed = F.col("event_type").isin("error", "signup")
    reads = sequences.failed_reads(status, ["source_id"], "event_id", failed)
    runs = sequences.failure_runs(reads, ["source_id"], "event_id")
    attempts = sequences.reconnect_attempts(reads, ["source_id"], "event_id", 200)
    return runs.join(attempts, ["source_id", "run_no"]).select(
        "source_id", "run_no", "first_failure", "failures", "recovered", "reconnect_attempts"
    )


# Labelled images: one per document, a dozen per vehicle.
_IMAGES = """images as (select 'v' || (doc_id // 12) as vehicle_id, case when doc_id % 10 = 0 then null else source end as camera_id,
    'img' || doc_id || case lang when 'en' then '.jpg' when 'de' then '.png' when 'es' then '.JPEG' else '.txt' end as image_name from documents),
valid as (select *, coalesce(camera_id, '(no camera)') as cam from images where lower(regexp_extract(image_name, '(\\.[^./]+)$', 1)) in ('.jpg', '.jpeg', '.png', '.bmp', '.webp'))"""


def images(spark, sf):
    i = F.col("doc_id")
    suffix = text.choose(F.col("lang"), {"en": ".jpg", "de": ".png", "es": ".JPEG"}, F.lit(".txt"))
    return d.table(spark, sf, "documents").select(
        F.concat(F.lit("v"), F.floor(i / 12).cast("string")).alias("vehicle_id"),
        F.when(i % 10 != 0, F.col("source")).alias("camera_id"),
        F.concat(F.lit("img"), i.cast("string"), suffix).alias("image_name"),
    )


_SAMPLE = f"""{_IMAGES}, avail as (select vehicle_id, count(*) as available from valid group by 1 having count(*) >= 4),
chosen as (select vehicle_id from avail order by md5('42|' || vehicle_id) limit 20),
r1 as (select v.*, row_number() over (partition by v.vehicle_id, cam order by md5('42|' || image_name), image_name) as rnd from valid v join chosen using (vehicle_id)),
r2 as (select *, row_number() over (partition by vehicle_id order by rnd, md5('42|' || vehicle_id || '|' || cam), cam) as pick from r1),
picked as (select * from r2 where pick <= 4)"""


def _picked(spark, sf):
    ok = text.image_suffix_ok(F.col("image_name"))
    return calibration.balanced_sample(images(spark, sf), ok, 20, 4, "42")


@query("w15_balanced_sample", f"with {_SAMPLE} select vehicle_id, image_name, camera_id, cast(pick as integer) as pick from picked")
def balanced_sample(spark, sf):
    return _picked(spark, sf).select("vehicle_id", "image_name", "camera_id", "pick")


@query(
    "a22_sampling_summary",
    f"""with {_SAMPLE} select vehicle_id, available, count(*) as selected, count(distinct camera_id) as cameras from picked join avail using (vehicle_id) group by 1, 2""",
)
def sampling_summary(spark, sf):
    ok = text.image_suffix_ok(F.col("image_name"))
    available = calibration.eligible_identities(images(spark, sf), ok, 4)
    picked = _picked(spark, sf).groupBy("vehicle_id").agg(
        F.count(F.lit(1)).alias("selected"), F.countDistinct("camera_id").alias("cameras")
    )
    return picked.join(available, "vehicle_id").select("vehicle_id", "available", "selected", "cameras")


@query(
    "u06_image_validator",
    f"""with {_IMAGES}, ok as (select * from images where image_name like '%1%' and camera_id is not null)
    select vehicle_id, count(*) as available from ok group by 1 having count(*) >= 2""",
)
def image_validator(spark, sf):
    """Eligible identities under a caller's own idea of a valid image."""
    mine = F.col("image_name").contains("1") & F.col("camera_id").isNotNull()
    return calibration.eligible_identities(images(spark, sf), mine, 2)


@query(
    "f09_identities_with_valid_images",
    f"with {_IMAGES} select vehicle_id, count(*) as images from images where vehicle_id in (select vehicle_id from valid) group by 1",
)
def identities_with_valid_images(spark, sf):
    every = images(spark, sf)
    valid = every.where(text.image_suffix_ok(F.col("image_name"))).select("vehicle_id")
    return every.join(valid, "vehicle_id", "left_semi").groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("images"))


@query(
    "w16_fifo_bank",
    f"""with {T}, b as (select camera_id, domain, track_id, frame_index, list(k % 100) over (partition by camera_id, domain, track_id order by frame_index rows between 7 preceding and current row) as bank from tracks)
    select camera_id, domain, track_id, frame_index, array_to_string(bank, ',') as bank from b""",
)
def fifo_bank(spark, sf):
    refs = d.tracks(spark, sf).select(*TRACK, "frame_index", (F.col("k") % 100).cast("string").alias("item"))
    bank = sequences.fifo_bank(refs, TRACK, "frame_index", "item", pol.PERSON_RECOVERY.bank_size)
    return bank.select(*TRACK, "frame_index", F.array_join("bank", ",").alias("bank"))


@query(
    "w17_sweep_batches",
    f"""with {AGES_SQL}, r as (select *, row_number() over (partition by camera_id, frame_index order by age, track_id) as rank from aged where age >= 2)
    select camera_id, frame_index, track_id, cast(rank as integer) as rank, (rank - 1) // 3 as batch from r""",
)
def sweep_batches(spark, sf):
    aged = sequences.track_age(d.tracks(spark, sf), TRACK).where(F.col("age") >= 2)
    out = sequences.sweep_batches(aged, ["camera_id", "frame_index"], pol.PERSON_RECOVERY.budget)
    return out.select("camera_id", "frame_index", "track_id", "rank", "batch")


@query(
    "w18_votes_per_epoch",
    f"""with {_EPOCH} select camera_id, track_id, cast(epoch as bigint) as epoch, 'B' || k % 3 as plate, count(*) as votes from epochs where domain = 'vehicle' group by 1, 2, 3, 4""",
)
def votes_per_epoch(spark, sf):
    vehicles = d.tracks(spark, sf).where(F.col("domain") == "vehicle")
    plate = F.concat(F.lit("B"), (F.col("k") % 3).cast("string")).alias("plate")
    epochs = sequences.track_age(vehicles, TRACK)
    return epochs.groupBy("camera_id", "track_id", "epoch", plate).agg(F.count(F.lit(1)).alias("votes"))


@query(
    "a11_run_stats",
    f"""with {T}, {d.FRAMES_SQL}, f as (select camera_id, count(*) as frames from frames group by 1),
    u as (select camera_id, count(distinct track_id) filter (where domain = 'person') as p, count(distinct track_id) filter (where domain = 'vehicle') as v from tracks group by 1)
    select camera_id, frames, frames as inference_count, p as unique_person_tracks, v as unique_vehicle_tracks from f join u using (camera_id)""",
)
def run_stats(spark, sf):
    return diagnostics.run_stats(d.frames(spark, sf), d.tracks(spark, sf), ["camera_id"])


@query(
    "a11_track_sketches",
    f"""with {T}, u as (select domain, count(distinct camera_id || '|' || track_id) as exact from tracks group by 1)
    select domain, exact, true as within_two_percent from u""",
)
def track_sketches(spark, sf):
    """Sketches of every camera and stretch of frames, united, beside the exact counts."""
    tracks = d.tracks(spark, sf)
    parts = diagnostics.track_sketches(tracks.withColumn("part", F.floor(F.col("frame_index") / 1000)), ["camera_id", "part"])
    united = diagnostics.united_tracks(parts, []).select("domain", "unique_tracks")
    exact = tracks.select("domain", "camera_id", "track_id").distinct().groupBy("domain").agg(F.count(F.lit(1)).alias("exact"))
    near = F.abs(F.col("unique_tracks") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 0.02)
    return exact.join(united, "domain").select("domain", "exact", near.alias("within_two_percent"))


@query(
    "a12_recent_unique_tracks",
    """with r as (select event_type as source, user_id, row_number() over (partition by event_type order by event_id desc) as rn from events)
    select source, count(distinct user_id) as unique_tracks from r where rn <= 1024 group by 1""",
)
def recent_unique_tracks(spark, sf):
    obs = d.table(spark, sf, "events").select(
        F.col("event_type").alias("source"), F.col("user_id").alias("track_id"), "event_id"
    )
    return diagnostics.recent_unique_tracks(obs, ["source"], "event_id", 1024)


_STATS = """st as (select user_id as source_id, value/1000 - 0.005 as frame_seconds, value/4000 as tracking_seconds, event_type in ('click', 'view') as recovery_due,
    event_id % 7 as recovery_candidates, event_type = 'click' as sweep_started, event_type = 'view' as sweep_completed, event_id % 5 as sweep_candidates,
    event_id % 4 - 1 as sweep_processed, event_id % 6 as sweep_frames, value as sweep_reid_ms, event_id % 3 as retry_skipped from events),
g as (select *, greatest(0.0, frame_seconds) as fs from st)"""


def _frame_stats(spark, sf):
    e, v, kind = F.col("event_id"), F.col("value"), F.col("event_type")
    return d.table(spark, sf, "events").select(
        F.col("user_id").alias("source_id"),
        (v / 1000 - 0.005).alias("frame_seconds"),
        (v / 4000).alias("tracking_seconds"),
        kind.isin("click", "view").alias("recovery_due"),
        (e % 7).alias("recovery_candidates"),
        (kind == "click").alias("sweep_started"),
        (kind == "view").alias("sweep_completed"),
        (e % 5).alias("sweep_candidates"),
        (e % 4 - 1).alias("sweep_processed"),
        (e % 6).alias("sweep_frames"),
        v.alias("sweep_reid_ms"),
        (e % 3).alias("retry_skipped"),
    )


@query(
    "a13_diagnostics_summary",
    f"""with {_STATS} select source_id, count(*) as frames, round(count(*)/sum(fs), 9) as average_fps, round(sum(fs)*1000/count(*), 9) as frame_total_ms,
      round(sum(tracking_seconds)*1000/count(*), 9) as tracking_ms,
      round(coalesce(avg(fs) filter (where not recovery_due), 0.0)*1000, 9) as normal_frame_ms, round(coalesce(avg(fs) filter (where recovery_due), 0.0)*1000, 9) as recovery_frame_ms,
      round(coalesce(max(fs) filter (where recovery_due), 0.0)*1000, 9) as recovery_frame_max_ms,
      cast(coalesce(sum(recovery_candidates) filter (where recovery_due), 0) as bigint) as recovery_candidate_count,
      count(*) filter (where sweep_started) as sweep_started_count, count(*) filter (where sweep_completed) as sweep_completed_count,
      cast(coalesce(sum(sweep_candidates) filter (where sweep_started), 0) as bigint) as sweep_candidate_total,
      cast(sum(greatest(0, sweep_processed)) as bigint) as sweep_processed_total,
      cast(coalesce(sum(sweep_frames) filter (where sweep_completed), 0) as bigint) as sweep_frame_total,
      round(coalesce(sum(sweep_reid_ms) filter (where sweep_completed), 0.0), 9) as sweep_reid_total_ms, cast(sum(retry_skipped) as bigint) as retry_skipped_total
    from g group by 1""",
)
def diagnostics_summary(spark, sf):
    out = diagnostics.summary(_frame_stats(spark, sf), ["source_id"])
    exact = {n for n, t in out.dtypes if t == "double"}
    return out.select(*[F.round(c, 9).alias(c) if c in exact else F.col(c) for c in out.columns])


@query(
    "a17_timing_report",
    """select event_type as stage, count(*) as samples, round(avg(value), 6) as avg_ms, min(value) as min_ms, round(quantile_cont(value, 0.5), 6) as p50_ms,
      round(quantile_cont(value, 0.95), 6) as p95_ms, max(value) as max_ms, round(1000/avg(value), 6) as fps from events group by 1""",
)
def timing_report(spark, sf):
    samples = d.table(spark, sf, "events").select(F.col("event_type").alias("stage"), "value")
    out = diagnostics.timing_report(samples, ["stage"], "value")
    return out.select(
        "stage",
        "samples",
        *[F.round(c, 6).alias(c) for c in ("avg_ms", "min_ms", "p50_ms", "p95_ms", "max_ms", "fps")],
    )


@query(
    "a21_domain_counters",
    f"""with {_LOST}, first as (select camera_id, domain, track_id, min(frame_index) as f from tracks group by 1, 2, 3),
    c as (select fr.camera_id, fr.frame_index, count(*) filter (where domain = 'person' and frame_index >= f and (lost_frame is null or frame_index < lost_frame)) as person_active,
      count(*) filter (where domain = 'person' and frame_index >= lost_frame) as person_lost,
      count(*) filter (where domain = 'vehicle' and frame_index >= f and (lost_frame is null or frame_index < lost_frame)) as vehicle_active,
      count(*) filter (where domain = 'vehicle' and frame_index >= lost_frame) as vehicle_lost
      from frames fr join (select * from first left join lost using (camera_id, domain, track_id)) x on x.camera_id = fr.camera_id group by 1, 2)
    select * from c""",
)
def domain_counters(spark, sf):
    keys = ["camera_id", "frame_index"]
    # Two readers: first appearances and losses.
    tracks = cut_lineage(d.tracks(spark, sf).select("camera_id", "domain", "track_id", "frame_index"))
    frames = d.frames(spark, sf)
    starts = tracks.groupBy("camera_id", "domain", "track_id").agg(F.min("frame_index").alias("frame_index"))
    lost = lost_periods(spark, sf, tracks).withColumnRenamed("lost_frame", "frame_index")
    changes = diagnostics.target_changes(starts, lost, keys)
    counts = ["person_active", "person_lost", "vehicle_active", "vehicle_lost"]
    filled = frames.select(*keys).join(changes, keys, "left").fillna(0, counts)
    return scan.running_totals(filled, ["camera_id"], "frame_index", counts)


@query(
    "o04_round_robin",
    f"""with {T}, r as (select *, row_number() over (partition by camera_id, frame_index order by track_id) as rank, count(*) over (partition by camera_id, frame_index) as n from tracks)
    select camera_id, frame_index, track_id, ((rank - 1 - frame_index) % n + n) % n as turn from r""",
)
def round_robin(spark, sf):
    keys = ["camera_id", "frame_index"]
    from pyspark.sql import Window

    ranked = d.tracks(spark, sf).select(*keys, "track_id").withColumn(
        "rank", F.row_number().over(Window.partitionBy(*keys).orderBy("track_id"))
    )
    return sequences.rotate(ranked, keys, "rank", F.col("frame_index")).select(*keys, "track_id", "turn")


@query(
    "o05_visible_difference",
    f"""with {T} select camera_id, frame_index + 1 as frame_index, track_id from tracks except
    select camera_id, frame_index, track_id from tracks""",
)
def visible_difference(spark, sf):
    """Tracks of the previous frame that are gone in this one."""
    seen = d.tracks(spark, sf).select("camera_id", "frame_index", "track_id")
    before = seen.withColumn("frame_index", F.col("frame_index") + 1)
    return before.join(seen, ["camera_id", "frame_index", "track_id"], "left_anti")
