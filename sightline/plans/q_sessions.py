"""Stateful operators: targets, banks, sweeps, guards and greedy choices."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from sightline import policy as pol
from sightline.functions import vectors as v
from sightline.operators import dumps, lifecycle, scan
from sightline.plans import derived as d
from sightline.plans.q_geometry import IN_FRAME_SQL, valid_scores
from sightline.plans.q_store import _PAIRS, _REASON_SQL, _divergence_rows, _two_runs
from sightline.plans.registry import query
from sightline.streaming import batch

# Vectors of the test tables are random, so likeness starts far below real values.
_NAMING = {"threshold": 0.30, "margin": 0.02}
OPTIONS = {
    "person": {
        "recovery": replace(pol.PERSON_RECOVERY, threshold=0.70, support_threshold=0.65, reference_update_threshold=0.65),
        "recognition": replace(pol.PERSON_RECOGNITION, **_NAMING),
        "enrichment": replace(pol.ENRICHMENT, stable_frames=5),
        "retention": 4.0,
    },
    "vehicle": {
        "recovery": pol.VEHICLE_RECOVERY,
        "recognition": replace(pol.VEHICLE_RECOGNITION, **_NAMING),
        "enrichment": replace(pol.ENRICHMENT, stable_frames=5),
        "retention": 4.0,
    },
}
GATES = {"person": pol.PERSON_QUALITY, "vehicle": pol.VEHICLE_QUALITY}
FPS = 25.0


def _vector_ids(e, tracks):
    """The numbers of the two vectors that make up the one of a box, as ``_a`` and ``_b``."""
    n = e.count()
    base = F.pmod(F.col("camera_id").cast("bigint") * 7 + F.col("track_id") * 3, F.lit(max(1, n // 8))) * 8
    return tracks.withColumn("_a", base).withColumn("_b", F.pmod("k", F.lit(n)))


def _with_vectors(e, rows):
    """``embedding`` in place of ``_a`` and ``_b``."""
    a = e.select(F.col("vec_id").alias("_a"), F.col("embedding").alias("_va"))
    b = e.select(F.col("vec_id").alias("_b"), F.col("embedding").alias("_vb"))
    mixed = F.zip_with("_va", "_vb", lambda x, y: (x + y * 0.4).cast("float"))
    kept = [c for c in rows.columns if c not in ("_a", "_b")]
    return rows.join(a, "_a").join(b, "_b").select(*kept, mixed.alias("embedding"))


def track_vectors(spark, sf, tracks):
    """A vector per box: mostly the one of its track, partly one of the frame."""
    e = d.table(spark, sf, "embeddings")
    return _with_vectors(e, _vector_ids(e, tracks).select("camera_id", "domain", "frame_index", "track_id", "_a", "_b"))


def session_inputs(spark, sf):
    k = F.col("k")
    tracks = d.sized(d.tracks(spark, sf)).select(
        "*",
        (F.col("frame_index") / FPS).alias("ts"),
        F.when((F.col("domain") == "vehicle") & (k % 3 != 0), F.concat(F.lit("B"), (F.col("track_id") % 3).cast("string"))).alias("plate"),
        F.when(k % 23 == 0, "select")
        .when(k % 97 == 3, "remove")
        .when(k % 41 == 5, F.concat(F.lit("enroll:"), (k + 1_000_000).cast("string")))
        .alias("command"),
    )
    frames = d.frames(spark, sf).select("camera_id", "frame_index", (F.col("frame_index") / FPS).alias("ts"))
    opted = d.gallery(d.references(spark, sf)).where("recognition_enabled")
    floor = _NAMING["threshold"] - _NAMING["margin"]
    return lifecycle.session_inputs(
        tracks, track_vectors(spark, sf, tracks), frames, opted, ["camera_id"], GATES, pol.GUARD, floor
    )


# One command after another, with the targets so far as a list.
_LIFECYCLE = f"""{d.TRACKS_SQL}, c as (
  select camera_id, domain, frame_index, track_id, ['select', 'correct', 'invalidate', 'recover', 'remove', 'select'][k % 6 + 1] as command,
    k % 9 + 1 as target_id, k % 8 <> 0 as right_class, row_number() over (partition by camera_id, domain order by frame_index, track_id) as n from tracks),
walk as (
  select distinct camera_id, domain, 0::bigint as n, []::struct(id bigint, active boolean, track bigint)[] as targets, 1::bigint as next_id,
    0::bigint as lost_count, 0::bigint as recovered_count, ''::varchar as outcome, 0::bigint as held_target from c
  union all
  select camera_id, domain, n,
    case outcome when 'selected' then list_append(targets, {{'id': next_id, 'active': true, 'track': track_id}})
      when 'removed' then list_filter(targets, lambda t: t.id <> owner)
      when 'invalidated' then list_transform(targets, lambda t: case when t.id = target_id then {{'id': t.id, 'active': false, 'track': null::bigint}} else t end)
      when 'corrected' then list_transform(targets, lambda t: case when t.id = target_id then {{'id': t.id, 'active': true, 'track': track_id}} else t end)
      when 'recovered' then list_transform(targets, lambda t: case when t.id = target_id then {{'id': t.id, 'active': true, 'track': track_id}} else t end)
      else targets end,
    next_id + (outcome = 'selected')::int, lost_count + (outcome = 'invalidated')::int, recovered_count + (outcome = 'recovered')::int, outcome,
    case outcome when 'already_selected' then owner when 'selected' then next_id when 'not_selected' then -1 when 'removed' then owner else target_id end
  from (select *, case
      when command = 'select' then case when owner is not null then 'already_selected' else 'selected' end
      when command = 'remove' then case when owner is null then 'not_selected' else 'removed' end
      when wanted is null then 'unknown_target'
      when command = 'recover' and wanted.active then 'not_lost'
      when command <> 'recover' and not wanted.active then 'not_active'
      when command = 'invalidate' then 'invalidated'
      when command = 'correct' and not right_class then 'wrong_class'
      when owner is not null and owner <> target_id then 'track_occupied'
      when command = 'recover' then 'recovered' else 'corrected' end as outcome
    from (select c.*, w.targets, w.next_id, w.lost_count, w.recovered_count,
        list_filter(w.targets, lambda t: t.active and t.track = c.track_id)[1].id as owner, list_filter(w.targets, lambda t: t.id = c.target_id)[1] as wanted
      from walk w join c on c.camera_id = w.camera_id and c.domain = w.domain and c.n = w.n + 1)))"""


@query(
    "t01_target_lifecycle",
    f"with recursive {_LIFECYCLE} select camera_id, domain, frame_index, track_id, command, c.target_id, right_class, outcome, held_target, lost_count, recovered_count from walk join c using (camera_id, domain, n)",
)
def target_lifecycle(spark, sf):
    """Outcomes of a stream of target commands; the target numbers are mostly plausible."""
    k = F.col("k")
    name = F.element_at(F.array(*[F.lit(c) for c in ("select", "correct", "invalidate", "recover", "remove", "select")]), (k % 6 + 1).cast("int"))
    commands = d.tracks(spark, sf).select(
        "camera_id",
        "domain",
        "frame_index",
        "track_id",
        name.alias("command"),
        (k % 9 + 1).alias("target_id"),
        (k % 8 != 0).alias("right_class"),
    )
    return batch.lifecycle(commands, ["camera_id", "domain"], ["frame_index", "track_id"])


_TRACK_VECTORS_SQL = """e as (select vec_id, embedding, (select count(*) from embeddings) as n from embeddings),
crops as (select t.camera_id, t.domain, t.track_id, t.frame_index, t.conf >= 0.5 as accepted,
    list_transform(list_zip(a.embedding, b.embedding), lambda p: cast(cast(p[1] + p[2] * 0.4::double as float) as double)) as v
  from tracks t join e a on a.vec_id = ((cast(t.camera_id as bigint) * 7 + t.track_id * 3) % greatest(1, a.n // 8)) * 8 join e b on b.vec_id = t.k % b.n),
ordered as (select * exclude (v), list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v,
    row_number() over (partition by camera_id, domain, track_id order by frame_index) as n from crops)"""
_BANK = OPTIONS["person"]["recovery"]

# One crop after another; ``last`` is the frame of the last turn, ``refs`` the bank.
_REFERENCE_BANK = f"""{d.TRACKS_SQL}, {_TRACK_VECTORS_SQL},
bank as (
  select distinct camera_id, domain, track_id, 0::bigint as n, null::bigint as last, []::double[][] as refs, null::double[] as centroid, null::varchar as outcome, null::double as likeness from ordered
  union all
  select camera_id, domain, track_id, n, case when outcome is null then last else frame_index end,
    refs_after, case when outcome in ('started', 'accepted') then list_transform(total, lambda x: x / sqrt(list_sum(list_transform(total, lambda y: y * y)))) else centroid end, outcome, likeness
  from (select *, case when outcome in ('started', 'accepted') then list_transform(range(1, len(v) + 1), lambda i: coalesce(list_sum(list_transform(refs_after, lambda r: r[i])), 0.0) / greatest(1, len(refs_after))) end as total
    from (select *, case when outcome in ('started', 'accepted') then list_slice(list_append(refs, v), greatest(1, len(refs) + 2 - {_BANK.bank_size}), len(refs) + 1) else refs end as refs_after
      from (select *, case
          when last is null then case when accepted then 'started' end
          when frame_index - last < {_BANK.reference_interval} then null
          when not accepted then 'rejected_quality'
          when s < {_BANK.reference_update_threshold} then 'rejected_likeness' else 'accepted' end as outcome,
        case when last is null then 1.0 when accepted then s end as likeness
        from (select o.*, b.last, b.refs, b.centroid, list_sum(list_transform(list_zip(b.centroid, o.v), lambda p: p[1] * p[2])) as s
          from bank b join ordered o on o.camera_id = b.camera_id and o.domain = b.domain and o.track_id = b.track_id and o.n = b.n + 1)))))"""


@query(
    "t02_reference_bank",
    f"""with recursive {_REFERENCE_BANK} select o.camera_id, o.domain, o.track_id, o.frame_index, o.accepted, outcome, round(likeness, 6) as likeness, len(refs)::bigint as bank_size
    from bank join ordered o using (camera_id, domain, track_id, n) where outcome is not null""",
)
def reference_bank(spark, sf):
    """Runtime bank of a target that follows each track; vectors are fetched for the crops that have a turn."""
    e, keys, policy = d.table(spark, sf, "embeddings"), ["camera_id", "domain", "track_id"], OPTIONS["person"]["recovery"]
    crops = _vector_ids(e, d.tracks(spark, sf)).select(*keys, "frame_index", (F.col("conf") >= 0.5).alias("accepted"), "_a", "_b")
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    sizes = e.select("vec_id", F.when(finite, F.size("embedding")).alias("n"))
    for name in ("_a", "_b"):
        crops = crops.join(sizes.toDF(name, f"{name}_n"), name)
    crops = crops.withColumn("_able", F.col("accepted") & F.coalesce(F.col("_a_n") == F.col("_b_n"), F.lit(False)))
    turns = batch.reference_turns(crops.drop("_a_n", "_b_n"), keys, policy, starts="_able").drop("_able")
    out = batch.reference_bank(_with_vectors(e, turns), keys, policy)
    return out.drop("embedding", "stored").withColumn("likeness", F.round("likeness", 6))


# Offers one after another; the anchor (first reference) is never replaced.
_DIVERSE_BANK = f"""{d.GALLERY_SQL}, offers as (
  select identity_id, embedding_index as turn, vec_id, true as stored, embedding from refs where embedding_index < 4
  union all select identity_id - case when embedding_index % 2 = 0 then 0 else 1 end, embedding_index + 8, vec_id, false, embedding from refs),
ordered as (select identity_id, turn, vec_id, stored, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) as v,
    row_number() over (partition by identity_id order by turn, vec_id) as n from offers where identity_id >= 1),
bank as (
  select distinct identity_id, 0::bigint as n, []::double[][] as refs, null::varchar as outcome, null::bigint as slot from ordered
  union all
  select identity_id, n, case outcome when 'replaced' then list_transform(refs, lambda r, i: case when i = victim then v else r end)
      when 'unchanged' then refs else list_append(refs, v) end,
    outcome, case outcome when 'stored' then len(refs) when 'added' then len(refs) when 'replaced' then victim - 1 else -1 end
  from (select *, case when stored then 'stored' when len(refs) = 0 then 'added' when near >= 0.95 then 'unchanged' when len(refs) < 6 then 'added'
      when len(refs) = 1 or near >= worst[victim] then 'unchanged' else 'replaced' end as outcome
    from (select *, 1 + list_position(list_slice(worst, 2, len(worst)), list_max(list_slice(worst, 2, len(worst)))) as victim
      from (select o.*, b.refs, list_max(list_transform(b.refs, lambda r: list_dot_product(r, o.v))) as near,
          list_transform(b.refs, lambda r, i: list_max(list_transform(b.refs, lambda q, j: case when i = j then -2 else list_dot_product(r, q) end))) as worst
        from bank b join ordered o on o.identity_id = b.identity_id and o.n = b.n + 1))))"""


@query(
    "t06_enrichment_bank",
    f"""with recursive {_DIVERSE_BANK} select o.identity_id, o.turn, o.vec_id, o.stored, outcome, slot, len(refs)::bigint as bank_size
    from bank join ordered o using (identity_id, n) where outcome is not null""",
)
def enrichment_bank(spark, sf):
    """Half of every bank is stored, all vectors of the table are then offered to it."""
    refs = d.references(spark, sf)
    i = F.col("embedding_index")
    stored = refs.where(i < 4).withColumn("stored", F.lit(True)).withColumn("turn", i)
    shifted = F.col("identity_id") - F.when(i % 2 == 0, 0).otherwise(1)
    offered = refs.withColumn("identity_id", shifted).withColumn("stored", F.lit(False)).withColumn("turn", i + 8)
    both = stored.unionByName(offered).where(F.col("identity_id") >= 1)
    offers = both.select("identity_id", "turn", "vec_id", "stored", "embedding")
    policy = replace(pol.ENRICHMENT, bank_size=6, duplicate_threshold=0.95)
    return batch.diverse_bank(offers, ["identity_id"], ["turn", "vec_id"], policy).drop("embedding")


# The pairs of a frame one after another, with the numbers already used.
_GREEDY = f"""{_PAIRS}, o as (select camera_id, frame_index, a_idx, b_idx, row_number() over (partition by camera_id, frame_index order by iou desc, a_idx desc, b_idx desc) as n
    from pq where iou >= {pol.DUMP.match_iou}),
walk as (select camera_id, frame_index, n, a_idx, b_idx, [a_idx] as ua, [b_idx] as ub, true as kept from o where n = 1
  union all
  select o.camera_id, o.frame_index, o.n, o.a_idx, o.b_idx,
    case when list_contains(ua, o.a_idx) or list_contains(ub, o.b_idx) then ua else list_append(ua, o.a_idx) end,
    case when list_contains(ua, o.a_idx) or list_contains(ub, o.b_idx) then ub else list_append(ub, o.b_idx) end,
    not (list_contains(ua, o.a_idx) or list_contains(ub, o.b_idx))
  from walk join o on o.camera_id = walk.camera_id and o.frame_index = walk.frame_index and o.n = walk.n + 1)"""


@query(
    "a14_greedy_pairs",
    f"with recursive {_GREEDY} select camera_id, frame_index, a_idx, b_idx, {_REASON_SQL} from pq join (select camera_id, frame_index, a_idx, b_idx from walk where kept) using (camera_id, frame_index, a_idx, b_idx)",
)
def greedy_pairs(spark, sf):
    keys = ["camera_id", "frame_index"]
    pairs = dumps.candidate_pairs(*_two_runs(spark, sf), keys, pol.DUMP.match_iou)
    matched = batch.greedy_pairs(pairs, keys, "a_det_idx", "b_det_idx", "iou")
    return _divergence_rows(dumps.divergence(matched, pol.DUMP))


@query(
    "a16_suppression",
    f"""with recursive {IN_FRAME_SQL}, b as (select *, row_number() over (partition by frame_index, class_id order by score desc, ln, k) as n from in_frame
      where class_id in (0, 2, 5, 7) and score >= 0.6 and x2 > x1 and y2 > y1),
    walk as (select frame_index, class_id, n, ln, k, score, x1, y1, x2, y2, [{{'a': x1, 'b': y1, 'c': x2, 'd': y2}}] as kept, true as stays from b where n = 1
      union all
      select frame_index, class_id, n, ln, k, score, x1, y1, x2, y2, case when clash then kept else list_append(kept, {{'a': x1, 'b': y1, 'c': x2, 'd': y2}}) end, not clash from (
        select b.*, w.kept, len(list_filter(w.kept, lambda q: greatest(0.0, least(b.x2, q.c) - greatest(b.x1, q.a)) * greatest(0.0, least(b.y2, q.d) - greatest(b.y1, q.b))
          / ((b.x2-b.x1)*(b.y2-b.y1) + (q.c-q.a)*(q.d-q.b) - greatest(0.0, least(b.x2, q.c) - greatest(b.x1, q.a)) * greatest(0.0, least(b.y2, q.d) - greatest(b.y1, q.b))) > 0.1)) > 0 as clash
        from walk w join b on b.frame_index = w.frame_index and b.class_id = w.class_id and b.n = w.n + 1))
    select frame_index, ln, k, x1, y1, x2, y2, class_id, score from walk where stays""",
)
def suppression(spark, sf):
    boxes = valid_scores(spark, sf)
    order = [F.desc("score"), "ln", "k"]
    return batch.suppress(boxes, ["frame_index", "class_id"], order, 0.1)


_EVENTS_SQL = """lost as (select user_id, event_id, epoch(ts) as lost_since, (select min(epoch(n.ts)) from events n where n.user_id = e.user_id and n.event_type = 'click' and n.ts > e.ts) as recovered_at
    from events e where event_type = 'error'), h as (select user_id, max(epoch(ts)) as horizon from events group by 1)"""


@query(
    "t11_expired_targets",
    f"""with {_EVENTS_SQL} select user_id, event_id from lost join h using (user_id)
    where (recovered_at is null or recovered_at > lost_since + 86400) and lost_since + 86400 <= horizon""",
)
def expired_targets(spark, sf):
    ev = d.table(spark, sf, "events").withColumn("at", d.epoch_micros(F.col("ts")))
    click = F.when(F.col("event_type") == "click", F.col("at"))
    ahead = scan.next_minimum(ev, ["user_id"], "at", click, "next_click", chunk=86_400_000_000)
    lost = ahead.where(F.col("event_type") == "error").select(
        "user_id", "event_id", (F.col("at") / 1e6).alias("lost_since"), (F.col("next_click") / 1e6).alias("recovered_at")
    )
    horizon = ev.groupBy("user_id").agg((F.max("at") / 1e6).alias("horizon"))
    return lifecycle.expired_targets(lost, 86400.0, horizon, ["user_id"]).select("user_id", "event_id")


@query(
    "u07_given_clock",
    """with n as (select epoch(max(ts)) - 3 * 86400 as now from events), l as (select user_id, event_id, epoch(ts) as lost_since from events where event_type = 'error' and epoch(ts) <= (select now from n))
    select user_id, event_id, round(lost_since + 86400, 3) as expires_at from l where lost_since + 86400 <= (select now from n)""",
)
def given_clock(spark, sf):
    """What has expired at a moment of the caller's choosing: three days before the end."""
    ev = d.table(spark, sf, "events").withColumn("at", d.epoch_micros(F.col("ts")) / 1e6)
    now = ev.agg((F.max("at") - 3 * 86400).alias("horizon"))
    # One row, one number.
    clock = ev.select("user_id").distinct().withColumn("horizon", F.lit(now.first()["horizon"]))
    lost = ev.where((F.col("event_type") == "error")).select(
        "user_id", "event_id", F.col("at").alias("lost_since"), F.lit(None).cast("double").alias("recovered_at")
    )
    due = lifecycle.expired_targets(lost, 86400.0, clock, ["user_id"])
    return due.select("user_id", "event_id", F.round("expires_at", 3).alias("expires_at"))


@query(
    "t16_state_changes",
    """with s as (select user_id, event_id, case when event_type in ('error', 'signup') then 'LOST' else 'ACTIVE' end as state, case when event_type in ('error', 'signup') then null else event_id % 7 end as track_id,
        event_id % 11 as last_track_id, case when event_type = 'error' then event_id % 3 else 0 end as pending_hits from events),
    b as (select *, lag(state) over w as ps, lag(track_id) over w as pt, lag(last_track_id) over w as pl, lag(pending_hits) over w as ph from s window w as (partition by user_id order by event_id)),
    e as (select *, case when ps = 'ACTIVE' and state = 'LOST' then 'target_lost' when ps = 'LOST' and state = 'ACTIVE' then 'target_recovered' when pending_hits > 0 and pending_hits is distinct from ph then 'recovery_pending' end as event from b)
    select user_id, event_id, event, coalesce(case event when 'target_lost' then coalesce(pt, pl) when 'target_recovered' then pl end, -1) as old_track_id, coalesce(track_id, -1) as track_id, pending_hits from e where event is not null""",
)
def state_changes(spark, sf):
    e, kind = F.col("event_id"), F.col("event_type")
    lost = kind.isin("error", "signup")
    states = d.table(spark, sf, "events").select(
        "user_id",
        "event_id",
        F.when(lost, "LOST").otherwise("ACTIVE").alias("state"),
        F.when(~lost, e % 7).alias("track_id"),
        (e % 11).alias("last_track_id"),
        F.when(kind == "error", e % 3).otherwise(0).alias("pending_hits"),
    )
    out = lifecycle.state_changes(states, ["user_id"], "event_id")
    return out.withColumn("old_track_id", F.coalesce("old_track_id", F.lit(-1))).withColumn(
        "track_id", F.coalesce("track_id", F.lit(-1))
    )
