"""Identity store, event log, feeds, recordings and recorded runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sightline import policy as pol
from sightline.functions import text, vectors as v
from sightline.operators import dumps, eventlog, gallery
from sightline.plans import derived as d
from sightline.plans.q_matching import BINDINGS_SQL, bindings
from sightline.plans.q_plates import _CONFIRM, confirmed_plates, recordings
from sightline.plans.registry import query
from sightline.session import checkpoint_dir, cut_lineage, remove_folder
from sightline.sources import delta_store, dumps as dump_files, embeddings as codec

T, G, L = d.TRACKS_SQL, d.GALLERY_SQL, d.LOG_SQL


def _tables(spark, sf):
    refs = d.references(spark, sf)
    ids = d.gallery(refs)
    snaps = ids.where(F.col("identity_id") % 4 != 1).select("domain", "identity_id")
    return {"identities": ids, "references": refs.drop("vec_id"), "snapshots": snaps}


# A damaged copy of the store.
_BROKEN = f"""{G}, bids as (select domain, identity_id, case when identity_id % 8 = 5 then '  ' else label end as label, centroid from gallery where identity_id % 9 <> 0
    union all select domain, identity_id + 100000, label, list_transform(centroid, lambda x: x * case when identity_id % 3 = 0 then 1.5 else 1.0 end) from gallery where identity_id % 9 = 0),
brefs as (select domain, identity_id, embedding_index, case when vec_id % 23 = 0 then list_transform(embedding, lambda x: x * 2) when vec_id % 29 = 0 then list_slice(embedding, 1, 60) else embedding end as embedding
    from refs where not (identity_id % 10 = 4 and embedding_index = 3))"""


@query(
    "s04_store_violations",
    f"""with {_BROKEN}, f as (
      select r.domain, r.identity_id, 'orphan_reference' as reason from brefs r where r.identity_id not in (select identity_id from bids)
      union all select domain, identity_id, 'index_not_contiguous' from brefs group by 1, 2 having min(embedding_index) <> 0 or max(embedding_index) <> count(*) - 1
      union all select domain, identity_id, 'no_references' from bids where identity_id not in (select identity_id from brefs)
      union all select domain, identity_id, 'blank_label' from bids where trim(label) = ''
      union all select domain, identity_id, 'reference_dimension' from brefs where len(embedding) <> 64
      union all select domain, identity_id, 'reference_not_unit' from brefs where len(embedding) = 64 and abs(sqrt(list_sum(list_transform(embedding, lambda x: x*x))) - 1) > 0.00101
      union all select domain, identity_id, 'centroid_not_unit' from bids where abs(sqrt(list_sum(list_transform(centroid, lambda x: x*x))) - 1) > 0.00101)
    select domain, identity_id, reason, count(*) as rows from f group by 1, 2, 3""",
)
def store_violations(spark, sf):
    refs = d.references(spark, sf)
    ids = d.gallery(refs).select("domain", "identity_id", "label", "centroid")
    i, vid = F.col("identity_id"), F.col("vec_id")
    kept = ids.where(i % 9 != 0).withColumn("label", F.when(i % 8 == 5, "  ").otherwise(F.col("label")))
    # In two steps: inside a lambda the new identity_id would hide the old one.
    stretched = F.transform("centroid", lambda x: x * F.when(i % 3 == 0, 1.5).otherwise(1.0))
    moved = ids.where(i % 9 == 0).withColumn("centroid", stretched).withColumn("identity_id", i + 100000)
    wide = v.as_double(F.col("embedding"))
    broken = refs.where(~((i % 10 == 4) & (F.col("embedding_index") == 3))).withColumn(
        "embedding",
        F.when(vid % 23 == 0, F.transform(wide, lambda x: x * 2))
        .when(vid % 29 == 0, F.slice(wide, 1, 60))
        .otherwise(wide),
    )
    return gallery.store_violations(kept.unionByName(moved), broken, 64)


@query("s05_blob_round_trip", "select vec_id, 256 as bytes, true as identical from embeddings")
def blob_round_trip(spark, sf):
    e = d.table(spark, sf, "embeddings").select("vec_id", "embedding").withColumn("blob", codec.encode_blob("embedding"))
    return e.select(
        "vec_id",
        F.length("blob").alias("bytes"),
        (codec.decode_blob("blob") == F.col("embedding")).alias("identical"),
    )


@query(
    "s06_legacy_columns",
    f"with {G} select domain, identity_id, false as recognition_enabled, cast(null as varchar) as created_at, cast(null as varchar) as plate_number from gallery",
)
def legacy_columns(spark, sf):
    old = d.gallery(d.references(spark, sf)).select("domain", "identity_id", "label", "centroid")
    return gallery.with_legacy_columns(old).select(
        "domain", "identity_id", "recognition_enabled", "created_at", "plate_number"
    )


S07_SQL = f"""with {G}, nx as (select domain, max(identity_id) + 1 as n from gallery group by 1), inc as (select domain, identity_id + case when identity_id % 2 = 0 then 500000 else 0 end + case when identity_id % 3 = 0 then 600000 else 0 end as identity_id from gallery)
    select i.domain, i.identity_id, case when i.identity_id < nx.n then 'id_already_used' else 'saved' end as outcome from inc i join nx using (domain)"""


@query("s07_save_new_identities", S07_SQL)
def save_new_identities(spark, sf):
    ids = _tables(spark, sf)["identities"]
    i = F.col("identity_id")
    bump = F.when(i % 2 == 0, 500000).otherwise(0) + F.when(i % 3 == 0, 600000).otherwise(0)
    incoming = ids.withColumn("identity_id", i + bump)
    meta = ids.groupBy("domain").agg((F.max("identity_id") + 1).alias("next_id"))
    stored, refused = gallery.save_new(ids, incoming, meta)
    saved = stored.join(ids.select("domain", "identity_id"), ["domain", "identity_id"], "left_anti")
    return saved.select("domain", "identity_id", F.lit("saved").alias("outcome")).unionByName(
        refused.withColumnRenamed("reason", "outcome")
    )


S08_SQL = f"""with {G}, upd as (select * from gallery where identity_id % 4 = 2), new_refs as (select domain, identity_id, embedding_index, vec_id from refs where identity_id % 4 = 2 and embedding_index < 5),
    r as (select domain, identity_id, embedding_index, 'old' as source from refs where identity_id % 4 <> 2 union all select domain, identity_id, embedding_index, 'new' from new_refs)
    select r.domain, r.identity_id, r.embedding_index, r.source, g.label, round(case when g.identity_id % 4 = 2 then g.centroid[2] else g.centroid[1] end, 6) as first_value from r join gallery g using (domain, identity_id)"""


@query("s08_replace_features", S08_SQL)
def replace_features(spark, sf):
    t = _tables(spark, sf)
    refs = t["references"].withColumn("source", F.lit("old"))
    chosen = F.col("identity_id") % 4 == 2
    fresh_ids = t["identities"].where(chosen).withColumn("centroid", F.slice("centroid", 2, 63))
    fresh_refs = refs.where(chosen & (F.col("embedding_index") < 5)).withColumn("source", F.lit("new"))
    ids, banks = gallery.replace_features(t["identities"], refs, fresh_ids, fresh_refs)
    joined = banks.join(ids.select("domain", "identity_id", "label", "centroid"), ["domain", "identity_id"])
    return joined.select(
        "domain",
        "identity_id",
        "embedding_index",
        "source",
        "label",
        F.round(F.col("centroid")[0], 6).alias("first_value"),
    )


S09_SQL = f"""with {G}, upd as (select domain, identity_id + case when identity_id % 7 = 0 then 900000 else 0 end as identity_id, identity_id % 2 = 0 as flag from gallery where identity_id % 3 = 0)
    select g.domain, g.identity_id, coalesce(u.flag, g.recognition_enabled) as recognition_enabled, 'stored' as state from gallery g left join upd u using (domain, identity_id)
    union all select domain, identity_id, false, 'unknown' from upd where identity_id not in (select identity_id from gallery)"""


@query("s09_set_column", S09_SQL)
def set_column(spark, sf):
    ids = _tables(spark, sf)["identities"]
    i = F.col("identity_id")
    updates = ids.where(i % 3 == 0).select(
        "domain", (i + F.when(i % 7 == 0, 900000).otherwise(0)).alias("identity_id"), (i % 2 == 0).alias("recognition_enabled")
    )
    changed, unknown = gallery.set_column(ids, updates, "recognition_enabled")
    return changed.select("domain", "identity_id", "recognition_enabled", F.lit("stored").alias("state")).unionByName(
        unknown.select("domain", "identity_id", F.lit(False).alias("recognition_enabled"), F.lit("unknown").alias("state"))
    )


S10_SQL = f"""with {G}, req as (select domain, identity_id from refs where vec_id % 3 = 0 and identity_id % 5 in (1, 2) union all select 'person', 777777), gone as (select distinct domain, identity_id from req where identity_id in (select identity_id from gallery))
    select 'deleted' as part, domain, count(*) as rows from gone group by 2
    union all select 'identities', domain, count(*) from gallery where identity_id not in (select identity_id from req) group by 2
    union all select 'references', domain, count(*) from refs where identity_id not in (select identity_id from req) group by 2
    union all select 'snapshots', domain, count(*) from gallery where identity_id % 4 <> 1 and identity_id not in (select identity_id from req) group by 2"""


@query("s10_delete_cascade", S10_SQL)
def delete_cascade(spark, sf):
    tables = _tables(spark, sf)
    asked = d.references(spark, sf).where((F.col("vec_id") % 3 == 0) & (F.col("identity_id") % 5).isin(1, 2))
    unknown = spark.range(777777, 777778).select(F.lit("person").alias("domain"), F.col("id").alias("identity_id"))
    left, deleted = gallery.delete(tables, asked.select("domain", "identity_id").unionByName(unknown))
    parts = [deleted.withColumn("part", F.lit("deleted"))]
    parts += [df.select("domain", "identity_id").withColumn("part", F.lit(name)) for name, df in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("part", "domain").agg(F.count(F.lit(1)).alias("rows"))


def _changed_store(spark, sf, change, read):
    """``read`` of a store after ``change``, both through files in the shared folder, which go afterwards."""
    path = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    tables = _tables(spark, sf)
    ids = tables["identities"]
    tables["meta"] = ids.groupBy("domain").agg((F.max("identity_id") + 1).alias("next_id"))
    delta_store.create(spark, path, tables)
    found = change(path, tables)
    out = cut_lineage(read(delta_store.load(spark, path), found))
    remove_folder(spark, path)
    return out


@query("s07_stored_identities", S07_SQL)
def stored_identities(spark, sf):
    """New identities as a delta of the stored ones."""
    i = F.col("identity_id")
    bump = F.when(i % 2 == 0, 500000).otherwise(0) + F.when(i % 3 == 0, 600000).otherwise(0)

    def change(path, t):
        moved = {n: t[n].withColumn("identity_id", i + bump) for n in ("identities", "references", "snapshots")}
        return t["identities"], delta_store.add_identities(spark, path, *moved.values())

    def read(now, found):
        old, refused = found
        saved = now["identities"].join(old.select("domain", "identity_id"), ["domain", "identity_id"], "left_anti")
        saved = saved.select("domain", "identity_id", F.lit("saved").alias("outcome"))
        return saved.unionByName(refused.withColumnRenamed("reason", "outcome"))

    return _changed_store(spark, sf, change, read)


@query("s08_stored_features", S08_SQL)
def stored_features(spark, sf):
    """New centroids and banks of some identities as a delta."""
    chosen = F.col("identity_id") % 4 == 2

    def change(path, t):
        centroids = t["identities"].where(chosen).select("domain", "identity_id", F.slice("centroid", 2, 63).alias("centroid"))
        banks = t["references"].where(chosen & (F.col("embedding_index") < 5))
        delta_store.replace_features(spark, path, centroids, banks.withColumn("source", F.lit("new")))

    def read(now, _):
        ids = now["identities"].select("domain", "identity_id", "label", "centroid")
        return now["references"].join(ids, ["domain", "identity_id"]).select(
            "domain",
            "identity_id",
            "embedding_index",
            F.coalesce("source", F.lit("old")).alias("source"),
            "label",
            F.round(F.col("centroid")[0], 6).alias("first_value"),
        )

    return _changed_store(spark, sf, change, read)


@query("s09_stored_column", S09_SQL)
def stored_column(spark, sf):
    """One flag of some identities as a delta of flags."""
    i = F.col("identity_id")

    def change(path, t):
        moved = (i + F.when(i % 7 == 0, 900000).otherwise(0)).alias("identity_id")
        flags = t["identities"].where(i % 3 == 0).select("domain", moved, (i % 2 == 0).alias("recognition_enabled"))
        return delta_store.set_column(spark, path, flags, "recognition_enabled")

    def read(now, unknown):
        known = now["identities"].select("domain", "identity_id", "recognition_enabled", F.lit("stored").alias("state"))
        off = F.lit(False).alias("recognition_enabled")
        return known.unionByName(unknown.select("domain", "identity_id", off, F.lit("unknown").alias("state")))

    return _changed_store(spark, sf, change, read)


@query("s10_stored_delete", S10_SQL)
def stored_delete(spark, sf):
    """Deleted identities as tombstones."""
    asked = d.references(spark, sf).where((F.col("vec_id") % 3 == 0) & (F.col("identity_id") % 5).isin(1, 2))
    unknown = spark.range(777777, 777778).select(F.lit("person").alias("domain"), F.col("id").alias("identity_id"))

    def change(path, _):
        return delta_store.remove_identities(spark, path, asked.select("domain", "identity_id").unionByName(unknown))

    def read(now, deleted):
        out = deleted.withColumn("part", F.lit("deleted"))
        for name in ("identities", "references", "snapshots"):
            out = out.unionByName(now[name].select("domain", "identity_id").withColumn("part", F.lit(name)))
        return out.groupBy("part", "domain").agg(F.count(F.lit(1)).alias("rows"))

    return _changed_store(spark, sf, change, read)


@query(
    "s11_allocate_ids",
    f"""with {G}, nx as (select domain, greatest(max(identity_id) + 1, case when domain = 'person' then 1000 else 1 end) as n from gallery group by 1)
    select r.domain, r.vec_id, nx.n + row_number() over (partition by r.domain order by r.vec_id) - 1 as identity_id from refs r join nx using (domain)""",
)
def allocate_ids(spark, sf):
    refs = d.references(spark, sf)
    ids = refs.select("domain", "identity_id").distinct()
    meta = ids.select("domain").distinct().withColumn(
        "next_id", F.when(F.col("domain") == "person", 1000).otherwise(1).cast("bigint")
    )
    nxt = gallery.next_ids(ids, meta)
    return gallery.allocate(refs.select("domain", "vec_id"), nxt, "vec_id").select("domain", "vec_id", "identity_id")


@query(
    "s12_log_append",
    f"""with {L} select event_id, coalesce(case when event_type in ('recognition', 'recovery') then 'stored' end, 'event_type') as outcome from log_in""",
)
def log_append(spark, sf):
    good, bad = eventlog.validate(d.log_events(spark, sf))
    return good.select("event_id", F.lit("stored").alias("outcome")).unionByName(
        bad.select("event_id", F.col("reason").alias("outcome"))
    )


def _log(spark, sf):
    good, _ = eventlog.validate(d.log_events(spark, sf))
    return good.withColumn("display_id", text.display_id(F.col("domain"), F.col("identity_id")))


_LOG_COLS = "event_id, event_time, domain, identity_id, event_type, similarity, track_id, source_label, plate_number"


@query("s13_bounded_log", f"with {L} select {_LOG_COLS} from log_ok order by event_id desc limit {pol.MAX_LOG_EVENTS}")
def bounded_log(spark, sf):
    return eventlog.newest(_log(spark, sf), pol.MAX_LOG_EVENTS).select(*_LOG_COLS.split(", "))


@query("s14_ordered_log", f"with {L} select {_LOG_COLS} from log_ok order by event_id")
def ordered_log(spark, sf):
    return eventlog.oldest_first(_log(spark, sf)).select(*_LOG_COLS.split(", "))


@query(
    "s15_log_export",
    f"""with {L} select event_id, event_time, case domain when 'person' then '人员' else '车辆' end as domain_word,
      case domain when 'person' then 'P' else 'V' end || lpad(cast(identity_id as varchar), cast(greatest(3, length(cast(identity_id as varchar))) as integer), '0') as display_id,
      case event_type when 'recognition' then '识别' else '恢复' end as event_word, case when domain = 'person' then '—' else coalesce(plate_number, 'NULL') end as plate,
      printf('%.4f', similarity) as similarity, coalesce(source_label, '—') as source from log_ok""",
)
def log_export(spark, sf):
    return eventlog.export_rows(_log(spark, sf))


@query(
    "s16_gallery_listing",
    f"""with {G}, n as (select domain, identity_id, count(*) as ref_count from refs group by 1, 2)
    select domain, identity_id, case domain when 'person' then 'P' else 'V' end || lpad(cast(identity_id as varchar), cast(greatest(3, length(cast(identity_id as varchar))) as integer), '0') as display_id,
      identity_id % 4 <> 1 as has_snapshot, ref_count, plate_number, recognition_enabled, created_at from gallery join n using (domain, identity_id) order by 1, 2""",
)
def gallery_listing(spark, sf):
    t = _tables(spark, sf)
    return gallery.listing(t["identities"], t["references"], t["snapshots"])


@query(
    "s20_named_export_check",
    """with n as (select 'v' || case when vec_id % 50 = 1 then vec_id - 1 else vec_id end as name, case when vec_id % 37 = 0 then 2.0 else 1.0 end as f, vec_id from embeddings),
    c as (select name, count(*) as copies from n group by 1)
    select name, case when copies > 1 then 'duplicate_name' else 'not_unit' end as reason from n join c using (name) where copies > 1 or f = 2.0""",
)
def named_export_check(spark, sf):
    i = F.col("vec_id")
    named = d.table(spark, sf, "embeddings").select(
        F.concat(F.lit("v"), F.when(i % 50 == 1, i - 1).otherwise(i).cast("string")).alias("name"),
        F.transform("embedding", lambda x: x * F.when(i % 37 == 0, 2.0).otherwise(1.0).cast("float")).alias("embedding"),
    )
    return codec.check_named(named, 64)[1]


@query("o01_identity_order", f"with {G} select domain, identity_id, label from gallery order by domain, identity_id")
def identity_order(spark, sf):
    return d.gallery(d.references(spark, sf)).select("domain", "identity_id", "label").orderBy("domain", "identity_id")


@query(
    "o02_activity_feed",
    f"""with {L}, f as (select event_id, display.d as display_id, event_type, event_id % 3 = 0 as acknowledged from log_ok,
        lateral (select case log_ok.domain when 'person' then 'P' else 'V' end || lpad(cast(log_ok.identity_id as varchar), cast(greatest(3, length(cast(log_ok.identity_id as varchar))) as integer), '0') as d) display
        order by event_id desc limit {pol.MAX_FEED_EVENTS})
    select *, (select count(*) from f where not acknowledged) as unacknowledged from f""",
)
def activity_feed(spark, sf):
    log = _log(spark, sf).select(
        "event_id", "display_id", "event_type", (F.col("event_id") % 3 == 0).alias("acknowledged")
    )
    return eventlog.feed(log, pol.MAX_FEED_EVENTS)


@query(
    "o03_recording_retention",
    """with n as (select event_id, user_id as folder, case event_id % 5 when 0 then strftime(ts, '%Y-%m-%d_%H-%M-%S') || '.mp4' when 1 then strftime(ts, '%Y-%m-%d_%H-%M-%S') || '_' || (event_id % 13) || '.mp4'
        when 2 then '2024-13-01_00-00-00.mp4' when 3 then 'clip_' || event_id || '.mp4' else strftime(ts, '%Y-%m-%d_%H-%M-%S') || '.avi' end as name from events),
    m as (select *, case when event_id % 5 = 1 then event_id % 13 else 0 end as suffix from n where event_id % 5 in (0, 1)),
    r as (select *, row_number() over (partition by folder order by substr(name, 1, 19) desc, suffix desc, name desc) as rn from m)
    select event_id, folder, name from r where rn > 6""",
)
def recording_retention(spark, sf):
    return eventlog.retention(recordings(spark, sf), 6, ["folder"]).select("event_id", "folder", "name")


@query(
    "t13_one_embedding_per_frame",
    f"""with {G}, asks as (select camera_id, domain, attempt as frame_index, track_id, c.who from candidates, (values ('recovery'), ('recognition'), ('guard')) c(who) where (c.who <> 'guard' or domain = 'person')),
    made as (select camera_id, domain, attempt as frame_index, track_id, embedding from candidates
      union all select camera_id, domain, attempt, track_id, list_transform(embedding, lambda x: x * 2) from candidates where track_id % 3 = 0
      union all select camera_id, domain, attempt + 1, track_id, embedding from candidates),
    one as (select camera_id, domain, frame_index, track_id, min(embedding) as e from made group by 1, 2, 3, 4)
    select camera_id, domain, frame_index, track_id, count(*) as consumers, count(distinct e) as vectors, round(min(sqrt(list_dot_product(e, e))), 6) as norm
    from asks join one using (camera_id, domain, frame_index, track_id) group by 1, 2, 3, 4""",
)
def one_embedding_per_frame(spark, sf):
    """Consumers of a crop share its one embedding; some crops were embedded twice."""
    keys = ["camera_id", "domain", "frame_index", "track_id"]
    cands = d.candidates(d.references(spark, sf)).withColumnRenamed("attempt", "frame_index")
    own = cands.select(*keys, v.as_double(F.col("embedding")).alias("embedding"))
    twice = own.where(F.col("track_id") % 3 == 0).withColumn("embedding", F.transform("embedding", lambda x: x * 2))
    later = own.withColumn("frame_index", F.col("frame_index") + 1)
    who = F.when(F.col("domain") == "person", F.array(F.lit("recovery"), F.lit("recognition"), F.lit("guard"))).otherwise(
        F.array(F.lit("recovery"), F.lit("recognition"))
    )
    asks = cands.select(*keys, F.explode(who).alias("who"))
    served = gallery.share_embeddings(asks, own.unionByName(twice).unionByName(later), keys)
    return served.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("consumers"),
        F.countDistinct("embedding").alias("vectors"),
        F.round(F.min(v.norm(F.col("embedding"))), 6).alias("norm"),
    )


@query(
    "t14_match_events",
    f"""with {G}, {BINDINGS_SQL}, {_CONFIRM}, latest as (select camera_id, domain, track_id, max_by(plate, frame_index) as plate from confirmed group by 1, 2, 3),
    m as (select domain, identity_id * 10 as target_id, cast(vec_id % 3 as varchar) as camera_id, vec_id % 50 as track_id, vec_id as frame_index, round(embedding[1], 6) as score, 'cam' || (vec_id % 4) as source_label from refs)
    select m.domain, b.identity_id, case m.domain when 'person' then 'P' else 'V' end || lpad(cast(b.identity_id as varchar), cast(greatest(3, length(cast(b.identity_id as varchar))) as integer), '0') as display_id,
      'recovery' as event_type, m.score as similarity, m.track_id, m.frame_index, m.source_label, case when m.domain = 'vehicle' then c.plate end as plate_number, true as requires_attention
    from m join bindings b on b.domain = m.domain and b.target_id = m.target_id left join latest c on c.camera_id = m.camera_id and c.domain = m.domain and c.track_id = m.track_id""",
)
def match_events(spark, sf):
    refs = d.references(spark, sf)
    vid = F.col("vec_id")
    matches = refs.select(
        "domain",
        (F.col("identity_id") * 10).alias("target_id"),
        (vid % 3).cast("string").alias("camera_id"),
        (vid % 50).alias("track_id"),
        vid.alias("frame_index"),
        F.round(v.as_double(F.col("embedding"))[0], 6).alias("score"),
        F.concat(F.lit("cam"), (vid % 4).cast("string")).alias("source_label"),
    )
    confirmed = confirmed_plates(spark, sf)
    latest = confirmed.groupBy(*d.TRACK).agg(F.max_by("plate", "frame_index").alias("plate"))
    return eventlog.match_events(matches, bindings(d.gallery(refs)), latest, "recovery")


@query(
    "t15_enrollment",
    f"""with {G}, {BINDINGS_SQL}, req as (select domain, vec_id as request_id, case when vec_id % 4 <> 3 then identity_id * 10 end as target_id, 20 + vec_id % 60 as w, 60 + vec_id % 90 as h from refs),
    nx as (select domain, max(identity_id) + 1 as n from gallery group by 1),
    o as (select domain, target_id, min(request_id) as request_id from req where target_id is not null and target_id not in (select target_id from bindings) group by 1, 2
      union all select domain, null, request_id from req where target_id is null and w >= 40 and h >= 100),
    a as (select o.*, nx.n + row_number() over (partition by o.domain order by request_id) - 1 as identity_id from o join nx using (domain))
    select domain, identity_id, request_id, coalesce(target_id, -1) as target_id, 'Target ' || case domain when 'person' then 'P' else 'V' end || lpad(cast(identity_id as varchar), cast(greatest(3, length(cast(identity_id as varchar))) as integer), '0') as label,
      false as recognition_enabled from a""",
)
def enrollment(spark, sf):
    refs = d.references(spark, sf)
    vid = F.col("vec_id")
    requests = refs.select(
        "domain",
        vid.alias("request_id"),
        F.when(vid % 4 != 3, F.col("identity_id") * 10).alias("target_id"),
        (F.lit(20) + vid % 60).alias("crop_width"),
        (F.lit(60) + vid % 90).alias("crop_height"),
    )
    ids = d.gallery(refs)
    nxt = ids.groupBy("domain").agg((F.max("identity_id") + 1).alias("next_id"))
    q = pol.PERSON_QUALITY
    out = gallery.enroll(requests, bindings(ids), nxt, q.min_crop_width, q.min_crop_height)
    return out.withColumn("target_id", F.coalesce("target_id", F.lit(-1)))


# Recorded runs: nested and flattened again.
_DUMP_DET = f"""{T}, det2 as (select camera_id, frame_index, row_number() over (partition by camera_id, frame_index order by track_id) - 1 as det_idx, track_id, domain, class_id, x1, y1, x2, y2, conf from tracks)"""


def _numbered(tracks):
    from pyspark.sql import Window

    w = Window.partitionBy("camera_id", "frame_index").orderBy("track_id")
    return tracks.withColumn("det_idx", F.row_number().over(w) - 1)


def _records(spark, sf):
    tracks = _numbered(d.tracks(spark, sf))
    frames = d.sized(d.frames(spark, sf))
    return dump_files.nest(tracks, tracks, frames, ["camera_id", "frame_index"])


@query(
    "s01_last_record_per_frame",
    f"""with {_DUMP_DET}, n as (select camera_id, frame_index, count(*) as boxes from det2 group by 1, 2), {d.FRAMES_SQL}
    select f.camera_id, f.frame_index, cast(coalesce(n.boxes, 0) as integer) as detections, case when f.frame_index % 2 = 0 then 2 else 1 end as seq
    from frames f left join n using (camera_id, frame_index)""",
)
def last_record_per_frame(spark, sf):
    """Even frames are written twice, and a summary line closes the run."""
    records = _records(spark, sf).withColumn("type", F.lit(None).cast("string"))
    # One pass over the records: each writes its lines where it lies.
    written = F.when(F.col("frame_index") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    lines = records.withColumn("seq", F.explode(written)).select("camera_id", F.to_json(F.struct("*")).alias("value"))
    head = d.frames(spark, sf).limit(1).select(
        "camera_id", "frame_index", F.lit("summary").alias("type"), F.lit(3).alias("seq")
    )
    lines = lines.unionByName(head.select("camera_id", F.to_json(F.struct("*")).alias("value")))
    parsed = lines.select("camera_id", F.from_json("value", dump_files.RECORD + ", seq int").alias("r")).select(
        "camera_id", "r.*"
    )
    last = dump_files.last_per_frame(parsed, ["camera_id", "frame_index"], F.col("seq"))
    return last.select("camera_id", "frame_index", F.size("detections").alias("detections"), "seq")


@query(
    "s02_nested_records",
    f"""with {_DUMP_DET}, {d.FRAMES_SQL}, n as (select camera_id, frame_index, count(*) as boxes, sum((x2-x1)*(y2-y1)) as total_area, count(*) filter (where domain='person') as people, count(*) filter (where domain='vehicle') as vehicles from det2 group by 1, 2)
    select f.camera_id, f.frame_index, cast(coalesce(boxes, 0) as integer) as boxes, coalesce(total_area, 0.0) as total_area, cast(coalesce(people, 0) as integer) as people, cast(coalesce(vehicles, 0) as integer) as vehicles
    from frames f left join n using (camera_id, frame_index)""",
)
def nested_records(spark, sf):
    return _records(spark, sf).select(
        "camera_id",
        "frame_index",
        F.size("detections").alias("boxes"),
        F.aggregate(F.col("detections.area"), F.lit(0.0), lambda a, x: a + x).alias("total_area"),
        F.size("tracks.person").alias("people"),
        F.size("tracks.vehicle").alias("vehicles"),
    )


@query(
    "s03_flatten_records",
    f"with {_DUMP_DET} select camera_id, frame_index, cast(det_idx as integer) as det_idx, x1, y1, x2, y2, conf, class_id from det2",
)
def flatten_records(spark, sf):
    return dump_files.detections_of(_records(spark, sf), ["camera_id", "frame_index"])


_PAIRS = f"""{_DUMP_DET}, second as (select camera_id, frame_index, row_number() over (partition by camera_id, frame_index order by track_id) - 1 as det_idx, class_id, x1, y1, x2 + k%160 as x2, y2, conf from tracks where k%11 <> 0),
a as (select * from det2 where class_id = 0), b as (select * from second where class_id = 0),
pr as (select a.camera_id, a.frame_index, a.det_idx as a_idx, b.det_idx as b_idx, a.x1 as ax1, a.y1 as ay1, a.x2 as ax2, a.y2 as ay2, b.x1 as bx1, b.y1 as by1, b.x2 as bx2, b.y2 as by2, a.conf as ac, b.conf as bc,
  greatest(0.0, least(a.x2,b.x2)-greatest(a.x1,b.x1))*greatest(0.0, least(a.y2,b.y2)-greatest(a.y1,b.y1)) as i from a join b using (camera_id, frame_index)),
pq as (select *, i/((ax2-ax1)*(ay2-ay1)+(bx2-bx1)*(by2-by1)-i) as iou from pr)"""


def _two_runs(spark, sf):
    first = _numbered(d.tracks(spark, sf))
    return first, _numbered(d.second_run(d.tracks(spark, sf)))


@query("j04_run_pairs", f"with {_PAIRS} select camera_id, frame_index, a_idx, b_idx, iou from pq where iou >= {pol.DUMP.match_iou}")
def run_pairs(spark, sf):
    pairs = dumps.candidate_pairs(*_two_runs(spark, sf), ["camera_id", "frame_index"], pol.DUMP.match_iou)
    return pairs.select(
        "camera_id",
        "frame_index",
        F.col("a_det_idx").cast("bigint").alias("a_idx"),
        F.col("b_det_idx").cast("bigint").alias("b_idx"),
        "iou",
    )


_REASON_SQL = """round((bx2-bx1)/greatest(ax2-ax1, 1e-6), 6) as width_ratio, round((by2-by1)/greatest(ay2-ay1, 1e-6), 6) as height_ratio,
  round((bx2-bx1)*(by2-by1)/((ax2-ax1)*(ay2-ay1)), 6) as area_ratio,
  round(sqrt(((ax1+ax2)/2-(bx1+bx2)/2)*((ax1+ax2)/2-(bx1+bx2)/2)+((ay1+ay2)/2-(by1+by2)/2)*((ay1+ay2)/2-(by1+by2)/2)), 6) as center_distance,
  round(bc - ac, 6) as confidence_difference,
  concat_ws(',', case when iou < 0.8 then 'iou' end, case when (bx2-bx1)*(by2-by1)/((ax2-ax1)*(ay2-ay1)) > 1.3 then 'area_grew' when (bx2-bx1)*(by2-by1)/((ax2-ax1)*(ay2-ay1)) < 1.0/1.3 then 'area_shrank' end,
    case when sqrt(((ax1+ax2)/2-(bx1+bx2)/2)*((ax1+ax2)/2-(bx1+bx2)/2)+((ay1+ay2)/2-(by1+by2)/2)*((ay1+ay2)/2-(by1+by2)/2))/greatest(sqrt((ax2-ax1)*(ax2-ax1)+(ay2-ay1)*(ay2-ay1)), 1e-6) > 0.25 then 'center_shift' end) as reasons"""


@query(
    "a15_divergence",
    f"with {_PAIRS} select camera_id, frame_index, a_idx, b_idx, {_REASON_SQL} from pq where iou >= {pol.DUMP.match_iou}",
)
def divergence(spark, sf):
    pairs = dumps.candidate_pairs(*_two_runs(spark, sf), ["camera_id", "frame_index"], pol.DUMP.match_iou)
    return _divergence_rows(dumps.divergence(pairs, pol.DUMP))


def _divergence_rows(judged):
    return judged.select(
        "camera_id",
        "frame_index",
        F.col("a_det_idx").cast("bigint").alias("a_idx"),
        F.col("b_det_idx").cast("bigint").alias("b_idx"),
        *[
            F.round(c, 6).alias(c)
            for c in ("width_ratio", "height_ratio", "area_ratio", "center_distance", "confidence_difference")
        ],
        F.array_join("reasons", ",").alias("reasons"),
    )
