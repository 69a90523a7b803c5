"""Eligibility, matching, confirmation and bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline import policy as pol
from sightline.operators import matching, sequences, similarity
from sightline.plans import derived as d
from sightline.plans.q_vectors import MARGIN, RECOVERY_PAIRS_SQL, SUPPORT, THRESHOLD, recovery_pairs, with_support
from sightline.plans.registry import query

T, G = d.TRACKS_SQL, d.GALLERY_SQL

# Age of a track: position in its run of consecutive frames.
AGES_SQL = f"""{T}, isl as (select *, frame_index - row_number() over (partition by camera_id, domain, track_id order by frame_index) as island from tracks),
aged as (select *, row_number() over (partition by camera_id, domain, track_id, island order by frame_index) as age from isl)"""

BINDINGS_SQL = "bindings as (select domain, identity_id * 10 as target_id, identity_id from gallery where identity_id % 6 = 0)"


def aged_tracks(spark, sf):
    return sequences.track_age(d.tracks(spark, sf), ["camera_id", "domain", "track_id"])


def bindings(identities):
    return identities.where(F.col("identity_id") % 6 == 0).select(
        "domain", (F.col("identity_id") * 10).alias("target_id"), "identity_id"
    )


# Active targets own every track whose number divides its frame's seed.
@query(
    "f05_recovery_candidates",
    f"""with {AGES_SQL}, owned as (select camera_id, frame_index, track_id from tracks where k % 3 = 0)
    select camera_id, frame_index, track_id, age from aged where class_id in (2, 5, 7) and age >= {pol.VEHICLE_RECOVERY.min_age}
      and (camera_id, frame_index, track_id) not in (select camera_id, frame_index, track_id from owned)""",
)
def recovery_candidates(spark, sf):
    aged = aged_tracks(spark, sf)
    keys = ["camera_id", "frame_index", "track_id"]
    owned = d.tracks(spark, sf).where(F.col("k") % 3 == 0)
    return matching.recovery_candidates(
        aged, owned, keys, pol.VEHICLE_CLASSES, pol.VEHICLE_RECOVERY.min_age
    ).select(*keys, "age")


@query(
    "f06_recognition_candidates",
    f"""with {AGES_SQL}, e as (select *, k % 4 = 0 as cooling, frame_index < (frame_index - 5) + k % 9 as waits from aged
      where class_id in (2, 5, 7) and age >= {pol.VEHICLE_RECOGNITION.min_age} and k % 10 <> 0 and k % 7 <> 0)
    select camera_id, frame_index, count(*) filter (where not (cooling and waits)) as usable, count(*) filter (where cooling and waits) as skipped
    from e group by 1, 2""",
)
def recognition_candidates(spark, sf):
    keys = ["camera_id", "frame_index", "track_id"]
    tracks = d.tracks(spark, sf)
    aged = sequences.track_age(tracks, ["camera_id", "domain", "track_id"])
    cooling = tracks.where(F.col("k") % 4 == 0).withColumn("retry_until", F.col("frame_index") - 5 + F.col("k") % 9)
    marked, usable = matching.recognition_candidates(
        aged,
        bound=tracks.where(F.col("k") % 7 == 0),
        protected=tracks.where(F.col("k") % 10 == 0),
        cooling=cooling,
        keys=keys,
        classes=pol.VEHICLE_CLASSES,
        min_age=pol.VEHICLE_RECOGNITION.min_age,
    )
    return marked.groupBy("camera_id", "frame_index").agg(
        F.count_if(usable).alias("usable"), F.count_if(~usable).alias("skipped")
    )


@query(
    "f07_free_identities",
    f"with {G}, {BINDINGS_SQL} select domain, identity_id from gallery where recognition_enabled and identity_id not in (select identity_id from bindings)",
)
def free_identities(spark, sf):
    g = d.gallery(d.references(spark, sf))
    return matching.free_identities(g, bindings(g)).select("domain", "identity_id")


_FREE = f"""{G}, {BINDINGS_SQL}, free as (select * from gallery where recognition_enabled and identity_id not in (select identity_id from bindings)),
all_pairs as (select c.domain, c.attempt, c.track_id, c.plate, f.identity_id as target_id, f.plate_number, list_cosine_similarity(c.embedding, f.centroid) as score
  from candidates c join free f on f.domain = c.domain),
pairs as (select * from all_pairs where plate is null or plate_number is null or plate = plate_number)"""


def recognition_pairs(spark, sf, floor, every=False, domain=None):
    refs = d.references(spark, sf)
    if domain is not None:
        refs = refs.where(F.col("domain") == domain)
    g = d.gallery(refs)
    free = matching.free_identities(g, bindings(g)).select(
        "domain", F.col("identity_id").alias("target_id"), "centroid", "plate_number"
    )
    return similarity.scored_pairs(d.candidates(refs), free, ["domain"], floor, plates=True, every=every)


@query(
    "j06_identity_candidate_scores",
    f"""with {_FREE} select domain, attempt, track_id, target_id, round(score, 6) as score from pairs where score >= {THRESHOLD - MARGIN}""",
)
def identity_candidate_scores(spark, sf):
    """Every compatible pair that can still matter: at or above threshold minus margin."""
    pairs = recognition_pairs(spark, sf, THRESHOLD - MARGIN, every=True)
    return pairs.where(F.col("score") >= THRESHOLD - MARGIN).withColumn("score", F.round("score", 6))


@query(
    "j07_plate_conflicts",
    f"""with {G} select c.track_id, g.identity_id, c.plate, g.plate_number from candidates c join gallery g on g.domain = c.domain
      and g.identity_id = c.track_id // 8 + 3 where c.plate is not null and g.plate_number is not null and c.plate <> g.plate_number""",
)
def plate_conflicts(spark, sf):
    refs = d.references(spark, sf)
    cands = d.candidates(refs).withColumn("identity_id", F.floor(F.col("track_id") / 8) + 3)
    known = d.gallery(refs).select("domain", "identity_id", "plate_number")
    pairs = cands.join(known, ["domain", "identity_id"])
    return matching.plate_conflicts(pairs, "plate", "plate_number").select(
        "track_id", "identity_id", "plate", "plate_number"
    )


def _match_sql(keys: str, support: bool, tie: str) -> str:
    extra = f"and support >= {SUPPORT}" if support else ""
    source = "pairs join support using (track_id, target_id)" if support else "pairs"
    return f"""ranked as (select *,
      row_number() over (partition by {keys}, target_id order by score desc, track_id {tie}) as rk,
      lead(score) over (partition by {keys}, target_id order by score desc, track_id {tie}) as nxt,
      nth_value(score, 2) over (partition by {keys}, track_id order by score desc, target_id rows between unbounded preceding and unbounded following) as rival
      from {source}),
    ok as (select *, row_number() over (partition by {keys}, track_id order by score desc, target_id) as claim from ranked
      where rk = 1 and score >= {THRESHOLD} {extra} and (nxt is null or score - nxt >= {MARGIN}) and (rival is null or score - rival >= {MARGIN})),
    matches as (select * from ok where claim = 1)"""


_RECOVERY_MATCH = f"with {RECOVERY_PAIRS_SQL}, " + _match_sql("domain, camera_id, attempt", True, "desc")
_RKEYS = ["domain", "camera_id", "attempt"]


def _recovery(spark, sf, floor):
    refs, cands, pairs = recovery_pairs(spark, sf, floor)
    scored = with_support(refs, cands, pairs)
    return scored, matching.margin_match(scored, _RKEYS, THRESHOLD, MARGIN, SUPPORT, later_wins=True)


@query(
    "w06_recovery_matching",
    _RECOVERY_MATCH + " select domain, camera_id, attempt, target_id, track_id, round(score, 6) as score, round(support, 6) as support from matches",
)
def recovery_matching(spark, sf):
    _, matched = _recovery(spark, sf, THRESHOLD - MARGIN)
    return matched.select(
        *_RKEYS, "target_id", "track_id", F.round("score", 6).alias("score"), F.round("support", 6).alias("support")
    )


@query(
    "a20_strongest_rejected",
    _RECOVERY_MATCH
    + f""", best as (select *, row_number() over (partition by domain, camera_id, attempt, target_id order by score desc, support desc, track_id) as br
      from pairs join support using (track_id, target_id))
    select domain, camera_id, attempt, target_id, track_id, round(score, 6) as score, round(support, 6) as support,
      case when score < {THRESHOLD} then 'centroid_threshold' when support < {SUPPORT} then 'reference_support' else 'margin' end as reason
    from best anti join matches using (domain, camera_id, attempt, target_id) where br = 1""",
)
def strongest_rejected(spark, sf):
    scored, matched = _recovery(spark, sf, None)
    rejected = matching.strongest_rejected(scored, matched, _RKEYS, THRESHOLD, SUPPORT)
    return rejected.select(
        *_RKEYS, "target_id", "track_id", F.round("score", 6).alias("score"), F.round("support", 6).alias("support"), "reason"
    )


@query(
    "w07_recognition_matching",
    f"with {_FREE}, " + _match_sql("domain, attempt", False, "asc")
    + " select domain, attempt, target_id, track_id, round(score, 6) as score from matches",
)
def recognition_matching(spark, sf):
    pairs = recognition_pairs(spark, sf, THRESHOLD - MARGIN)
    matched = matching.margin_match(pairs, ["domain", "attempt"], THRESHOLD, MARGIN)
    return matched.select("domain", "attempt", "target_id", "track_id", F.round("score", 6).alias("score"))


# One core, two domains: people are recognised under stricter limits than vehicles.
_DOMAIN_LIMITS = {"person": (0.34, 0.03), "vehicle": (THRESHOLD, MARGIN)}


def _domain_case(i: int) -> str:
    return "(case domain " + " ".join(f"when '{k}' then {x[i]}" for k, x in _DOMAIN_LIMITS.items()) + " end)"


@query(
    "u05_domain_adapter",
    f"with {_FREE}, "
    + _match_sql("domain, attempt", False, "asc").replace(f">= {THRESHOLD}", f">= {_domain_case(0)}").replace(f">= {MARGIN}", f">= {_domain_case(1)}")
    + " select domain, attempt, target_id, track_id, round(score, 6) as score from matches",
)
def domain_adapter(spark, sf):
    parts = []
    for domain, (threshold, margin) in _DOMAIN_LIMITS.items():
        pairs = recognition_pairs(spark, sf, threshold - margin, domain=domain)
        parts.append(matching.margin_match(pairs, ["domain", "attempt"], threshold, margin))
    both = parts[0].unionByName(parts[1])
    return both.select("domain", "attempt", "target_id", "track_id", F.round("score", 6).alias("score"))


# A visible frame is an attempt of its track; the partner is missing when it failed.
@query(
    "w08_confirmation_hits",
    f"""with {T}, att as (select camera_id, track_id, frame_index, case when conf >= 0.5 then k % 2 else null end as partner,
        row_number() over (partition by camera_id, track_id order by frame_index) as n from tracks),
    p as (select *, lag(partner) over w as lp, lag(frame_index) over w as lf from att window w as (partition by camera_id, track_id order by n)),
    s as (select *, sum(case when partner = lp and frame_index - lf <= 3 then 0 else 1 end) over (partition by camera_id, track_id order by n) as streak from p),
    h as (select *, row_number() over (partition by camera_id, track_id, streak order by n) as pos from s where partner is not null)
    select camera_id, track_id, frame_index, partner, (pos - 1) % 2 + 1 as hit, (pos - 1) % 2 + 1 = 2 as confirmed from h""",
)
def confirmation_hits(spark, sf):
    attempts = d.tracks(spark, sf).select(
        "camera_id", "track_id", "frame_index", F.when(F.col("conf") >= 0.5, F.col("k") % 2).alias("partner")
    )
    return matching.confirmation_hits(attempts, ["camera_id", "track_id"], "partner", hits=2, max_age=3)


@query(
    "j10_owner_lookup",
    f"""with {T}, targets as (select camera_id, frame_index, track_id, k % 40 + 1 as target_id from tracks where k % 3 = 0),
    names as (select target_id, target_id % 7 as identity_id from (select distinct k % 40 + 1 as target_id from tracks) where target_id % 7 <> 0)
    select t.camera_id, t.frame_index, t.track_id, coalesce(g.target_id, -1) as target_id, coalesce(n.identity_id, -1) as identity_id
    from tracks t left join targets g using (camera_id, frame_index, track_id) left join names n on n.target_id = g.target_id""",
)
def owner_lookup(spark, sf):
    keys = ["camera_id", "frame_index", "track_id"]
    tracks = d.tracks(spark, sf)
    targets = tracks.where(F.col("k") % 3 == 0).select(*keys, (F.col("k") % 40 + 1).alias("target_id"))
    names = (
        tracks.select((F.col("k") % 40 + 1).alias("target_id"))
        .distinct()
        .withColumn("identity_id", F.col("target_id") % 7)
        .where(F.col("identity_id") != 0)
    )
    looked_up = tracks.select(*keys).join(targets, keys, "left").join(names, "target_id", "left")
    return looked_up.select(
        *keys,
        F.coalesce("target_id", F.lit(-1)).alias("target_id"),
        F.coalesce("identity_id", F.lit(-1)).alias("identity_id"),
    )


@query(
    "j11_verification_candidates",
    f"""with {T}, suspects as (select camera_id, frame_index + 1 as frame_index, track_id, camera_id || '-' || k % 5 as target_key from tracks where class_id = 0 and k % 4 = 0),
    owners as (select camera_id, frame_index, track_id, camera_id || '-' || k % 5 as owner_key from tracks where k % 3 = 0)
    select s.camera_id, s.frame_index, s.track_id, s.target_key from suspects s
      join tracks t on t.camera_id = s.camera_id and t.frame_index = s.frame_index and t.track_id = s.track_id and t.class_id = 0
    where not exists (select 1 from owners o where o.camera_id = s.camera_id and o.frame_index = s.frame_index and o.track_id = s.track_id and o.owner_key <> s.target_key)""",
)
def verification_candidates(spark, sf):
    keys = ["camera_id", "frame_index", "track_id"]
    tracks = d.tracks(spark, sf)
    label = F.concat_ws("-", "camera_id", (F.col("k") % 5).cast("string"))
    suspects = tracks.where((F.col("class_id") == 0) & (F.col("k") % 4 == 0)).select(
        "camera_id", (F.col("frame_index") + 1).alias("frame_index"), "track_id", label.alias("target_key")
    )
    owners = tracks.where(F.col("k") % 3 == 0).select(*keys, label.alias("owner_key"))
    visible = tracks.where(F.col("class_id") == 0).select(*keys)
    kept = suspects.join(visible, keys, "left_semi").alias("s")
    other = owners.alias("o")
    same = [F.col(f"s.{c}") == F.col(f"o.{c}") for c in keys]
    cond = same[0] & same[1] & same[2] & (F.col("s.target_key") != F.col("o.owner_key"))
    return kept.join(other, cond, "left_anti").select(*keys, "target_key")


@query(
    "j12_binding_outcomes",
    f"""with {G}, {BINDINGS_SQL}, req as (select domain, vec_id as request_id, identity_id + case when vec_id % 11 = 0 then 100000 else 0 end as identity_id,
        case when vec_id % 5 = 0 then identity_id * 10 when vec_id % 5 = 1 then (identity_id + 6) * 10 else 900000 + vec_id end as target_id from refs)
    select r.domain, r.request_id, r.target_id, r.identity_id, case when g.identity_id is null then 'unknown' when bt.identity_id = r.identity_id then 'idempotent'
      when bt.identity_id is not null then 'target_conflict' when bi.target_id is not null then 'identity_conflict' else 'ok' end as outcome
    from req r left join gallery g on g.domain = r.domain and g.identity_id = r.identity_id
      left join bindings bt on bt.domain = r.domain and bt.target_id = r.target_id
      left join bindings bi on bi.domain = r.domain and bi.identity_id = r.identity_id""",
)
def binding_outcomes(spark, sf):
    refs = d.references(spark, sf)
    g = d.gallery(refs)
    i, vid = F.col("identity_id"), F.col("vec_id")
    requests = refs.select(
        "domain",
        vid.alias("request_id"),
        (i + F.when(vid % 11 == 0, 100000).otherwise(0)).alias("identity_id"),
        F.when(vid % 5 == 0, i * 10).when(vid % 5 == 1, (i + 6) * 10).otherwise(vid + 900000).alias("target_id"),
    )
    return matching.binding_outcomes(requests, bindings(g), g)
