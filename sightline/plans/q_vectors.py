"""Embeddings: validation, banks, evidence and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightline.functions import vectors as v
from sightline.operators import calibration, similarity
from sightline.plans import derived as d
from sightline.plans.registry import query

G = d.GALLERY_SQL
THRESHOLD, MARGIN, SUPPORT = 0.30, 0.02, 0.25

# Some vectors are spoilt: label 0 becomes the zero vector, every 17th starts with NaN.
_SPOILT = """spoilt as (select vec_id, label, list_transform(cast(embedding as double[]), lambda x, i:
    case when i = 1 and vec_id % 17 = 3 then cast('nan' as double) else x * label end) as e from embeddings)"""


def _spoilt(spark, sf):
    first_bad = F.col("vec_id") % 17 == 3
    values = F.transform(
        v.as_double(F.col("embedding")),
        lambda x, i: F.when((i == 0) & first_bad, F.lit(float("nan"))).otherwise(x * F.col("label")),
    )
    return d.table(spark, sf, "embeddings").select("vec_id", "label", values.alias("e"))


@query(
    "p18_l2_normalize",
    f"""with {_SPOILT}, n as (select *, sqrt(list_sum(list_transform(e, lambda x: x*x))) as norm from spoilt),
    u as (select *, not isnan(norm) and norm > 1.1920928955078125e-07 as usable from n)
    select vec_id, usable, case when usable then round(e[1]/norm, 6) end as first, case when usable then round(e[64]/norm, 6) end as last from u""",
)
def l2_normalize(spark, sf):
    unit = v.normalized(F.col("e"))
    return _spoilt(spark, sf).withColumn("u", unit).select(
        "vec_id",
        F.col("u").isNotNull().alias("usable"),
        F.round(F.element_at("u", 1), 6).alias("first"),
        F.round(F.element_at("u", 64), 6).alias("last"),
    )


@query(
    "p19_cosine",
    """with c as (select a.vec_id, cast(a.embedding as double[]) as x,
      case when a.vec_id % 13 = 5 then list_slice(cast(b.embedding as double[]), 1, 63) else cast(b.embedding as double[]) end as y
      from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
    select vec_id, case when len(x) = len(y) then round(list_cosine_similarity(x, case when len(x)=len(y) then y else x end), 6) end as cosine from c""",
)
def cosine(spark, sf):
    e = d.table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    other = F.when(F.col("vec_id") % 13 == 5, F.slice("other", 1, 63)).otherwise(F.col("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(v.cosine(F.col("embedding"), other), 6).alias("cosine"))


@query(
    "a01_centroid",
    f"with {G}, u as (select domain, identity_id, unnest(centroid) as val, unnest(range(0, 64)) as pos from gallery) "
    "select domain, identity_id, cast(pos as integer) as pos, round(val, 6) as value from u",
)
def centroid(spark, sf):
    return d.gallery(d.references(spark, sf)).select(
        "domain", "identity_id", F.posexplode("centroid").alias("pos", "value")
    ).withColumn("value", F.round("value", 6))


@query(
    "a02_top_k_support",
    f"""with {G}, s as (select c.track_id, r.identity_id, list_cosine_similarity(c.embedding, r.embedding) as s,
        row_number() over (partition by c.track_id, r.identity_id order by list_cosine_similarity(c.embedding, r.embedding) desc) as rn
      from candidates c join refs r on r.identity_id = c.track_id // 8 + 2)
    select track_id, identity_id, round(avg(s), 6) as support from s where rn <= 3 group by 1, 2""",
)
def top_k_support(spark, sf):
    refs = d.references(spark, sf)
    pairs = d.candidates(refs).select(
        "track_id", (F.floor(F.col("track_id") / 8) + 2).alias("identity_id"), "embedding"
    )
    scored = similarity.support(pairs, refs.select("identity_id", "embedding"), ["identity_id"], 3)
    return scored.withColumn("support", F.round("support", 6))


# All pairs of a candidate and a target of the same camera and domain.
RECOVERY_PAIRS_SQL = f"""{G}, pairs as (
  select c.domain, c.camera_id, c.attempt, c.track_id, g.identity_id as target_id,
    list_cosine_similarity(c.embedding, g.centroid) as score
  from candidates c join gallery g on g.domain = c.domain and (g.identity_id - 1) // 10 = c.camera_id),
support as (
  select track_id, target_id, avg(s) as support from (
    select c.track_id, r.identity_id as target_id, list_cosine_similarity(c.embedding, r.embedding) as s,
      row_number() over (partition by c.track_id, r.identity_id order by list_cosine_similarity(c.embedding, r.embedding) desc) as rn
    from candidates c join refs r on r.domain = c.domain and (r.identity_id - 1) // 10 = c.camera_id) where rn <= 3
  group by 1, 2)"""


def recovery_pairs(spark, sf, floor, later_wins=True, every=False, **blocks):
    """Scored pairs of lost targets (one per identity) and tracks of the same camera."""
    refs = d.references(spark, sf)
    targets = d.gallery(refs).select(
        "domain",
        F.floor((F.col("identity_id") - 1) / 10).alias("camera_id"),
        F.col("identity_id").alias("target_id"),
        "centroid",
    )
    cands = d.candidates(refs)
    pairs = similarity.scored_pairs(cands, targets, ["domain", "camera_id"], floor, later_wins, every=every, **blocks)
    return refs, cands, pairs


def with_support(refs, cands, pairs):
    full = pairs.join(cands.select("track_id", "embedding"), "track_id")
    bank = refs.select(F.col("identity_id").alias("target_id"), "embedding")
    return similarity.support(full, bank, ["target_id"], 3)


J05_SQL = f"""with {RECOVERY_PAIRS_SQL} select domain, camera_id, attempt, track_id, target_id, round(score, 6) as score
    from pairs where score >= {THRESHOLD - MARGIN}"""


@query("j05_target_candidate_scores", J05_SQL)
def target_candidate_scores(spark, sf):
    """Every compatible pair that can still matter: at or above threshold minus margin."""
    _, _, pairs = recovery_pairs(spark, sf, THRESHOLD - MARGIN, every=True)
    pairs = pairs.where(F.col("score") >= THRESHOLD - MARGIN)
    return pairs.select("domain", "camera_id", "attempt", "track_id", "target_id", F.round("score", 6).alias("score"))


@query("j05_indexed_candidate_scores", J05_SQL)
def indexed_candidate_scores(spark, sf):
    """The same pairs by the metric index, which serves targets that are too many to broadcast."""
    blocks = {"left_block": 64, "right_block": 32, "broadcast_bytes": -1}
    _, _, pairs = recovery_pairs(spark, sf, THRESHOLD - MARGIN, every=True, **blocks)
    pairs = pairs.where(F.col("score") >= THRESHOLD - MARGIN)
    return pairs.select("domain", "camera_id", "attempt", "track_id", "target_id", F.round("score", 6).alias("score"))


@query(
    "a03_recovery_evidence",
    f"""with {RECOVERY_PAIRS_SQL} select domain, camera_id, attempt, track_id, target_id, round(score, 6) as score, round(support, 6) as support
    from pairs join support using (track_id, target_id) where score >= {THRESHOLD}""",
)
def recovery_evidence(spark, sf):
    refs, cands, pairs = recovery_pairs(spark, sf, THRESHOLD, every=True)
    evidence = with_support(refs, cands, pairs.where(F.col("score") >= THRESHOLD))
    return evidence.select(
        "domain",
        "camera_id",
        "attempt",
        "track_id",
        "target_id",
        F.round("score", 6).alias("score"),
        F.round("support", 6).alias("support"),
    )


@query(
    "a04_bank_pairs",
    f"""with {G} select a.domain, a.identity_id, a.embedding_index as index_a, b.embedding_index as index_b,
      round(list_cosine_similarity(a.embedding, b.embedding), 6) as score
    from refs a join refs b on a.identity_id = b.identity_id and a.embedding_index < b.embedding_index""",
)
def bank_pairs(spark, sf):
    pairs = similarity.bank_pairs(d.references(spark, sf), ["domain", "identity_id"])
    return pairs.withColumn("score", F.round("score", 6))


@query(
    "a05_bank_redundancy",
    f"""with {G}, p as (select a.identity_id, a.embedding_index, max(list_cosine_similarity(a.embedding, b.embedding)) as m
      from refs a join refs b on a.identity_id = b.identity_id and a.embedding_index <> b.embedding_index group by 1, 2)
    select domain, identity_id, embedding_index, round(coalesce(m, 0.0), 6) as redundancy from refs left join p using (identity_id, embedding_index)""",
)
def bank_redundancy(spark, sf):
    r = similarity.redundancy(d.references(spark, sf), ["domain", "identity_id"])
    return r.withColumn("redundancy", F.round("redundancy", 6))


@query(
    "a06_bank_diagnostics",
    f"""with {G}, c as (select r.domain, r.identity_id, list_cosine_similarity(r.embedding, g.centroid) as s from refs r join gallery g using (domain, identity_id)),
    p as (select a.domain, a.identity_id, list_cosine_similarity(a.embedding, b.embedding) as s from refs a join refs b on a.identity_id = b.identity_id and a.embedding_index < b.embedding_index),
    cs as (select domain, identity_id, count(*) as refs, min(s) as lo, avg(s) as mid, max(s) as hi from c group by 1, 2),
    ps as (select domain, identity_id, max(s) as hi from p group by 1, 2)
    select domain, identity_id, cs.refs as ref_count, round(n, 6) as mean_norm, round(cs.lo, 6) as min_to_centroid,
      round(cs.mid, 6) as mean_to_centroid, round(cs.hi, 6) as max_to_centroid, round(coalesce(ps.hi, 0.0), 6) as max_pair
    from cs join mean_lists using (domain, identity_id) left join ps using (domain, identity_id)""",
)
def bank_diagnostics(spark, sf):
    keys = ["domain", "identity_id"]
    refs = d.references(spark, sf)
    means = refs.groupBy(*keys).agg(v.mean_vector(F.col("embedding")).alias("mean"))
    to_center = refs.join(means, keys).withColumn("s", v.cosine(F.col("embedding"), F.col("mean")))
    stats = to_center.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("ref_count"),
        F.round(F.first(v.norm(F.col("mean"))), 6).alias("mean_norm"),
        F.round(F.min("s"), 6).alias("min_to_centroid"),
        F.round(F.avg("s"), 6).alias("mean_to_centroid"),
        F.round(F.max("s"), 6).alias("max_to_centroid"),
    )
    widest = similarity.redundancy(refs, keys).groupBy(*keys).agg(F.round(F.max("redundancy"), 6).alias("max_pair"))
    return stats.join(widest, keys)


_ALL_PAIRS = """pairs as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same_label,
    list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) as score
  from embeddings a join embeddings b on a.vec_id < b.vec_id)"""


def _samples(spark, sf):
    return d.table(spark, sf, "embeddings").select(F.col("vec_id").alias("name"), "label", "embedding")


@query(
    "a07_pair_histogram",
    f"""with {_ALL_PAIRS} select same_label, cast(round(score * {calibration.FINE_CELLS}) as bigint) as cell, count(*) as pairs, round(min(score), 9) as low, round(max(score), 9) as high
      from pairs group by 1, 2""",
)
def pair_histogram(spark, sf):
    found = calibration.pair_histogram(_samples(spark, sf), cells=calibration.FINE_CELLS)
    return found.select("same_label", "cell", "pairs", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query(
    "a08_pair_distribution",
    f"""with {_ALL_PAIRS} select same_label, count(*) as n_pairs, round(min(score), 10) as min, round(quantile_cont(score, 0.1), 10) as p10,
      round(quantile_cont(score, 0.5), 10) as median, round(avg(score), 8) as mean, round(quantile_cont(score, 0.9), 10) as p90,
      round(quantile_cont(score, 0.95), 10) as p95, round(max(score), 10) as max from pairs group by 1""",
)
def pair_distribution(spark, sf):
    out = calibration.distribution(_samples(spark, sf))
    exact = [F.round(c, 10).alias(c) for c in ("min", "p10", "median", "p90", "p95", "max")]
    return out.select("same_label", "n_pairs", *exact, F.round("mean", 8).alias("mean"))


@query(
    "a09_hardest_pairs",
    f"""with {_ALL_PAIRS}, r as (select *, row_number() over (partition by same_label order by case when same_label then score else -score end, a, b) as rn from pairs)
    select case when same_label then 'hardest_positive' else 'hardest_negative' end as kind, round(score, 10) as score, a, b from r where rn = 1""",
)
def hardest_pairs(spark, sf):
    found = calibration.hardest_pairs(calibration.pair_histogram(_samples(spark, sf), extremes=False))
    return found.withColumn("score", F.round("score", 10))


@query(
    "a10_sanity_verdict",
    f"""with {G}, t as (select a.identity_id, list_cosine_similarity(a.embedding, b.embedding) as same, list_cosine_similarity(a.embedding, c.embedding) as diff
      from refs a join refs b on b.identity_id = a.identity_id and b.embedding_index = 1
        join refs c on c.identity_id = a.identity_id + 1 and c.embedding_index = 0 where a.embedding_index = 0)
    select identity_id, round(same, 6) as same_similarity, round(diff, 6) as different_similarity, same > diff as passed from t""",
)
def sanity_verdict(spark, sf):
    refs = d.references(spark, sf).select("identity_id", "embedding_index", "embedding")

    def nth(i, name, shift=0):
        return refs.where(F.col("embedding_index") == i).select(
            (F.col("identity_id") + shift).alias("identity_id"), F.col("embedding").alias(name)
        )

    triples = nth(0, "a").join(nth(1, "b"), "identity_id").join(nth(0, "c", -1), "identity_id")
    scored = triples.select(
        "identity_id",
        v.cosine(F.col("a"), F.col("b")).alias("same"),
        v.cosine(F.col("a"), F.col("c")).alias("diff"),
    )
    return scored.select(
        "identity_id",
        F.round("same", 6).alias("same_similarity"),
        F.round("diff", 6).alias("different_similarity"),
        (F.col("same") > F.col("diff")).alias("passed"),
    )


@query(
    "a25_norm_audit",
    f"""with {_SPOILT}, n as (select vec_id // 32 as batch, len(e) as dim, sqrt(list_sum(list_transform(e, lambda x: x*x))) as norm from spoilt)
    select batch, count(*) as vectors, count(distinct dim) as dims, count(*) filter (where isnan(norm)) as not_finite,
      round(min(norm) filter (where not isnan(norm)), 6) as min_norm, round(avg(norm) filter (where not isnan(norm)), 6) as mean_norm,
      round(max(norm) filter (where not isnan(norm)), 6) as max_norm,
      count(*) filter (where not isnan(norm) and abs(norm - 1) <= 0.0001) as unit_vectors from n group by 1""",
)
def norm_audit(spark, sf):
    norms = _spoilt(spark, sf).select(
        F.floor(F.col("vec_id") / 32).alias("batch"), F.size("e").alias("dim"), v.norm(F.col("e")).alias("norm")
    )
    ok = F.when(~F.isnan("norm"), F.col("norm"))
    return norms.groupBy("batch").agg(
        F.count(F.lit(1)).alias("vectors"),
        F.countDistinct("dim").alias("dims"),
        F.count_if(F.isnan("norm")).alias("not_finite"),
        F.round(F.min(ok), 6).alias("min_norm"),
        F.round(F.avg(ok), 6).alias("mean_norm"),
        F.round(F.max(ok), 6).alias("max_norm"),
        F.count_if(F.abs(ok - 1) <= 1e-4).alias("unit_vectors"),
    )


@query(
    "j09_embedding_parity",
    """with l as (select vec_id as name, label, cast(embedding as double[]) as e from embeddings where vec_id % 50 <> 7),
    r as (select vec_id as name, list_transform(cast(embedding as double[]), lambda x, i: x + case when i <= 8 then 0.002 * (vec_id % 9) else 0 end) as e
      from embeddings where vec_id % 60 <> 11),
    j as (select coalesce(l.label, -1) as label, l.name as ln, r.name as rn, case when l.name is not null and r.name is not null then list_cosine_similarity(l.e, r.e) end as s
      from l full join r on l.name = r.name)
    select label, count(s) as pairs, count(*) filter (where rn is null) as only_left, count(*) filter (where ln is null) as only_right,
      round(min(s), 6) as min_cosine, round(avg(s), 6) as mean_cosine, round(max(s), 6) as max_cosine,
      coalesce(min(s) >= 0.999, false) and count(*) = count(s) as passed from j group by 1""",
)
def embedding_parity(spark, sf):
    from sightline.sources import embeddings as src

    e = d.table(spark, sf, "embeddings")
    shifted = F.transform(
        v.as_double(F.col("embedding")),
        lambda x, i: x + F.when(i < 8, 0.002 * (F.col("vec_id") % 9)).otherwise(0.0),
    )
    left = e.where(F.col("vec_id") % 50 != 7).select(F.col("vec_id").alias("name"), "label", "embedding")
    right = e.where(F.col("vec_id") % 60 != 11).select(F.col("vec_id").alias("name"), shifted.alias("embedding"))
    return src.parity(left, right, group="label", acceptance=0.999, decimals=6)
