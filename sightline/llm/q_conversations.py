"""op11: conversations damaged by a rule, and repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import conversations
from sightline.llm.registry import query
from sightline.llm.texts import table

# crc32 bit by bit: a byte goes in, then -1 stands for one shift. The repair is worked out from the
# last turn to the first: v holds for each grammar state cost, audit and repaired lines.
SQL = r"""
with recursive k as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations),
h as (
  select *, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(key, ''),
      lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end)) % 20 as h from k),
d as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role,
    case h when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(generate_series(1, case when h = 3 then 2 else 1 end)) as copy
  from h where h <> 0),
o as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as p,
    not regexp_matches(text, '[^\x20\x09-\x0D]') as blank,
    not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as open from d),
q as (
  select *, not blank and row_number() over (partition by conv_id, role, text order by p) > 1 as dup,
    lag(left(role, 1)) over (partition by conv_id order by p) || left(role, 1) as pair from o),
r as materialized (
  select conv_id, p, role, text, left(role, 1) as i, blank or dup as dead, (open and not blank and not dup)::int as t, blank, dup, pair, turn from q),
n as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, sum(blank::int) as blank,
    sum(dup::int) as duplicate, sum(t) as truncated, sum((pair not in ('su', 'ua', 'au'))::int) as illegal
  from r group by conv_id),
v as (
  select conv_id, max(p) + 1 as p, [{c: 0, a: '', s: ''}, {c: 4, a: 'II', s: chr(10) || 'user:' || chr(10) || 'assistant:'},
    {c: 2, a: 'I', s: chr(10) || 'assistant:'}, {c: 0, a: '', s: ''}] as v
  from r group by conv_id
  union all
  select conv_id, p, [
    list_sort([d[1], {c: u.c + 2, a: 'I' || u.a, s: chr(10) || 'user:' || u.s}])[1],
    list_sort([d[2], {c: u.c + 2, a: 'I' || u.a, s: chr(10) || 'user:' || u.s}])[1], u,
    list_sort([d[4], {c: d[3].c + 2, a: 'I' || d[3].a, s: chr(10) || 'user:' || d[3].s}])[1]]
  from (
    select *, list_sort([d[3], {c: d[4].c + 2, a: 'I' || d[4].a, s: chr(10) || 'assistant:' || d[4].s}])[1] as u
    from (
      select conv_id, p, list_transform([1, 2, 3, 4], lambda q: list_sort(list_filter([
        {c: v[q].c + 3, a: 'D' || v[q].a, s: v[q].s},
        case when dead then null when q = 3
          then {c: v[4].c + 2 + t, a: 'R' || v[4].a, s: chr(10) || 'assistant:' || text || v[4].s}
          else {c: v[3].c + 2 + t, a: 'R' || v[3].a, s: chr(10) || 'user:' || text || v[3].s} end,
        case when dead then null
          when q = 1 and i = 's' then {c: v[2].c + t, a: 'K' || v[2].a, s: chr(10) || role || ':' || text || v[2].s}
          when q <> 3 and i = 'u' then {c: v[3].c + t, a: 'K' || v[3].a, s: chr(10) || role || ':' || text || v[3].s}
          when q = 3 and i = 'a' then {c: v[4].c + t, a: 'K' || v[4].a, s: chr(10) || role || ':' || text || v[4].s} end],
        lambda x: x is not null))[1]) as d
      from (select r.*, v.v from v join r on r.conv_id is not distinct from v.conv_id and r.p = v.p - 1)))),
e as (select conv_id, v[1] as b from v where p = 1)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(b.c, 0)::bigint as cost,
  coalesce(b.a, '') as audit, sha256(coalesce(substr(b.s, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join n on n.conv_id is not distinct from c.conv_id left join e on e.conv_id is not distinct from c.conv_id
"""


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with the faults that crc32 of ``conv_id:turn`` picks; a null is one space."""

    def whole(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    pick = F.crc32(F.concat(whole("conv_id"), F.lit(":"), whole("turn")).cast("binary")) % 20
    given = turns.select("conv_id", "turn", whole("role").alias("role"), whole("text").alias("text"), pick.alias("pick"))
    cut = F.when(F.col("pick") == 1, "").when(F.col("pick") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("pick") == 3, 2).otherwise(1)))
    return given.where("pick <> 0").select(
        "conv_id", "turn", F.when(F.col("pick") == 4, "user").otherwise(F.col("role")).alias("role"), cut.alias("text"), copies.alias("copy")
    )


@query("op11_conversations", SQL)
def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = conversations.repair(damaged(turns))
    digest = conversations.digests(found.turns).toDF("conv_", "repaired")
    ids = turns.select("conv_id").distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return (
        ids.join(found.report, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
        .join(digest, F.col("conv_id").eqNullSafe(F.col("conv_")), "left")
        .select(
            "conv_id",
            *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts),
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
        )
    )
