"""op6: all documents mixed to 150 % of their words at weights 5, 2, 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import mixing
from sightline.llm.registry import query
from sightline.llm.texts import table


def _digest(*parts: str) -> str:
    return f"cast('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15) as bigint)"


# The blocks' tree decides where copies go, not which; SQL gives the latter.
SQL = rf"""
with d as materialized (
  select doc_id, source is null as missing, coalesce(source, '') as source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    {_digest("'block'", "'1'", "coalesce(cast(doc_id as varchar), '')")} % greatest({mixing.BLOCKS},
      {mixing.BLOCKS_PER_SHARD} * greatest({mixing.SHARDS}, ceil(1.5::double * (select coalesce(sum(strlen(text)), 0) from documents) / {mixing.SHARD_BYTES})::bigint)) as block,
    {_digest("'rank'", "'1'", "coalesce(cast(doc_id as varchar), '')")} as rank
  from documents),
s as (
  select missing, source, sum(size)::bigint as words,
    row_number() over (order by missing, source) - 1 as place from d group by missing, source),
w as (select *, [5.0, 2.0, 1.0][place % 3 + 1]::double as weight, (words * 2)::double as cap from s),
l as (
  select *, ((sum(words) over () * 1.5::double)
    - coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, place rows between current row and unbounded following) as level
  from w),
t as (select missing, source, words, least(cap, weight * max(level) over ()) as target from l),
p as (select *, case when words > 0 then floor(target / words) else 0 end as passes from t),
r as (select *, target - passes * words as rest from p),
b as (
  select *, coalesce(sum(words) over (partition by missing, source order by o, block
    rows between unbounded preceding and 1 preceding), 0) as before
  from (select missing, source, block, sum(size)::bigint as words,
      {_digest("'order'", "'1'", "source", "cast(block as varchar)")} as o
    from d group by missing, source, block)),
u as (
  select d.*, coalesce(sum(size) over (partition by missing, source, block order by rank, size
    rows between unbounded preceding and 1 preceding), 0) as running from d)
select u.doc_id, u.size, r.words as source_size, r.target,
  cast(u.size * (r.passes + case when b.before + u.running + u.size / 2 <= r.rest then 1 else 0 end) as bigint) as taken
from u join b using (missing, source, block) join r using (missing, source)
"""


@query("op6_mixing", SQL)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    drawn = mixing.draw(docs)
    names = ("size", "source_size", "target", "taken")
    return drawn.select("doc_id", *(F.col("mix")[n].alias(n) for n in names))
