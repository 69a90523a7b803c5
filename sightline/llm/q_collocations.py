"""op13: the strongest collocations of each language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import collocations
from sightline.llm.registry import query
from sightline.llm.texts import table

SQL = r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) as piece from documents),
w as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
t as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
g as materialized (
  select lang, m, phrase, count(*) as f from (
    select lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') as phrase
    from (select lang, w, m, unnest(generate_series(1, len(w) - m + 1)) as i
          from w, (select unnest([1, 2, 3, 4]) as m) where len(w) >= m))
  group by lang, m, phrase having count(*) >= 30),
c as materialized (
  select lang, m, phrase, f as a, string_split(phrase, ' ') as w from g where m > 1),
s as (
  select c.lang, c.phrase, c.a, k, l.f as l, r.f as r, 2000000::hugeint * c.a // (l.f + r.f) as score
  from (select lang, phrase, a, w, m, unnest(generate_series(1, m - 1)) as k from c) c
  join g l on l.lang = c.lang and l.phrase = array_to_string(list_slice(w, 1, k), ' ')
  join g r on r.lang = c.lang and r.phrase = array_to_string(list_slice(w, k + 1, c.m), ' ')),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
o as (
  select lang, array_to_string(list_slice(w, i, i + q - 1), ' ') as phrase, max(a) as f
  from (select lang, w, a, q, unnest(generate_series(1, m - q + 1)) as i
        from c, (select unnest([2, 3]) as q) where q < m) group by all),
k as (
  select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank
  from b left join o on o.lang = b.lang and o.phrase = b.phrase
  where o.f is null or 100::hugeint * o.f < 80::hugeint * a)
select k.lang, cast(rank as bigint) as rank, phrase, a, l, r, t.n, cast(score as bigint) as score
from k join t on t.lang = k.lang where rank <= 2000
"""


@query("op13_collocations", SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))
