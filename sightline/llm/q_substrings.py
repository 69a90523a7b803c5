"""op7: repeats of 20 words cut out of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import substrings
from sightline.llm.registry import query
from sightline.llm.texts import table

SQL = r"""
with d as materialized (
  select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
o as materialized (
  select doc_id, p, md5(array_to_string(list_slice(w, p, p + 19), ' ')) as gram
  from (select doc_id, w, unnest(generate_series(1, len(w) - 19)) as p from d where len(w) >= 20)),
r as (
  select doc_id, p from (select doc_id, p, row_number() over (partition by gram order by doc_id, p) as k from o) where k > 1),
g as materialized (select distinct doc_id, unnest(generate_series(p, p + 19)) as q from r),
k as (
  select d.doc_id, string_agg(x.word, ' ' order by x.q) as kept, count(*) as n
  from d, lateral (select unnest(d.w) as word, unnest(generate_series(1, len(d.w))) as q) x
  where not exists (select 1 from g where g.doc_id = d.doc_id and g.q = x.q) group by d.doc_id)
select d.doc_id, len(d.w)::bigint as n_words, len(d.w)::bigint - coalesce(k.n, 0) as n_removed,
  sha256(coalesce(k.kept, '')) as kept_sha256
from d left join k using (doc_id)
"""


@query("op7_substrings", SQL)
def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest_only=True)
    kept = F.coalesce("kept", F.lower(F.hex("sha")))
    return found.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))
