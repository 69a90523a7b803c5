"""op1: which documents hold windows of benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import decontaminate
from sightline.llm.registry import query
from sightline.llm.texts import table

# A document word is known by its place; windows are joined as lists of words. Items with
# fewer than 10 words, of n words, are compared with document windows of n words.
SQL = r"""
with d as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null and item_id is not null),
g as materialized (
  select distinct item_id, least(10, len(w)) as n, list_slice(w, p, p + least(10, len(w)) - 1) as gram
  from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) as p from i where len(w) > 0)),
o as materialized (
  select doc_id, p, n, list_slice(w, p, p + n - 1) as gram
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as p
        from d, (select distinct n from g) where len(w) >= n)),
m as materialized (select o.doc_id, o.p, o.n, g.item_id from o join g on o.n = g.n and o.gram = g.gram),
h as (select doc_id, count(distinct q) as n_hit
      from (select doc_id, unnest(generate_series(p, p + n - 1)) as q from m) group by doc_id),
s as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
      from (select distinct doc_id, cast(item_id as varchar) as item_id from m) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(h.n_hit, 0) as n_hit,
       coalesce(s.n_items, 0) as n_items, sha256(coalesce(s.ids, '')) as items_sha256,
       coalesce(h.n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join s using (doc_id)
"""


@query("op1_decontaminate", SQL)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    names = ("n_words", "n_hit", "n_items", "items_sha256")
    return found.select(
        "doc_id",
        *(F.col("contamination")[n].alias(n) for n in names),
        (F.col("contamination")["n_hit"] > 0).alias("contaminated"),
    )
