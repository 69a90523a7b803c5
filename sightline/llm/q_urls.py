"""op8: verdict on every page's url by five rules and the path templates of its host."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import urls
from sightline.llm.registry import query
from sightline.llm.texts import table

RULES = [
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]


def _sql() -> str:
    fits = [
        f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then "
        for r in sorted(RULES, key=lambda r: -len(r.name))
    ]
    ordered = sorted(RULES, key=lambda r: -len(r.name))
    rule = " ".join(f + f"'{r.name}'" for f, r in zip(fits, ordered))
    verdict = " ".join(f + f"'{r.verdict}'" for f, r in zip(fits, ordered))
    a, depth = urls.SMOOTHING, urls.DEPTH
    sql = rf"""
with u as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages)),
v as materialized (
  select *, case {rule} end as rule, case {verdict} end as fixed,
    list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s:
      regexp_replace(regexp_replace(s, '[0-9a-fA-F-]{{16,}}', '{{h}}', 'g'), '[0-9]+', '{{n}}', 'g')) as w
  from u),
x as materialized (
  select *, case when len(w) > {depth} then list_concat(w[1:{depth - 1}], ['**']) else w end as g from v),
e as (
  select host, g, unnest(generate_series(0, len(g))) as d, (fixed is not null)::int as l, (fixed is not distinct from 'block')::int as b from x),
n as materialized (
  select host, d, array_to_string(g[1:d], '/') as prefix, array_to_string(g[1:greatest(d - 1, 0)], '/') as parent,
    case when d > 0 then g[d] else '' end as seg, sum(l)::bigint as l, sum(b)::bigint as b
  from e group by all),
t0 as materialized (
  select host, prefix, '' as template, (b + {a}::double * ((select sum(b) + 1 from n where d = 0)::double / (select sum(l) + 2 from n where d = 0))) / (l + {a}::double) as blocked
  from n where d = 0)
"""
    for d in range(1, depth + 1):
        sql += rf""",
r{d} as materialized (
  select n.host, n.prefix, t.template as base, t.blocked as p, n.seg, n.l, n.b
  from n join t{d - 1} t on n.host = t.host and n.parent = t.prefix where n.d = {d}),
c{d} as (select host, base, seg, sum(l)::bigint as l, sum(b)::bigint as b, any_value(p) as p from r{d} group by all),
s{d} as (select *, sum(l) over (partition by host, base)::bigint as all_l, sum(b) over (partition by host, base)::bigint as all_b from c{d}),
j{d} as materialized (
  select *, case when l > 0 and l < all_l and all_b > 0 and all_b < all_l
    and all_l * pow(b::double * (all_l - l - all_b + b) - (l - b)::double * (all_b - b), 2)
      > {urls.CHI_SQUARE}::double * l * (all_l - l) * all_b::double * (all_l - all_b) then seg else '*' end as shown from s{d}),
m{d} as (
  select host, base, shown, concat_ws('/', base, shown) as template, (sum(b) + {a}::double * any_value(p)) / (sum(l) + {a}::double) as blocked
  from j{d} group by host, base, shown),
t{d} as materialized (
  select r.host, r.prefix, m.template, m.blocked
  from r{d} r join j{d} j using (host, base, seg) join m{d} m on m.host = j.host and m.base = j.base and m.shown = j.shown)"""
    every = " union all ".join(f"select * from t{d}" for d in range(depth + 1))
    return sql + f"""
select x.page_id, x.host, x.path, x.rule, t.template,
  coalesce(x.fixed, case when t.blocked > 0.5 then 'block' else 'allow' end) as verdict
from x join ({every}) t on x.host = t.host and array_to_string(x.g, '/') = t.prefix
"""


@query("op8_urls", _sql())
def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    names = ("host", "path", "rule", "template", "verdict")
    return found.select("page_id", *(F.col("filter")[n].alias(n) for n in names))
