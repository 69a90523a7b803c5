"""URL filter: rules first, then a path-template tree per host with smoothed purity.

DataFrame functions only. Explicit rules decide what they fit and label it. All other urls are
judged by their path template: numbers and long hexadecimal runs in a segment become
placeholders, segments beyond ``DEPTH`` one wildcard. Per host the templates form a tree with
counts of labelled and blocked pages. From the root down, a branch keeps its own segment only
if its blocked share differs significantly from its siblings' (chi-square with one degree of
freedom); all others merge into one wildcard branch, whose subtrees merge as well. A template's
blocked share is smoothed towards its parent's, the host's towards that of all labelled pages,
and a share above one half rejects the template.

Only sums per (host, prefix) are shuffled, combined before the shuffle, so a host with a third
of all pages is no hot key there; tables that are joined on prefixes lie in the checkpoint
folder, so that adaptive execution can split a frequent prefix.

Defined results: a null url, or one without ``://``, has empty host and path and is judged
as the root of host ""; without labels every page has the prior of one half and is allowed;
repeated rows count each time; extra columns pass through ``judge`` unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.texts import fresh, vacant
from sightline.session import cut_lineage

DEPTH = 4
SMOOTHING = 5.0
#: Critical value of chi-square, one degree of freedom, 5 %.
CHI_SQUARE = 3.84
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are a chain of conditions in the plan; a longer list is an error.
MAX_RULES = 500


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules, at most {MAX_RULES}")
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def segments(path: Column, depth: int = DEPTH) -> Column:
    """Path segments with placeholders; what follows the last but one level is one wildcard."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    shaped = F.transform(
        parts, lambda s: F.regexp_replace(F.regexp_replace(s, "[0-9a-fA-F-]{16,}", "{h}"), "[0-9]+", "{n}")
    )
    cut = F.concat(F.slice(shaped, 1, depth - 1), F.array(F.lit("**")))
    return F.when(F.size(shaped) > depth, cut).otherwise(shaped)


def templates(pages: DataFrame, host: str, path: str, label: str, *, depth: int = DEPTH, smoothing: float = SMOOTHING) -> DataFrame:
    """``host, prefix, template, blocked``: every prefix, its template and smoothed share."""
    label = F.col(label).cast("long")
    urls = pages.groupBy(F.col(host).alias("host"), F.col(path).alias("path"))
    urls = urls.agg(F.count(label).alias("l"), F.coalesce(F.sum(label), F.lit(0)).alias("b"))
    urls = urls.withColumn("g", segments(F.col("path"), depth))
    nodes = urls.withColumn("d", F.explode(F.expr("sequence(0, size(g))")))
    nodes = nodes.withColumn("prefix", F.array_join(F.expr("slice(g, 1, d)"), "/"))
    nodes = nodes.withColumn("parent", F.expr("array_join(slice(g, 1, greatest(d - 1, 0)), '/')"))
    nodes = nodes.withColumn("seg", F.expr("if(d > 0, g[d - 1], '')"))
    nodes = nodes.groupBy("host", "d", "prefix", "parent", "seg").agg(F.sum("l").alias("l"), F.sum("b").alias("b"))
    nodes = cut_lineage(nodes)

    top = nodes.where("d = 0")
    # Two sums over all hosts go to the driver.
    sums = top.agg(F.sum("b").alias("b"), F.sum("l").alias("l")).first()
    prior = ((sums.b or 0) + 1) / ((sums.l or 0) + 2)
    a = F.lit(smoothing)
    share = (F.col("b") + a * F.lit(prior)) / (F.col("l") + a)
    known = cut_lineage(top.select("host", "prefix", F.lit("").alias("template"), share.alias("blocked")))
    levels = [known]
    for d in range(1, depth + 1):
        above = levels[-1].select("host", F.col("prefix").alias("parent"), F.col("template").alias("base"), F.col("blocked").alias("p"))
        rows = cut_lineage(nodes.where(F.col("d") == d).join(above, ["host", "parent"]).select("host", "prefix", "base", "p", "seg", "l", "b"))
        branches = rows.groupBy("host", "base", "seg").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.first("p").alias("p"))
        branches = cut_lineage(branches)
        sums = branches.groupBy("host", "base").agg(F.sum("l").alias("all_l"), F.sum("b").alias("all_b"))
        judged = branches.join(cut_lineage(sums), ["host", "base"])
        own = F.expr(
            f"l > 0 and l < all_l and all_b > 0 and all_b < all_l and "
            f"all_l * pow(cast(b as double) * (all_l - l - all_b + b) - cast(l - b as double) * (all_b - b), 2) > "
            f"{CHI_SQUARE}D * l * (all_l - l) * cast(all_b as double) * (all_l - all_b)"
        )
        judged = cut_lineage(judged.withColumn("shown", F.when(own, F.col("seg")).otherwise("*")))
        merged = judged.groupBy("host", "base", "shown").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.first("p").alias("p"))
        merged = merged.select(
            "host", "base", "shown",
            F.concat_ws("/", "base", "shown").alias("template"),
            ((F.col("b") + a * F.col("p")) / (F.col("l") + a)).alias("blocked"),
        )
        found = judged.select("host", "base", "seg", "shown").join(cut_lineage(merged), ["host", "base", "shown"])
        found = cut_lineage(found.select("host", "base", "seg", "template", "blocked"))
        levels.append(
            cut_lineage(rows.select("host", "base", "seg", "prefix").join(found, ["host", "base", "seg"]).select("host", "prefix", "template", "blocked"))
        )
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return cut_lineage(out)


def judge(pages: DataFrame, rules: list[Rule], *, url: str = "url", result: str = "filter", **options) -> DataFrame:
    """Every row of ``pages`` with a struct: ``host, path, rule, template, blocked, verdict``.

    Pages that a rule decides are the labelled ones.
    """
    names = {n: fresh(pages.columns, n) for n in ("h", "p", "r", "v", "y", "f")}
    h, p, r, v, y, f = names.values()
    host, path = host_and_path(F.col(url))
    rows = pages.withColumns({h: host, p: path})
    rule, verdict = matched(F.col(h), F.col(p), rules)
    rows = rows.withColumns({r: rule, v: verdict})
    rows = rows.withColumn(y, F.when(F.col(v) == "block", 1).when(F.col(v) == "allow", 0))
    tree = templates(rows.select(h, p, y), h, p, y, **options)
    tree = tree.select(F.col("host").alias(h), F.col("prefix").alias(f), F.col("template").alias("_t"), F.col("blocked").alias("_b"))
    tree = tree.withColumn(y, F.struct("_t", "_b")).drop("_t", "_b")
    rows = rows.drop(y).withColumn(f, F.array_join(segments(F.col(p), options.get("depth", DEPTH)), "/"))
    rows = rows.join(tree, [h, f])
    method = F.when(F.col(y)["_b"] > 0.5, "block").otherwise("allow")
    struct = F.struct(
        F.col(h).alias("host"), F.col(p).alias("path"), F.col(r).alias("rule"), F.col(y)["_t"].alias("template"),
        F.col(y)["_b"].alias("blocked"), F.coalesce(F.col(v), method).alias("verdict"),
    )
    return rows.select(*pages.columns, struct.alias(vacant(pages.columns, result)))
