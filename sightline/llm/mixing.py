"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

DataFrame functions only. The number of shards grows with the bytes of text, the number of
blocks of a source with the number of shards. Documents go to blocks by a digest of their id;
sizes are summed per block (combined before the shuffle), so what follows works on blocks,
however large a source's share of the rows is. Sources get targets in words by
weight, up to ``most`` times their size; the excess is shared again by weight (the level at
which the targets add up is found in closed form). A source is drawn in passes: whole passes
take every block, the last pass takes blocks in permuted order until the rest of its target
is reached; in the last block documents are taken in permuted order up to the nearest one.

The drawn blocks are dealt to shards by a binary tree over the shards: at each node the left
half's number of blocks of every source is drawn from the multivariate hypergeometric
distribution (one conditional draw per source, by inversion around the mode), so shard quotas
add up exactly to the sources' quotas. Ranks of permuted blocks then cut each source into
disjoint ranges, one per shard, and rows are shuffled inside their shard. All draws come from
digests of ids and of ``seed``: reruns agree, and a lost task is repeated identically.

Defined results: a null text has size 0; a null source is one source, the last one; sources
of size 0 have target 0, their documents are drawn as the passes say and count 0 words; rows
that repeat an id fall into one block and are drawn one by one; ids that are null are drawn
like one id; other columns keep their names, new ones give way to them.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.texts import fresh, vacant
from sightline.session import cut_lineage

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Least number of shards and of blocks of a source; bytes of a shard; blocks for each shard.
SHARDS, BLOCKS = 16, 1024
SHARD_BYTES, BLOCKS_PER_SHARD = 128 << 20, 32
WORD = r"[^\x20\x09-\x0D]+"
#: Outcomes so many standard deviations from the mode have no weight in double precision.
REACH = 12


def digest(*parts: Column | str) -> Column:
    """A number below 2**60 from the MD5 of the parts; SQL can compute it as well."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    texts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 15), 16, 10).cast("long")


def allocate(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``target`` for ``missing, source, words``: one row per source."""
    order = Window.orderBy("missing", "source")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), F.pmod(F.col("place"), F.lit(len(weights))).cast("int") + 1)
    out = sources.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", weight.cast("double"))
    cap = (F.col("words") * most).cast("double")
    by_ratio = Window.orderBy(cap / F.col("weight"), "place")
    everywhere = Window.partitionBy()
    before = F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("words").over(everywhere) * F.lit(share)
    out = out.withColumn("level", (total - before) / after)
    level = F.max("level").over(everywhere)
    return out.withColumn("target", F.least(cap, F.col("weight") * level)).drop("level")


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def hypergeometric(total: str, marked: str, drawn: str, uniform: str) -> str:
    """SQL for the number of marked among ``drawn`` of ``total`` without replacement.

    Weights relative to the mode follow from ratios of neighbouring probabilities. Outcomes are
    walked from the mode upwards and then downwards; any fixed order will do for inversion.
    """
    up = "(p.k - (x - 1)) * (p.n - (x - 1)) / (x * (p.t - p.k - p.n + x))"
    down = "(x + 1) * (p.t - p.k - p.n + x + 1) / ((p.k - x) * (p.n - x))"
    above = "if(q.top > q.mode, sequence(q.mode + 1, q.top), cast(array() as array<bigint>))"
    below = "if(q.bottom < q.mode, sequence(q.mode - 1, q.bottom), cast(array() as array<bigint>))"

    def mass(values: str, ratio: str) -> str:
        return (
            f"aggregate({values}, struct(1D as w, 0D as z), (a, x) -> struct(a.w * {ratio} as w, a.z + a.w * {ratio} as z)).z"
        )

    def walk(values: str, ratio: str, left: str, pick: str) -> str:
        w = f"a.w * {ratio}"
        return (
            f"aggregate({values}, struct(1D as w, {left} as l, {pick} as v), (a, x) -> struct({w} as w, a.l - {w} as l, "
            f"coalesce(a.v, if(a.l - {w} <= 0, x, cast(null as bigint))) as v))"
        )

    start = _let(
        "l", f"p.u * (1D + {mass(above, up)} + {mass(below, down)}) - 1D",
        _let("h", walk(above, up, "l", "if(l <= 0, q.mode, cast(null as bigint))"),
             f"coalesce({walk(below, down, 'h.l', 'h.v')}.v, q.mode)"),
    )
    mode = "least(least(p.n, p.k), greatest(greatest(0L, p.n - (p.t - p.k)), cast(floor((p.n + 1D) * (p.k + 1D) / (p.t + 2D)) as bigint)))"
    spread = f"cast(ceil({REACH} * sqrt(p.n * 1D * p.k / greatest(p.t, 1L) * (p.t - p.k) / greatest(p.t, 1L) * (p.t - p.n) / greatest(p.t - 1, 1L))) + {REACH} as bigint)"
    bounds = (
        f"struct({mode} as mode, least(least(p.n, p.k), {mode} + {spread}) as top, "
        f"greatest(greatest(0L, p.n - (p.t - p.k)), {mode} - {spread}) as bottom)"
    )
    point = f"struct(cast({total} as bigint) as t, cast({marked} as bigint) as k, cast({drawn} as bigint) as n, {uniform} as u)"
    return _let("p", point, _let("q", bounds, start))


def split(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``place, shard, upto``: each source's blocks, cut for the shards by the splitting tree.

    ``quotas`` has a row per source: ``place`` (0, 1, ...) and ``blocks``. ``upto`` is the
    number of the source's blocks that go to this shard or an earlier one.
    """
    all_of = F.sort_array(F.collect_list(F.struct("place", "blocks")))
    nodes = quotas.agg(F.transform(all_of, lambda x: x["blocks"].cast("long")).alias("quotas"))
    nodes = nodes.select(F.lit(0).alias("first"), F.lit(shards).alias("shards"), "quotas")
    uniform = f"(shiftrightunsigned(xxhash64({int(seed)}, first, shards, e.i), 11) / 9007199254740992D)"
    x = hypergeometric("s.rest", "e.k", "s.room", uniform)
    total = "aggregate(quotas, 0L, (a, k) -> a + k)"
    room = f"cast(round({total} * (shards div 2) / shards) as bigint)"
    fold = (
        f"aggregate(transform(quotas, (k, i) -> struct(k, i)), "
        f"struct({total} as rest, {room} as room, cast(array() as array<bigint>) as taken), (s, e) -> "
        + _let("x", x, "struct(s.rest - e.k as rest, s.room - x as room, array_append(s.taken, x) as taken)")
        + ").taken"
    )
    for _ in range(ceil(log2(shards)) if shards > 1 else 0):
        left = nodes.withColumn("taken", F.expr(f"if(shards > 1, {fold}, quotas)"))
        nodes = left.select(
            F.explode(
                F.expr(
                    "if(shards > 1, array(named_struct('first', first, 'shards', cast(shards div 2 as int), 'quotas', taken), "
                    "named_struct('first', cast(first + shards div 2 as int), 'shards', cast(shards - shards div 2 as int), "
                    "'quotas', zip_with(quotas, taken, (k, x) -> k - x))), array(named_struct('first', first, 'shards', shards, 'quotas', quotas)))"
                )
            ).alias("n")
        ).select("n.*")
        nodes = cut_lineage(nodes)
    leaves = nodes.select(F.col("first").alias("shard"), F.posexplode("quotas").alias("place", "blocks"))
    upto = F.sum("blocks").over(Window.partitionBy("place").orderBy("shard"))
    return leaves.select("place", "shard", upto.alias("upto"))


def draw(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    shards: int | None = None,
    seed: int = 1,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    result: str = "mix",
) -> DataFrame:
    """Every row of ``docs`` with a struct column: ``size, source_size, target, taken, shards``.

    ``shards`` lists the shard of each copy that the mix takes; ``taken`` is its words.
    """
    shards = shards or _shards(docs, text, share)
    n_blocks = max(BLOCKS, BLOCKS_PER_SHARD * shards)
    names = {n: fresh(docs.columns, n) for n in ("missing", "source_key", "words", "block", "rank", "running", "plan")}
    missing, key, words, block, rank, running, plan = names.values()
    rows = docs.withColumns(
        {
            missing: F.col(source).isNull(),
            key: F.coalesce(F.col(source).cast("string"), F.lit("")),
            words: F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"),
            block: F.pmod(digest("block", str(seed), F.col(doc_id)), F.lit(n_blocks)).cast("int"),
        }
    )
    summed = rows.groupBy(F.col(missing).alias("missing"), F.col(key).alias("source"), F.col(block).alias("block"))
    blocks = cut_lineage(summed.agg(F.sum(words).alias("words")))
    sources = allocate(blocks.groupBy("missing", "source").agg(F.sum("words").alias("words")), weights, share, most)
    passes = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0)
    sources = sources.withColumn("passes", passes.cast("int")).withColumnRenamed("words", "source_size")
    sources = cut_lineage(sources.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))

    permuted = Window.partitionBy("missing", "source").orderBy(digest("order", str(seed), F.col("source"), F.col("block")), "block")
    before = F.coalesce(F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    planned = blocks.join(sources.drop("weight"), ["missing", "source"]).withColumn("before", before)
    planned = planned.withColumn("draws", F.col("passes") + (F.col("before") < F.col("rest")).cast("int"))
    planned = cut_lineage(planned)
    quotas = sources.select("place", "missing", "source").join(
        planned.groupBy("missing", "source").agg(F.sum("draws").alias("blocks")), ["missing", "source"]
    )
    cuts = split(quotas, shards, seed).select("place", F.col("upto").alias("lot"), F.lit(1).alias("cut"))
    turns = planned.where("draws > 0").select(
        "place", "missing", "source", "block", F.explode(F.sequence(F.lit(0), F.col("draws") - 1)).alias("turn")
    )
    by_lot = Window.partitionBy("place").orderBy(digest("lot", str(seed), F.col("source"), F.col("block"), F.col("turn")), "block", "turn")
    turns = turns.withColumn("lot", F.row_number().over(by_lot) - 1).withColumn("cut", F.lit(0))
    # A draw's shard is the number of cuts up to its lot.
    along = Window.partitionBy("place").orderBy("lot", F.desc("cut")).rowsBetween(Window.unboundedPreceding, 0)
    dealt = turns.unionByName(cuts, allowMissingColumns=True).withColumn("shard", F.sum("cut").over(along).cast("int"))
    dealt = dealt.where("cut = 0")
    dealt = dealt.groupBy("missing", "source", "block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("turn", "shard"))), lambda t: t["shard"]).alias("shards")
    )
    none = F.array().cast("array<int>")
    facts = planned.join(dealt, ["missing", "source", "block"], "left").select(
        F.col("missing").alias(missing),
        F.col("source").alias(key),
        F.col("block").alias(block),
        F.struct("source_size", "target", "passes", "rest", "before", F.coalesce("shards", none).alias("shards")).alias(plan),
    )
    inside = Window.partitionBy(missing, key, block).orderBy(rank, words).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(rank, digest("rank", str(seed), F.col(doc_id)))
    rows = rows.withColumn(running, F.coalesce(F.sum(words).over(inside), F.lit(0)))
    rows = rows.join(cut_lineage(facts), [missing, key, block])
    p = F.col(plan)
    last = p["before"] + F.col(running) + F.col(words) / 2 <= p["rest"]
    taken = F.slice(p["shards"], 1, p["passes"] + last.cast("int"))
    mix = F.struct(
        F.col(words).alias("size"),
        p["source_size"].alias("source_size"),
        p["target"].alias("target"),
        (F.col(words) * F.size(taken)).alias("taken"),
        taken.alias("shards"),
    )
    return rows.select(*docs.columns, mix.alias(vacant(docs.columns, result)))


def _shards(docs: DataFrame, text: str, share: float) -> int:
    """Shards of about ``SHARD_BYTES`` each; one sum goes to the driver."""
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(SHARDS, ceil(share * size / SHARD_BYTES))


def mix(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: int = 1, shards: int | None = None,
    share: float = SHARE, **options,
) -> DataFrame:
    """The mix itself: a row per copy taken, with its ``shard``, in random order within shards."""
    shards = shards or _shards(docs, text, share)
    name, copy = fresh(docs.columns, "mix"), fresh(docs.columns, "copy")
    shard = fresh(docs.columns, "shard")
    drawn = draw(docs, doc_id=doc_id, text=text, seed=seed, shards=shards, share=share, result=name, **options)
    copies = drawn.select(*docs.columns, F.posexplode(F.col(name)["shards"]).alias(copy, shard))
    order = digest("place", str(seed), F.col(shard), F.col(copy), F.col(doc_id))
    return copies.repartition(shards, shard).sortWithinPartitions(shard, order).drop(copy)
