import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sightline.llm import mixing

SCHEMA = "doc_id long, text string, source string, block int, size string, shard int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", 2) for i, t, s in rows], SCHEMA)


def corpus():
    rows = []
    for s, (source, n) in enumerate([("a", 400), ("b", 60), ("c", 30), ("é", 10), (None, 90)]):
        rows += [(1000 * s + i, "w " * (1 + (7 * i + s) % 23), source) for i in range(n)]
    return rows + [(9000, None, "a"), (9001, "", "b"), (9002, " \n", "zero"), (9003, None, "zero"), (None, "x y", "c")]


def targets(sizes):
    """Shared again and again until no source is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 2 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in above}


def test_targets_and_taken(spark):
    rows = corpus()
    found = mixing.draw(documents(spark, rows)).select("doc_id", "text", "source", "mix.*").collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for r in found:
        assert r["size"] == len((r.text or "").split())
        sizes[r.source] += r["size"]
    want, taken = targets(sizes), Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r["size"] * len(r.shards)
        taken[r.source] += r.taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= 23, source


def test_reruns_agree_and_mix_holds_the_copies(spark):
    docs = documents(spark, corpus())
    first = mixing.draw(docs).select("doc_id", "mix.taken", "mix.shards")
    again = mixing.draw(docs.repartition(7)).select("doc_id", "mix.taken", "mix.shards")
    rows = lambda f: sorted(map(str, f.collect()))
    assert rows(first) == rows(again)
    out = mixing.mix(docs, shards=5)
    assert out.columns == [*docs.columns, "_shard"]
    per_doc = Counter(r.doc_id for r in out.collect())
    assert all(per_doc[r.doc_id] == len(r.shards) for r in first.collect())


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, [(1, "a b c", "s")] * 40 + [(2, "d", None)])
    found = mixing.draw(docs).collect()
    assert len(found) == 41 and abs(sum(r.mix.taken for r in found) - 1.5 * 121) <= 4
    assert mixing.draw(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_hypergeometric_draws(spark):
    total, marked, drawn, n = 60, 25, 20, 20_000
    uniform = "(shiftrightunsigned(xxhash64(id), 11) / 9007199254740992D)"
    sql = mixing.hypergeometric(str(total), str(marked), str(drawn), uniform)
    found = {r.x: r["count"] / n for r in spark.range(n).select(F.expr(sql).alias("x")).groupBy("x").count().collect()}
    for x in range(drawn + 1):
        p = math.comb(marked, x) * math.comb(total - marked, drawn - x) / math.comb(total, drawn)
        assert abs(found.get(x, 0) - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4
    for t, k, d, x in [(10, 0, 5, 0), (10, 10, 5, 5), (0, 0, 0, 0), (5, 3, 5, 3), (5, 3, 0, 0)]:
        assert spark.range(3).select(F.expr(mixing.hypergeometric(str(t), str(k), str(d), "id / 3D"))).distinct().first()[0] == x


@pytest.mark.parametrize("shards", [1, 2, 7, 16])
def test_tree_quotas_are_exact(spark, shards):
    blocks = {i: 10 * i + 3 for i in range(9)}
    quotas = spark.createDataFrame(list(blocks.items()), "place int, blocks long")
    upto = defaultdict(dict)
    for r in mixing.split(quotas, shards, 1).collect():
        upto[r.place][r.shard] = r.upto
    per_shard = Counter()
    for place, cuts in upto.items():
        assert sorted(cuts) == list(range(shards)) and cuts[shards - 1] == blocks[place]
        steps = [cuts[0]] + [cuts[s] - cuts[s - 1] for s in range(1, shards)]
        assert min(steps) >= 0
        for s, k in enumerate(steps):
            per_shard[s] += k
    assert max(per_shard.values()) - min(per_shard.values()) <= math.ceil(math.log2(shards)) if shards > 1 else True
