"""Connected components of an edge table by randomised contraction.

In each round every node points to the neighbour (or itself) with the smallest random-looking
rank of that round, and the graph is rewritten in terms of these targets; nodes that nobody
points to vanish. The expected number of nodes falls by a constant factor whatever the shape
of the graph, so long chains and big stars both take few rounds. A node's targets are minima
(combined before the shuffle), and both sides of every join are tables in the checkpoint
folder, so adaptive execution can split the rows of a hub. The driver sees one flag a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.session import cut_lineage


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root``: every node that has an edge, and one node of its component.

    ``a`` and ``b`` are long columns without nulls; loops and repeated edges do not matter.
    """
    links = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    links = cut_lineage(links)
    roots, turn = None, 0
    while not links.isEmpty():
        rank = F.xxhash64(F.lit(turn), "w")
        both = links.select(F.col("a").alias("v"), F.col("b").alias("w"))
        both = both.union(links.select("b", "a"))
        target = both.groupBy("v").agg(F.min(F.struct(rank.alias("r"), "w")).alias("best"))
        own = F.struct(F.xxhash64(F.lit(turn), "v").alias("r"), F.col("v").alias("w"))
        target = cut_lineage(target.select("v", F.least("best", own)["w"].alias("t")))
        for end in ("a", "b"):
            seen = target.select(F.col("v").alias(end), F.col("t").alias("to"))
            links = links.join(seen, end).drop(end).withColumnRenamed("to", end)
        links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
        links = cut_lineage(links.distinct())
        if roots is None:
            roots = target.select(F.col("v").alias("node"), F.col("t").alias("root"))
        else:
            step = target.select(F.col("v").alias("root"), "t")
            roots = roots.join(step, "root", "left").select("node", F.coalesce("t", "root").alias("root"))
        roots = cut_lineage(roots)
        turn += 1
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
