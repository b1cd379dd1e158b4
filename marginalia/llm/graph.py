"""Connected components of a graph of long ids, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node that it is connected to) for every node of the edges (a, b).

    Stars grow until nothing changes: each round first ties the larger neighbours of a node to its
    smallest neighbour, then the smaller ones.  Every round is two grouped minima, whose partial sums
    are taken before the shuffle, and a join back to the edges; rows never meet by component, and the
    number of rounds grows with the logarithm of the nodes.  Each round is written, so lineage stays
    short, and deleted after the next."""
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = common.staged(pairs, "edges")
    before = None
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last, pairs = pairs, common.staged(small.where("u <> v").distinct(), "edges")
        common.dropped(last)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40)), F.max(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components didn't settle")
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
