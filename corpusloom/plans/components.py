"""Connected components by alternating star contraction.

Each round is two aggregations and two joins over the edge list (Kiveris et al. 2014,
"Connected Components in MapReduce and Beyond"): every node hangs its larger neighbours,
then its smaller ones, on the least identifier it sees. Nothing is collected but one row of
change counters, hub nodes are split by adaptive skew joins because the other side of each join
has one row per node, and rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .materialize import observed


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges(u, v)`` written, with the number of links between two nodes and a hash of them all."""
    linked = F.col("u") != F.col("v")
    out, seen = observed(edges, n=F.count_if(linked), x=F.bit_xor(F.when(linked, F.xxhash64("u", "v"))))
    return out, (seen["n"], seen["x"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every node of ``edges``; component is the least id reachable.

    Directions, repeats and self-links do not matter; rows with a null end are ignored.
    A node whose only links are self-links is its own component.
    """
    a, b = F.col(src), F.col(dst)
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (a.isNotNull() & b.isNotNull()).alias("ok"))
    pairs, mark = _marked(pairs.where("ok").select("u", "v").distinct())
    alone = pairs.where("u = v").select(F.col("u").alias("id"))
    links = pairs.where("u <> v")
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = links.select(F.col("u").alias("a"), F.col("v").alias("b")).union(links.select("v", "u"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before = mark
        links, mark = _marked(small.union(root.select("u", F.col("m").alias("v"))).distinct())
        if before == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labelled = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("id")).union(alone)
    return labelled.union(roots.distinct().join(labelled.select("id"), "id", "left_anti").select("id", F.col("id").alias("component")))
