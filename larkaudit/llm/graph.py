"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkaudit.llm.common import cut, salted_join

def _star(both: DataFrame, larger: bool) -> DataFrame:
    """Ties each node's larger (or smaller and own) neighbours to the smallest of its neighbours and itself.

    Smallest neighbours are summed up before they are shuffled, and a hub's rows are dealt
    into parts, so no node's rows gather in one task.
    """
    least = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n")))
    joined = salted_join(both, least, "a")
    if larger:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    return joined.where("b <= a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _finished(edges: DataFrame) -> bool:
    """Whether all edges are stars: no node has two parents, and no parent has one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("child")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("child")))
    return ends.groupBy("node").agg(F.sum("child").alias("parents"), F.min("child").alias("only")).where("parents > 1 or parents = 1 and only = 0").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of ``links`` (a, b) that has a link to another.

    Links count both ways; null ends, loops and repeated links change nothing; no links, no rows.
    Rounds go on until all edges are stars, their number growing with the logarithm of the table's size.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b and a is not null and b is not null").distinct())
    while not _finished(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = cut(_star(both, True))
        edges = cut(_star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False))
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
