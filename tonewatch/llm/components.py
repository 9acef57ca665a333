"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _digest(edges: DataFrame) -> tuple:
    found = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(found)


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``links(a, b)`` but the roots: the smallest node it can reach.

    A step takes the least neighbour of each node, an aggregate that combines
    before the shuffle, and joins it back.  That join streams the links of a node
    through one task, unless adaptive execution cuts it: a node with very many
    neighbours takes long there, though no memory.  Every step is written to the
    shared folder.
    The number of steps grows with the logarithm of the longest path.  Links of
    a node to itself and links that repeat change nothing; no links, no rows.
    """
    ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = materialize(ends.filter("u <> v").distinct(), "links")
    before = _digest(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(least.withColumnRenamed("m", "v").unionByName(moved).distinct(), "links")
        after = _digest(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
