"""Connected components of an edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialized


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``; a component is named by its smallest node.

    Each round links every node's larger neighbours to the least of its neighbourhood, then its smaller ones. The number
    of rounds grows with the logarithm of the longest path. No neighbourhood is gathered: a round is two minima by key
    and two joins. Null ends and self loops are ignored; an empty list has no components.
    """
    now = materialized(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), purpose)
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        now = materialized(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), purpose)
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if seen == state:
            break
        state = seen
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
