"""Connected components by alternating stars: labels move over tables, never to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinledger.llm.common import materialize


def _stars(pairs: DataFrame, keep: str) -> DataFrame:
    """Link each neighbour of ``u`` to the least of them and ``u``; ``keep`` says which neighbours."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("hub"), F.least("u", "m").alias("m"))
    moved = pairs.join(least, F.col("u") == F.col("hub"))
    out = moved.filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a, b); the component is its smallest node.

    Large stars hang a node's larger neighbours on the least one, small stars the smaller
    ones; the number of rounds grows with the logarithm of the longest path.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(_stars(both, "v > u"), "large_stars")
        # every edge points down now; a node's smaller neighbours and itself move to the least
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least.withColumnRenamed("u", "hub"), F.col("u") == F.col("hub"))
        small = moved.select("u", F.col("m").alias("v")).union(moved.select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = materialize(small.filter("u <> v").distinct(), "small_stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
