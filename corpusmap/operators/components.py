"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected components in MapReduce and beyond", SoCC 2014. A step is one
aggregation and one join per node; neighbour lists are never collected, so hubs are harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusmap.sources.scratch import discard, materialize_observed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return (
        both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, with a fingerprint of the set."""
    table, seen = materialize_observed(
        edges,
        "stars",
        n=F.count(F.lit(1)),
        mix=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
    )
    return table, (seen["n"], seen["mix"])


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of each node of the undirected edges (src, dst): node, component.

    A component is named by its lowest node. Nodes without edges do not appear.
    """
    current, seen = _written(
        edges.where("src != dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    while True:
        replaced = current
        current, now = _written(_small_star(_large_star(replaced)))
        discard(replaced)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
