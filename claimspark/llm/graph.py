"""Connected components by alternating large-star and small-star rounds on an edge table.

Each round is two aggregations with map-side minima and two joins; the written edge table cuts
the lineage, and a count and a hash sum, not edges, reach the driver. A node with very many
edges is one hot join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b) that is not the smallest of its component.

    Loops and repeated edges are allowed, null ends are not; no edges give no rows.
    """
    e = materialize(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        n, total = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if (n, total) == before or n == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = (n, total)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large.filter(F.col("a") != F.col("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low.withColumnRenamed("a", "k"), F.col("a") == F.col("k")).filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(moved.unionByName(low.withColumnRenamed("m", "b")).distinct())
