"""Connected components of an edge table, by alternating large and small stars.

Every step is an aggregation to the smallest neighbour and a join back, so a node
of very many edges is pre-aggregated and split like any skewed join key. The
number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushlake.llm.tables import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.expr("array(struct(a, b), struct(b as a, a as b))")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("least"))
    stars = both.filter("b > a").join(least, "a")
    return stars.select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a > b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    links = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return links.unionByName(least.withColumnRenamed("least", "b")).filter("a > b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``edges(a, b)``.

    Loops and repeated edges do not matter; no edges give no rows.
    """
    now = written(edges.filter("a <> b").select("a", "b").distinct(), name)
    seen = None
    while True:
        now = written(_small_star(_large_star(now)), name)
        state = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
        ).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
