"""Connected components of a link table, by alternating star contraction.

Each round replaces links by links to the smallest neighbour: first every
node points its larger neighbours at its smallest neighbour, then its smaller
ones. The links end as stars around the smallest node of each component, after
a number of rounds logarithmic in practice. Rounds are written below the
checkpoint folder, so the plan stays short; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.runtime import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")).withColumnRenamed("a", "node")
    return (both.join(low, F.col("a") == F.col("node")).filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "node")
    joined = down.join(low, F.col("a") == F.col("node"))
    return (joined.select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(low.select(F.col("node").alias("a"), F.col("low").alias("b"))).filter("a <> b").distinct())


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the
    component's smallest node."""
    edges = scratch.keep(edges.select("a", "b").filter("a <> b"), f"{name}_0")
    mark, k = None, 0
    while True:
        k += 1
        edges = scratch.keep(_small_star(_large_star(edges)), f"{name}_{k}")
        r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (r.n, r.h) == mark:
            break
        mark = (r.n, r.h)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
