"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two joins on the edges; labels are the smallest node of a component. Edges stay in Spark: each round is
written to the shared folder and the one before removed. A node of many edges is split by Spark's skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Stage


def large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """edges run from the larger node a to the smaller b: a and its smaller neighbours go to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def settled(edges: DataFrame) -> bool:
    """Whether edges from larger nodes a to smaller ones b are stars: no node has two smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame) -> Stage:
    """Table node, component for all nodes of edges a - b (long, any direction, repeats and loops allowed)."""
    start = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now = Stage(start)
    while not settled(now.df):
        then = Stage(small_star(large_star(now.df)))
        now.drop()
        now = then
    # stars: every node but the smallest has one edge, to the smallest
    found = now.df
    result = Stage(found.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(found.select("b", "b").toDF("node", "component").distinct()))
    now.drop()
    return result
