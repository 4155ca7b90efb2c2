"""Connected components of a distributed graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import fitted, written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (its smallest node) for every node of links (a, b); a written table.

    Each round points neighbours at the smallest node next to them, first upwards, then downwards, until all
    links are stars; the number of rounds grows with the logarithm of the longest path. Nodes of many links
    meet in joins that AQE can split, never in one row. Every round is a written table, dealt out by its rows.
    """
    edges = written(_ordered(links), "links")
    rows = edges.count()
    for _ in range(rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b")
        large = written(fitted(large.distinct(), rows), "large-stars")
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        near = large.select(F.col("b").alias("u"), F.col("a").alias("v")).join(low, "u")
        small = near.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(
            low.select(F.col("m").alias("a"), F.col("u").alias("b"))
        )
        edges = written(fitted(_ordered(small), rows), "small-stars")
        # stars: no end of a link is the centre of another
        if fitted(edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi"), rows).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ends = F.explode(F.array("a", "b")).alias("node")
    return written(fitted(edges.select(ends, F.col("a").alias("component")).distinct(), rows), "components")


def _ordered(links: DataFrame) -> DataFrame:
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return links.where("a <> b").select(low.alias("a"), high.alias("b")).distinct()
