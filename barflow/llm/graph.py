"""Connected components of an edge table, without any group or component on one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.common import stage


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges as (u, v), u > v."""
    return edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) that is not itself the smallest of its component.

    Large star and small star in turn, each a grouped minimum joined back, until the edges are stars around the
    smallest nodes. Every round is written in the shared folder; only its row count and a checksum come to the
    driver.
    """
    e, seen = stage(_ordered(edges)), None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or state[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(state)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the joins stand on plain exchanges of both sides and a node with very many edges can be split.
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large)
        small = stage(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(small, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        e = stage(_ordered(moved.union(small.select(F.col("u").alias("a"), F.col("m").alias("b")))))
