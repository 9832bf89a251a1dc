"""Connected components by alternating large-star and small-star steps, each a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.scratch import Scratch


def _hung(edges: DataFrame, centre: str, leaf: str) -> DataFrame:
    """Every edge with the smallest neighbour (or self) of its ``centre``."""
    least = edges.groupBy(centre).agg(F.min(leaf).alias("least")).withColumn("least", F.least("least", centre))
    return edges.join(least, centre)


def _downward(edges: DataFrame) -> DataFrame:
    return (
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def components(edges: DataFrame, scratch: Scratch, name: str = "links") -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node it can reach.

    ``edges`` has two bigint columns u, v; loops, repeats and either direction are fine.  Null ends are
    dropped.  No step gathers a component: hubs spread over tasks in the joins, and minima are combined
    before they are shuffled.
    """
    edges = scratch.table(f"{name}-0", _downward(edges.where(F.col("u").isNotNull() & F.col("v").isNotNull())))
    before, step = None, 0
    while True:
        # large star: neighbours above a node hang on the least of its neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _downward(_hung(both, "u", "v").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("least").alias("v")))
        # small star: a node and its lower neighbours hang on the least of them
        hung = _hung(large, "u", "v")
        small = hung.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(hung.select("u", F.col("least").alias("v")))
        step += 1
        edges = scratch.table(f"{name}-{step}", _downward(small))
        scratch.drop(f"{name}-{step - 1}")
        after = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
