"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorline.llm.common import discard, stage_table


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame, made: list) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = stage_table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "stars")
    made.append(least)
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame, made: list) -> DataFrame:
    made.append(edges := stage_table(edges, "stars"))
    least = stage_table(edges.groupBy("a").agg(F.min("b").alias("m")), "stars")
    made.append(least)
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that has an edge.

    ``edges`` has two integer columns a and b; direction, loops and repeats do
    not matter, rows with a null are left out. Every round is a written table,
    so lineage does not grow, the tables before it are deleted, and the driver
    sees two numbers a round. Stars
    double what a node sees, so rounds grow with the logarithm of the longest
    path. A node of very many edges is split by the joins' skew handling; its
    minimum is aggregated before the shuffle and written, since a join splits the
    rows of a key only if neither side's order serves another step.
    """
    a, b = F.col("a"), F.col("b")
    now = stage_table(edges.filter("a is not null and b is not null and a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "components")
    before = None
    while (state := _state(now)) != before:
        before = state
        if not state[0]:
            break
        made = [now]
        now = stage_table(_small_star(_large_star(now, made), made), "components")
        discard(*made)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
