"""Connected components as DataFrame steps: a distributed union-find by alternating stars.

Each round links every node to the least node it knows, first among all its neighbours (large star),
then among the smaller ones (small star), until nothing changes. A round is two aggregations with
map-side combining and two equi-joins; no adjacency list is ever gathered, so a hub costs no more
than its links, and where links are many the side of a hub is split between tasks. Every round is written to the
shared folder, which cuts lineage and lets lost executors be replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_staged, staged


#: From so many links on, the least neighbours are written before they are joined: the planner then knows both sides' partitions and splits those of a hub.
WRITTEN = 100_000


def _least(links: DataFrame, written: bool) -> DataFrame:
    """The least neighbour of each node."""
    found = links.groupBy("a").agg(F.min("b").alias("least"))
    return staged(found, "least") if written else found


def _large_star(links: DataFrame, written: bool) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).toDF("a", "b")
    least = _least(both, written)
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"))


def _small_star(links: DataFrame, written: bool) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down, written)
    moved = down.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b")))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its least node. Loops and repeated links are allowed."""
    spark = links.sparkSession
    start = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, before = staged(start, "links"), None
    while True:
        seen = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen["n"] == 0 or seen == before:
            break
        before = seen
        written = seen["n"] >= WRITTEN
        large = _large_star(current, written).distinct()
        large = staged(large, "large") if written else large
        after = staged(_small_star(large, written).distinct(), "links")
        drop_staged(spark, current, *([large] if written else []))
        current = after
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    named = staged(current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots), "groups")
    drop_staged(spark, current)
    return named
