"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import saved

#: The stages of a round have a task for so many links at least, and FEW tasks in any case.
LINKS_A_TASK, FEW = 100_000, 8


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) of every node with a link to another; component is the smallest node reached.

    Alternates large-star and small-star steps: links are replaced by links to the smallest neighbour, until
    every component is a star. No node's links are gathered: a step is an aggregation (smallest
    neighbour) and a join on the node, whose hot keys Spark splits. Each round is written to the shared
    folder. No stage has more tasks than the links need, as in a small graph each shuffle would leave a piece of some bytes for
    each pair of partitions. Links of a node with itself, nulls and repeated links do no harm.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    edges = saved(
        edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links"
    )
    state = _state(edges)
    while True:
        tasks = max(FEW, -(-2 * state[0] // LINKS_A_TASK))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(nearest, "a").filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        large = large.coalesce(tasks).distinct().coalesce(tasks)
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")
        )
        edges = saved(small.coalesce(tasks).distinct().coalesce(tasks), "links")
        before, state = state, _state(edges)
        if before == state:
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
