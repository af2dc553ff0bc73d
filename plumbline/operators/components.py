"""Groups of linked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.frames import written


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node of the links (a, b), both long, the smallest node it can reach.

    Every node starts as its own root. A round hooks the root of each link's larger end under the smaller root, and then lets
    every node jump to its root's root, so the depth halves: rounds grow with the logarithm of the longest path. A
    round is two joins and an aggregation on ids; Spark splits the joins at hot nodes, and the aggregations combine
    before the shuffle.
    """
    ends = written(
        links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
        .filter("a <> b").distinct(), "component-links",
    )
    both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = _settled(written(
        both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), "component-roots"
    ))
    while True:
        of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
        crossing = written(
            ends.join(of("a"), "a").join(of("b"), "b").filter("root_a <> root_b")
            .select(F.greatest("root_a", "root_b").alias("high"), F.least("root_a", "root_b").alias("low")).distinct(),
            "component-crossing",
        )
        ends = crossing.select(F.col("high").alias("a"), F.col("low").alias("b"))  # contracted: roots stand for their nodes
        if crossing.isEmpty():
            break
        hooks = crossing.groupBy("high").agg(F.min("low").alias("under"))
        hooked = written(
            roots.join(hooks, F.col("root") == F.col("high"), "left").select("node", F.coalesce("under", "root").alias("root")),
            "component-roots",
        )
        roots = _settled(hooked)
    return roots


def _settled(roots: DataFrame) -> DataFrame:
    """Jump to the root's root until nothing changes."""
    while True:
        up = roots.select(F.col("node").alias("at"), F.col("root").alias("above"))
        jumped = written(
            roots.join(up, F.col("root") == F.col("at"), "left").select(
                "node", F.coalesce("above", "root").alias("root"), (F.coalesce("above", "root") != F.col("root")).alias("moved")
            ), "component-roots",
        )
        roots = jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            return roots
