"""Near-duplicate embeddings by a forest of random-projection trees with overlapping splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import saved
from plumbline.llm.graph import connected_components

#: Levels that one round adds to a tree, and the rows of a node from which their medians are taken.
LEVELS, SAMPLE = 5, 4096
#: Rounds after which no node is split further; far more than 2 ** (LEVELS * ROUNDS) leaves need.
ROUNDS = 12


def directions(tree: int, depth: int, levels: int, size: int) -> np.ndarray:
    """The random unit directions of a tree's levels from ``depth`` on, one row each, always the same."""
    drawn = np.stack([np.random.default_rng([tree, d, size]).standard_normal(size) for d in range(depth, depth + levels)])
    return drawn / np.linalg.norm(drawn, axis=1, keepdims=True)


def unit_rows(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_splits(projected: np.ndarray, levels: int, overlap: float, least: int) -> list[float]:
    """Medians of the nodes of a subtree in heap order (NaN: not split), from a sample of its root's rows.

    A node is not split if it holds fewer than ``least`` sampled rows or if nearly all of them lie in the overlap,
    as near copies of one vector do: both halves would be the node itself again.
    """
    splits = [float("nan")] * (2**levels - 1)
    held = {0: np.arange(len(projected))}
    for node in range(len(splits)):
        rows = held.pop(node, None)
        if rows is None or len(rows) < max(2, least):
            continue
        values = projected[rows, (node + 1).bit_length() - 1]
        middle = float(np.median(values))
        low, high = rows[values < middle + overlap], rows[values >= middle - overlap]
        if len(low) + len(high) > 1.8 * len(rows):
            continue
        splits[node] = middle
        held[2 * node + 1], held[2 * node + 2] = low, high
    return splits


def _grown(at: DataFrame, splits: DataFrame, tree: int, depth: int, overlap: float) -> DataFrame:
    """Send the rows of split nodes down their new levels; a row in an overlap goes both ways."""

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {}
            for size, part in batch.groupby(batch["vector"].map(len)):
                values = unit_rows(part["vector"]) @ directions(tree, depth, LEVELS, size).T
                found |= dict(zip(part.index, values))
            rows, paths, whole = [], [], []
            for i, splits, path in zip(batch.index, batch["splits"], batch["node"]):
                open_nodes = [(0, "")]
                while open_nodes:
                    node, way = open_nodes.pop()
                    middle = splits[node] if node < len(splits) else float("nan")
                    if middle is None or middle != middle:
                        rows.append(i)
                        paths.append(path + way)
                        whole.append(node < len(splits))
                        continue
                    value = found[i][(node + 1).bit_length() - 1]
                    if value < middle + overlap:
                        open_nodes.append((2 * node + 1, way + "0"))
                    if value >= middle - overlap:
                        open_nodes.append((2 * node + 2, way + "1"))
            out = batch.loc[rows, ["class", "group", "weight", "vector"]]
            yield out.assign(node=paths, done=whole)

    return at.join(splits, ["group", "node"]).mapInPandas(
        down, "class long, group string, weight long, vector array<double>, node string, done boolean"
    )


def _fitter(tree: int, depth: int, leaf_rows: int, overlap: float):
    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = unit_rows(part["vector"]) @ directions(tree, depth, LEVELS, len(part["vector"].iloc[0])).T
        least = leaf_rows * len(part) / part["n"].iloc[0]
        return pd.DataFrame({"group": [key[0]], "node": [key[1]], "splits": [fit_splits(x, LEVELS, overlap, least)]})

    return fit


def tree_leaves(classes: DataFrame, tree: int, leaf_rows: int, overlap: float) -> DataFrame:
    """Leaves of one tree: (class, group, weight, vector, node). Every row is in a leaf at least once.

    A round fits ``LEVELS`` levels of every node of more than ``leaf_rows`` rows to at most about ``SAMPLE`` of its rows
    (drawn by a hash of the row) and sends all its rows down. A node that cannot be split stays as a large leaf.
    """
    at = classes.select("class", "group", "weight", "vector", F.lit("").alias("node"), F.lit(False).alias("done"))
    leaves = []
    for round_ in range(ROUNDS):
        sizes = at.groupBy("group", "node").agg(F.count(F.lit(1)).alias("n"))
        large = sizes.filter(F.col("n") > leaf_rows)
        if round_ == 0 and large.isEmpty():
            break
        depth = round_ * LEVELS
        drawn = at.filter("not done").join(large, ["group", "node"]).filter(
            F.pmod(F.xxhash64("class", F.lit(tree), F.lit(round_)), F.lit(1 << 40)) < F.lit(float(SAMPLE) * (1 << 40)) / F.col("n")
        )
        fit = _fitter(tree, depth, leaf_rows, overlap)
        splits = saved(
            drawn.groupBy("group", "node").applyInPandas(fit, "group string, node string, splits array<double>"), "forest-splits"
        )
        leaves.append(at.join(splits, ["group", "node"], "left_anti").select("class", "group", "weight", "vector", "node"))
        if splits.isEmpty():
            return _all(leaves)
        at = saved(_grown(at, splits, tree, depth, overlap), "forest-rows")
    return _all([*leaves, at.select("class", "group", "weight", "vector", "node")])


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def compared(block: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links inside one block of a leaf: per class the weight of what it links with for the first time, and a group head.

    A pair that meets in several leaves counts in the one of lowest code; ``homes`` are the codes of all
    leaves a class is in. Of a block of two chunks only pairs between them are new.
    """
    x = unit_rows(block["vector"])
    close = x @ x.T >= least
    np.fill_diagonal(close, False)
    i, j = block["i"].iloc[0], block["j"].iloc[0]
    chunk = block["chunk"].to_numpy()
    if i != j:
        close &= chunk[:, None] != chunk[None, :]
    code, n = block["leaf"].iloc[0], len(block)
    earlier = [(r, h) for r, homes in enumerate(block["homes"]) for h in homes if h < code]
    counted = close
    if earlier and close.any():
        at, codes = np.array([r for r, _ in earlier]), np.unique([h for _, h in earlier], return_inverse=True)[1]
        member = np.zeros((n, codes.max() + 1), np.float32)
        member[at, codes] = 1
        counted = close & (member @ member.T == 0)
    head = np.arange(n)
    while True:
        nearest = np.minimum(head, np.where(close, head[None, :], n).min(axis=1))
        nearest = nearest[nearest]
        if (nearest == head).all():
            break
        head = nearest
    ids = block["class"].to_numpy()
    return pd.DataFrame({"class": ids, "links": counted @ block["weight"].to_numpy(np.int64), "head": ids[head]})


def near_duplicate_vectors(
    vectors: DataFrame,
    least_cosine: float = 0.93,
    trees: int = 6,
    leaf_rows: int = 2048,
    overlap_share: float = 0.5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """Link vectors of one label whose cosine, in double precision, is at least ``least_cosine``; unite the links.

    Equal vectors become one class with a weight. Each of ``trees`` trees splits a label's classes by random
    directions at the median; rows within ``overlap_share`` standard deviations of what a linked pair differs
    by along a direction go to both sides. Medians come from at most about ``SAMPLE`` hashed rows of a node, all rows are
    sent down. Leaves are compared in blocks of ``leaf_rows``; larger ones (near copies that no direction
    parts) chunk by chunk, so no task holds more than two chunks. Blocks give sums and group heads, never pairs.

    One row per row: vec_id, row (unique), n_links (other vectors linked directly), component_id (smallest vec_id
    reachable) and kept. Vectors that are null, empty, zero or hold null or non-finite numbers, or whose label
    is null, link with nothing and are their own component. Only vectors of one length are compared. A null id
    counts as none when the smallest is sought; repeated rows are vectors of their own; other columns are
    ignored; an empty table gives no rows.
    """
    rows = saved(
        vectors.select(
            F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("string").alias("label"),
            F.col(vector_column).cast("array<double>").alias("vector"), F.monotonically_increasing_id().alias("row"),
        ), "vectors",
    )
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(finite & F.exists("vector", lambda v: v != 0), F.lit(False))
    group = F.concat_ws(":", F.size("vector").cast("string"), "label")
    classes = saved(
        rows.filter(usable).groupBy(group.alias("group"), "vector").agg(
            F.min("row").alias("class"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least_id")
        ), "vector-classes",
    )
    # rows of a linked pair are sqrt(2 - 2 cos) apart, so their difference along a random direction deviates by that / sqrt(size)
    size = classes.agg(F.max(F.size("vector"))).first()[0] or 1
    overlap = overlap_share * float(np.sqrt((2 - 2 * least_cosine) / size))
    leaves = _all([
        tree_leaves(classes, t, leaf_rows, overlap).withColumn("leaf", F.xxhash64(F.lit(t), "group", "node")) for t in range(trees)
    ])
    leaves = saved(leaves, "forest-leaves")
    homes = leaves.groupBy("class").agg(F.sort_array(F.collect_set("leaf")).alias("homes"))
    sizes = leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    chunks = F.ceil(F.col("n") / leaf_rows)
    placed = leaves.join(sizes, "leaf").join(homes, "class").withColumn("chunk", F.pmod(F.xxhash64("class"), chunks)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1))
    ).withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    found = saved(
        placed.select("class", "weight", "vector", "leaf", "homes", "chunk", "i", "j").groupBy("leaf", "i", "j").applyInPandas(
            lambda block: compared(block, least_cosine), "class long, links long, head long"
        ), "forest-links",
    )
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    components = connected_components(found.filter("class <> head").select(F.col("class").alias("a"), F.col("head").alias("b")))
    united = classes.join(links, "class", "left").join(components, classes["class"] == components["node"], "left").select(
        "class", "group", "vector", "least_id",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "class").alias("component"),
    )
    least = united.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = united.join(least, "component").select("group", F.col("vector").alias("same"), "n_links", "component_id", F.lit(True).alias("known"))
    out = rows.withColumn("own_group", F.when(usable, group)).join(
        named, (F.col("own_group") == named["group"]) & (F.col("vector") == F.col("same")), "left"
    )
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", "row", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
