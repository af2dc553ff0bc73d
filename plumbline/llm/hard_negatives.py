"""Hard negatives: rows of other labels whose score lies in a window under that of a positive, by threshold joins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.frames import col
from plumbline.llm.common import saved
from plumbline.llm.vector_codes import usable

#: Rows and anchors of a task; of those, rows and anchors of one index; dimensions added up at a time.
ROWS, ANCHORS = 16_384, 4096
INDEX_ROWS, INDEX_ANCHORS, STEP = 4096, 64, 8
#: Of an index every so many-th row is scored first, to find out where a threshold may start.
PROBE = 64
#: Scores under this are exact in double precision.
EXACT = 2**52


class Side:
    """Vectors with their suffix norms: of the components from each step on, a little too large rather than too small."""

    def __init__(self, x: np.ndarray, steps: list[slice]):
        self.x = x
        squares = np.array([(x[:, s] ** 2).sum(axis=1) for s in steps]).reshape(len(steps), len(x))
        upto = np.concatenate([squares[::-1].cumsum(axis=0)[::-1], np.zeros((1, len(x)))])
        self.suffix = np.sqrt(upto) * (1 + 1e-9)


def reached(anchors: Side, rows: Side, least: np.ndarray, steps: list[slice]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (anchor, row, score) with a score of at least the anchor's ``least``.

    1. The index holds a row's leading components only: what follows is left out once its norm, times that of any anchor's
       same components, stays under that anchor's threshold. A row that is covered from the start is in no list.
       Rows stand in order of how much of them is indexed, so a component's list is a run of them.
    2. The lists' products are added up to partial scores. An anchor keeps the rows that can still reach
       its threshold with the norms of what is left.
    3. Those are completed step by step, and dropped as soon as they cannot reach it any more.
    """
    slack = 1 + 1e-9 * anchors.suffix[0][:, None] * rows.suffix[0].max(initial=0)  # for what rounding may cost a bound
    with np.errstate(divide="ignore", invalid="ignore"):
        limit = ((least[:, None] - slack) / anchors.suffix.T).min(axis=0, initial=np.inf)
    indexed = (rows.suffix[:-1] >= np.nan_to_num(limit[:-1], nan=-np.inf, posinf=np.inf, neginf=-np.inf)[:, None]).sum(axis=0)
    open_ended = np.isneginf(least).any() or (least <= slack[:, 0]).any()
    if open_ended:  # some anchor takes rows that share nothing with it
        indexed[:] = len(steps)
    order = np.argsort(-indexed, kind="stable")
    order = order[: len(order) if open_ended else (indexed > 0).sum()]
    cut = indexed[order]
    partial = np.zeros((len(least), len(order)))
    for j, step in enumerate(steps):
        listed = (cut > j).sum()
        partial[:, :listed] += anchors.x[:, step] @ rows.x[order[:listed], step].T
    bound = partial + anchors.suffix[cut].T * rows.suffix[cut, order] + slack
    a, at = np.nonzero(bound >= least[:, None])
    score = partial[a, at]
    for j in range(cut.min(initial=len(steps)), len(steps)):
        more = cut[at] <= j
        step = steps[j]
        score[more] += (anchors.x[a[more]][:, step] * rows.x[order[at[more]]][:, step]).sum(axis=1)
        rest = np.where(more, anchors.suffix[j + 1, a] * rows.suffix[j + 1, order[at]], np.inf)
        keep = score + rest + slack[a, 0] >= least[a]
        a, at, score = a[keep], at[keep], score[keep]
    keep = score >= least[a]
    return a[keep], order[at[keep]], score[keep]


def first_in_windows(
    anchors: np.ndarray, rows: np.ndarray, ids: np.ndarray, allowed: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, row, score): for each window the first ``wanted`` allowed rows with low <= score <= high.

    Higher scores come first, ties by smaller id. ``owner`` is a window's anchor, ``allowed`` says which rows an anchor may
    take. Thresholds start at the best probe under a window's upper end and are lowered, twice as far each
    time, until the window is full or its lower end reached; only open windows go on.
    """
    dims = rows.shape[1]
    strength = np.argsort(-(rows.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    largest = [np.sqrt((side.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) for side in (anchors, rows)]
    if largest[0] * largest[1] >= EXACT:
        raise ValueError("the vectors' scores may pass 2**52; take a smaller scale")
    steps = [slice(i, min(i + STEP, dims)) for i in range(0, dims, STEP)]
    anchors, rows = anchors[:, strength].astype(np.float64), rows[:, strength].astype(np.float64)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(rows), INDEX_ROWS):
        here = slice(at, at + INDEX_ROWS)
        side = Side(rows[here], steps)
        top = Side(anchors, steps).suffix[0] * side.suffix[0].max(initial=0) + 1
        upper = np.minimum(high, top[owner])
        probes = anchors @ rows[here][::PROBE].T
        start = np.full(len(owner), -np.inf)
        for w in range(len(owner)):
            mine = probes[owner[w]][allowed[owner[w], here][::PROBE]]
            mine = mine[mine <= high[w]]
            start[w] = mine.max() if len(mine) else upper[w] - max(1.0, (upper[w] - max(low[w], -top[owner[w]])) / 4)
        start = np.maximum(start, low)
        open_windows = np.flatnonzero(low <= upper)
        while len(open_windows):
            least = np.full(len(anchors), np.inf)
            np.minimum.at(least, owner[open_windows], start[open_windows])
            wanting = np.flatnonzero(least < np.inf)
            wanting = wanting[np.argsort(least[wanting] / np.maximum(top[wanting], 1), kind="stable")]
            full = np.zeros(len(owner), bool)
            for i in range(0, len(wanting), INDEX_ANCHORS):
                group = wanting[i : i + INDEX_ANCHORS]
                a, r, score = reached(Side(anchors[group], steps), side, least[group], steps)
                a = group[a]
                keep = allowed[a, at + r]
                a, r, score = a[keep], r[keep] + at, score[keep]
                order = np.lexsort((ids[r], -score, a))
                a, r, score = a[order], r[order], score[order]
                ends = {x: (b, e) for x, b, e in zip(*np.unique(a, return_index=True), [*np.flatnonzero(np.diff(a)) + 1, len(a)])}
                for w in open_windows[np.isin(owner[open_windows], group)]:
                    b, e = ends.get(owner[w], (0, 0))
                    b += np.searchsorted(-score[b:e], -high[w])
                    e = min(b + wanted, b + np.searchsorted(-score[b:e], -max(start[w], low[w]), side="right"))
                    if e - b == wanted or start[w] <= low[w] or start[w] < -top[owner[w]]:
                        full[w] = True
                        found.append((np.full(e - b, w), r[b:e], score[b:e]))
            open_windows = open_windows[~full[open_windows]]
            start[open_windows] = np.maximum(low[open_windows], upper[open_windows] - 2 * (upper[open_windows] - start[open_windows]) - 1)
    window, row, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids[row], -score, window))
    window, row, score = window[order], row[order], score[order]
    starts = np.searchsorted(window, window)
    keep = np.arange(len(window)) - starts < wanted
    return window[keep], row[keep], score[keep]


def _stacked(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_list()) if len(vectors) else np.zeros((0, 0), np.int64)
    return x if x.dtype == np.int64 else x.astype(np.int64)


def _searched(wanted: int, shares: tuple[int, int] | None, out: list[str]):
    def search(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["id", "key"])
        if not len(anchors) or not len(rows):
            return pd.DataFrame({c: [] for c in out})
        labels = pd.factorize(pd.concat([anchors["label"], rows["label"]]))[0]
        allowed = labels[: len(anchors), None] == labels[None, len(anchors) :]
        if shares is None:
            windows = pd.DataFrame({"owner": np.arange(len(anchors)), "place": 0, "low": -np.inf, "high": np.inf})
            allowed &= (anchors["id"].to_numpy()[:, None] != rows["id"].to_numpy()) | (anchors["key"].to_numpy()[:, None] != rows["key"].to_numpy())
        else:
            allowed = ~allowed
            low, high = shares
            windows = pd.DataFrame([
                {"owner": i, "place": w["place"], "low": -(-low * w["score"] // 100), "high": high * w["score"] // 100}
                for i, own in enumerate(anchors["windows"]) for w in own
            ])
        w, r, score = first_in_windows(
            np.stack(anchors["x"].to_list()), np.stack(rows["x"].to_list()), rows["id"].to_numpy(), allowed,
            windows["owner"].to_numpy(), windows["low"].to_numpy(float), windows["high"].to_numpy(float), wanted,
        )
        found = anchors.iloc[windows["owner"].to_numpy()[w]]
        return pd.DataFrame({
            "anchor_id": found["id"].to_numpy(), "anchor_key": found["key"].to_numpy(), "place": windows["place"].to_numpy()[w],
            "other_id": rows["id"].to_numpy()[r], "other_key": rows["key"].to_numpy()[r], "score": score.astype(np.int64),
        })[out]

    return search


def _meet(
    anchors: DataFrame, rows: DataFrame, pool: list[str], wanted: int, shares: tuple[int, int] | None, rows_per_task: int, anchors_per_task: int
) -> DataFrame:
    """The anchors' first ``wanted`` rows of each pair of blocks; every block of a pool's anchors meets every block of its rows."""
    sizes = (
        rows.groupBy(*pool).agg(F.count(F.lit(1)).alias("n"))
        .join(anchors.groupBy(*pool).agg(F.count(F.lit(1)).alias("m")), pool)
        .select(*pool, F.ceil(F.col("n") / rows_per_task).alias("row_blocks"), F.ceil(F.col("m") / anchors_per_task).alias("anchor_blocks"))
    )
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cell = [*pool, "anchor_block", "row_block"]
    columns = [*cell, *[c for c in ("id", "key", "label", "x") if c not in pool]]
    a = anchors.join(sizes, pool).withColumn("anchor_block", block("anchor_blocks")).withColumn("row_block", every("row_blocks"))
    b = rows.join(sizes, pool).withColumn("row_block", block("row_blocks")).withColumn("anchor_block", every("anchor_blocks"))
    out = {"anchor_id": "long", "anchor_key": "long", "place": "int", "other_id": "long", "other_key": "long", "score": "long"}
    a, b = a.select(*columns, *(["windows"] if shares else [])), b.select(*columns)
    return a.groupBy(*cell).cogroup(b.groupBy(*cell)).applyInPandas(
        _searched(wanted, shares, list(out)), ", ".join(f"{c} {t}" for c, t in out.items())
    )


def mine_hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding",
    rows_per_task: int = ROWS, anchors_per_task: int = ANCHORS,
) -> DataFrame:
    """For every anchor and each of its positives the best rows of other labels in a window under the positive's score.

    Components become floor(scale * x); a score is the inner product of two rows of equal length. Higher scores come first, ties
    by smaller id. An anchor's positives are its first ``positives`` other rows of its label. Of each, the first ``negatives`` rows
    of other labels with low / 100 * positive score <= score <= high / 100 * positive score are returned (all, if fewer).

    Two threshold joins (see ``reached`` and ``first_in_windows``), the first within a label, the second over all rows. Anchors and
    rows are dealt into blocks of about ``anchors_per_task`` and ``rows_per_task`` by a hash of the id; a task has one block of
    each and hands on at most ``negatives`` rows per window, so a label that holds most rows is many tasks.

    anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Rows with a null id, label or vector, or a null or
    non-finite component take no part. Rows equal in id, label and components count once; an id with several
    differing rows is as many rows. Vectors of no component score 0 with one another. Other columns are ignored, an empty table gives
    no rows. Vectors so long that a score may pass 2**52 raise an error, as scores would be rounded.
    """
    vector = col(vector_column).cast("array<double>")
    rows = vectors.filter(usable(vector) & col(id_column).isNotNull() & col(label_column).isNotNull()).select(
        col(id_column).cast("long").alias("id"), col(label_column).alias("label"), anchors.alias("anchor"),
        F.transform(vector, lambda x: F.floor(x * scale)).alias("x"),
    )
    rows = saved(
        rows.withColumn("dims", F.size("x")).withColumn("key", F.xxhash64("id", "label", "x")), "negatives-rows"
    )
    asking = saved(rows.filter("anchor").dropDuplicates(["id", "key"]), "negatives-anchors")
    close = _meet(asking, rows, ["dims", "label"], positives, None, rows_per_task, anchors_per_task)
    place = F.row_number().over(Window.partitionBy("anchor_id", "anchor_key").orderBy(F.desc("score"), "other_id", "other_key"))
    close = saved(close.withColumn("place", place).filter(F.col("place") <= positives), "negatives-positives")
    windows = close.groupBy("anchor_id", "anchor_key").agg(F.collect_list(F.struct("place", "score")).alias("windows"))
    asked = asking.join(windows, (F.col("id") == F.col("anchor_id")) & (F.col("key") == F.col("anchor_key"))).drop("anchor_id", "anchor_key")
    far = _meet(asked, rows, ["dims"], negatives, (low, high), rows_per_task, anchors_per_task)
    rank = F.row_number().over(
        Window.partitionBy("anchor_id", "anchor_key", "place").orderBy(F.desc("score"), "other_id", "other_key")
    )
    far = far.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    of = close.select("anchor_id", "anchor_key", "place", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(of, ["anchor_id", "anchor_key", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
