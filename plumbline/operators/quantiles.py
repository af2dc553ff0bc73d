"""Exact order statistics without holding a column's values in one task.

Spark's own ``percentile`` and ``mode`` keep a map of all distinct values of a group in one
reducer. Here the values are counted first. Groups of more values than fit a task are cut along the value by range partitioning, so
pieces are even wherever the values lie; sums per piece tell which of them holds each wanted rank, and only those pieces are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.frames import as_list, col, in_pieces, join_groups, written

VALUES_PER_PIECE = 1_000_000


def value_counts(df: DataFrame, value: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """One row per group and distinct value; combined map-side, so a frequent value costs nothing."""
    keys = [col(c) for c in as_list(by)]
    return (
        df.select(*keys, col(value).cast("double").alias("_v"))
        .filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def _placed(counts: DataFrame, probs: Sequence[float], keys: list[str], values_per_piece: int) -> DataFrame:
    """The counts that may hold a wanted rank, with ``_end`` (rows of the group up to and including the value), total and values."""
    by = [col(c) for c in keys]
    ends = lambda *parts: Window.partitionBy(*parts).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    sizes = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("values"))
    largest, values = sizes.agg(F.max("values"), F.sum("values")).first()
    if largest is None or largest <= values_per_piece:
        group = Window.partitionBy(*by)
        return counts.withColumns({
            "_end": F.sum("_n").over(ends(*by)), "_total": F.sum("_n").over(group), "_values": F.count(F.lit(1)).over(group)
        })
    counts = in_pieces(counts, [*by, F.col("_v")], values, values_per_piece, "_piece")
    # one row per group and piece from here on, not per value
    group = Window.partitionBy(*by)
    pieces = counts.groupBy(*by, "_piece").agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_own")).withColumns({
        "_total": F.sum("_rows").over(group), "_values": F.sum("_own").over(group),
        "_upto": F.sum("_rows").over(group.orderBy("_piece")),
    }).withColumn("_before", F.col("_upto") - F.col("_rows"))
    wanted = F.exists(_ranks(probs), lambda w: (w["rank"] >= F.col("_before")) & (w["rank"] < F.col("_upto")))
    hit = pieces.filter(wanted).select(*by, "_piece", "_before", "_total", "_values")
    picked = join_groups(counts, hit, [*keys, "_piece"], "inner")
    return picked.withColumn("_end", F.col("_before") + F.sum("_n").over(ends(*by, F.col("_piece"))))


def _ranks(probs: Sequence[float]) -> Column:
    """For each probability the ranks (from 0) below and above its place, of a group of ``_total`` rows."""
    at = lambda p: F.lit(float(p)) * (F.col("_total") - 1)
    return F.array(*[
        F.struct(F.lit(float(p)).alias("prob"), F.lit(part).alias("part"), side(at(p)).alias("rank"), at(p).alias("at"))
        for p in probs for part, side in ((0, F.floor), (1, F.ceil))
    ])


def quantiles_of_counts(
    counts: DataFrame, probs: Sequence[float], by: str | Sequence[str] | None = None, values_per_piece: int = VALUES_PER_PIECE
) -> DataFrame:
    """Interpolated quantiles of a ``value_counts`` frame, one row per group and probability.

    ``distinct_count`` is the number of rows of ``counts`` in the group. The counts are written once, as they are
    gone through up to three times.
    """
    by = as_list(by)
    keys = [col(c) for c in by]
    picked = _placed(written(counts.select(*keys, "_v", "_n"), "value-counts"), probs, by, values_per_piece)
    picked = picked.withColumn("_wanted", _ranks(probs))
    hits = picked.select(
        *keys, "_v", "_values",
        F.explode(
            F.filter(
                "_wanted",
                lambda w: (w["rank"] >= F.col("_end") - F.col("_n")) & (w["rank"] < F.col("_end")),
            )
        ).alias("w"),
    )
    ends = hits.groupBy(*keys, F.col("w.prob").alias("prob")).agg(
        F.max(F.when(F.col("w.part") == 0, F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("w.part") == 1, F.col("_v"))).alias("_hi"),
        F.max("w.at").alias("_at"),
        F.max("_values").alias("distinct_count"),
    )
    between = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_at") - F.floor("_at"))
    value = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(between)  # also for infinities
    return ends.select(*keys, "prob", value.alias("value"), "distinct_count")


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: str | Sequence[str] | None = None,
    exact: bool = True,
) -> DataFrame:
    """Quantiles per group in long form (group columns, ``prob``, ``value``)."""
    by = as_list(by)
    if exact:
        return quantiles_of_counts(value_counts(df, value, by), probs, by).drop("distinct_count")
    keys = [col(c) for c in by]
    wide = df.groupBy(*keys).agg(
        F.percentile_approx(col(value).cast("double"), [float(p) for p in probs], 10000).alias("_q")
    )
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("prob"), F.col("_q").alias("value"))
    return wide.select(*keys, F.inline(pairs).alias("prob", "value"))


def wide_quantiles(
    df: DataFrame, value: str, names: dict[str, float], by: str | Sequence[str] | None = None, exact: bool = True
) -> DataFrame:
    """Quantiles as one row per group, a column per entry of ``names``."""
    by = as_list(by)
    long = quantiles(df, value, sorted(set(names.values())), by, exact)
    return long.groupBy(*[col(c) for c in by]).agg(
        *[F.max(F.when(F.col("prob") == float(p), F.col("value"))).alias(n) for n, p in names.items()]
    )


def most_frequent(df: DataFrame, value: str, by: str | Sequence[str] | None = None, name: str = "mode") -> DataFrame:
    """The most frequent non-null value per group; a tie goes to the smallest value."""
    keys = [col(c) for c in as_list(by)]
    counts = df.filter(col(value).isNotNull()).groupBy(*keys, col(value)).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(
        F.min_by(col(value), F.struct(-F.col("_n"), col(value))).alias(name)
    )
