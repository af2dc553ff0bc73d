"""Column profiles kept per part of a table (a day, a file) and merged, so that new data is all that is read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from plumbline.functions.frames import col, is_integral, is_numeric, is_temporal, join_groups

#: Size of the sketches of order statistics, and the share of rows by which a rank read from them may be off (99 %).
SKETCH_K, RANK_ERROR = 400, 0.01
#: log2 of the registers of the sketches of distinct values; their relative deviation is about 0.8 %.
DISTINCT_LOG2 = 14
PART = "_part"


def _figures(field: T.StructField) -> Column:
    """What is kept of one column, as a struct of aggregates; sketches of what a type has no order or numbers for are NULL."""
    c, kind = col(field.name), field.dataType
    number = c.cast("double") if is_numeric(kind) else F.lit(None).cast("double")
    number = F.when(~F.isnan(number), number)
    whole = is_integral(kind)
    if whole:
        identity = c.cast("bigint")
    elif is_temporal(kind):
        identity = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        identity = F.to_json(c)
    else:
        identity = c if isinstance(kind, T.BinaryType) else c.cast("string")
    ordered = not isinstance(kind, (T.ArrayType, T.StructType, T.MapType, T.BinaryType))
    nothing = F.lit(None)
    return F.struct(
        F.lit(field.name).alias("column_name"), F.lit(kind.simpleString()).alias("column_type"),
        F.count(F.lit(1)).alias("rows"), F.count(c).alias("present"),
        (F.min(c).cast("string") if ordered and not is_numeric(kind) else nothing.cast("string")).alias("min_text"),
        (F.max(c).cast("string") if ordered and not is_numeric(kind) else nothing.cast("string")).alias("max_text"),
        F.min(number).alias("min"), F.max(number).alias("max"),
        F.count(number).alias("numbers"), F.avg(number).alias("mean"), (F.var_pop(number) * F.count(number)).alias("spread"),
        F.hll_sketch_agg(identity, DISTINCT_LOG2).alias("distinct"),
        (F.kll_sketch_agg_double(number, SKETCH_K) if is_numeric(kind) else nothing.cast("binary")).alias("order"),
    )


def part_profiles(df: DataFrame, part: Column) -> DataFrame:
    """One row per part and column: counts, extremes, mean and spread, and mergeable sketches of distinct values and order.

    One aggregation, combined before the shuffle; sketches have a fixed size however many rows they stand for.
    """
    figures = [_figures(f) for f in df.schema.fields]
    wide = df.withColumn(PART, part.cast("string")).groupBy(PART).agg(*[
        f.alias(f"f{i}") for i, f in enumerate(figures)
    ])
    return wide.select(F.col(PART).alias("part"), F.inline(F.array(*[F.col(f"f{i}") for i in range(len(figures))])))


def merge_profiles(parts: DataFrame) -> DataFrame:
    """A row per column over all parts: as a single pass over their rows would give, order statistics within ``RANK_ERROR``.

    Columns that appear in some parts only count as missing nowhere else; a type that changed between parts is a column of
    its own.
    """
    by = ["column_name", "column_type"]
    sums = parts.groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.sum("present").alias("present"), F.min("min_text").alias("_min_text"), F.max("max_text").alias("_max_text"),
        F.min("min").alias("_min"), F.max("max").alias("_max"), F.sum("numbers").alias("_numbers"),
        F.try_divide(F.sum(F.col("mean") * F.col("numbers")), F.sum("numbers")).alias("mean"),
        F.hll_union_agg("distinct").alias("_distinct"), F.kll_merge_agg_double("order", SKETCH_K).alias("_order"),
    )
    means = sums.select(*by, F.col("mean").alias("_mean"))
    apart = F.col("spread") + F.col("numbers") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean"))
    spreads = join_groups(parts.select(*by, "spread", "numbers", "mean"), means, by).groupBy(*by).agg(F.sum(apart).alias("_spread"))
    quantile = lambda p: F.when(F.col("_numbers") > 0, F.kll_sketch_get_quantile_double("_order", F.lit(p)))
    return join_groups(sums, spreads, by).select(
        *by, "rows", (F.col("rows") - F.col("present")).alias("nulls"),
        F.coalesce("_min_text", F.col("_min").cast("string")).alias("min"), F.coalesce("_max_text", F.col("_max").cast("string")).alias("max"),
        F.hll_sketch_estimate("_distinct").alias("approx_unique"), "mean",
        F.when(F.col("_numbers") > 1, F.sqrt(F.col("_spread") / (F.col("_numbers") - 1))).alias("std"),
        quantile(0.25).alias("q25"), quantile(0.5).alias("q50"), quantile(0.75).alias("q75"),
    )


def update_profiles(df: DataFrame, part: Column, path: str) -> DataFrame:
    """The merged profile of ``df``, of which only parts that ``path`` does not know yet are read and added to it.

    A part counts as known once it is there, so parts have to be complete when they are profiled (closed days, whole
    files). What is stored is a few rows of a few kilobytes per part. Where ``part`` is a partition column, Spark reads the new folders only.
    """
    try:
        stored = df.sparkSession.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = None
    fresh = df
    if stored is not None:
        known = stored.select(F.col("part").alias("_known")).distinct()
        fresh = df.join(known, part.cast("string").eqNullSafe(F.col("_known")), "left_anti")
    part_profiles(fresh, part).write.mode("append").parquet(path)
    return merge_profiles(df.sparkSession.read.parquet(path))
