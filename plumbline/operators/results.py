"""Result summaries and chart-ready reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.fixed_values import MAX_SAMPLES
from plumbline.functions.frames import EXACT_JSON, as_list, col, is_temporal, one_row
from plumbline.operators.analyses import GRAINS, period_start
from plumbline.operators.ordered import neighbour
from plumbline.operators.profile import sample_rows

#: Column categories of a matrix that are kept in one value.
AXIS_BLOCK = 1_000


def summarize_result(
    df: DataFrame, query_id: str, path: str = "", order_by: str | Sequence[str] | None = None,
    execution_ms: int = 0,
) -> DataFrame:
    """One row: row count, column names and at most five sample rows as JSON, moments with all six digits."""
    head = sample_rows(df, MAX_SAMPLES, order_by)
    shown = one_row(head.agg(F.collect_list(F.to_json(F.struct(*[col(c) for c in df.columns]), EXACT_JSON)).alias("rows")))
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(query_id).alias("query_id"),
        F.lit(path).alias("result_path"),
        "row_count",
        F.array(*[F.lit(c) for c in df.columns]).alias("column_names"),
        shown["rows"].alias("sample_rows"),
        F.lit(execution_ms).cast("bigint").alias("execution_ms"),
        F.lit(None).cast("string").alias("error"),
    )


def top_with_others(df: DataFrame, dim: str, metric: str, n: int = 7, others: str = "Others") -> DataFrame:
    """Totals of the ``n - 1`` largest members plus one row for all others (at most ``n`` slices).

    The largest members are found by a sort with a limit, so no window gathers all members.
    """
    totals = df.groupBy(col(dim)).agg(F.sum(col(metric)).alias("total"))
    best = totals.orderBy(F.desc("total"), col(dim)).limit(n - 1).select(col(dim).alias("_best"))
    # at most n - 1 rows, so the broadcast is bounded
    marked = totals.join(F.broadcast(best), col(dim).eqNullSafe(F.col("_best")), "left")
    label = F.when(F.col("_best").isNull() & col(dim).isNotNull(), F.lit(others)).otherwise(
        F.coalesce(col(dim).cast("string"), F.lit(others))
    )
    return marked.groupBy(label.alias(dim)).agg(F.sum("total").alias(metric), F.count(F.lit(1)).alias("members"))


def matrix(df: DataFrame, rows: str, cols: str, metric: str, col_values: Sequence | None = None) -> DataFrame:
    """Long category-by-category totals with a zero where a pair does not occur; NULL is a category like the others.

    Every row category is expanded by the column categories, which is what a matrix is; they come in blocks of
    about ``AXIS_BLOCK``, so that no value grows with their number.
    """
    totals = df.groupBy(col(rows).alias("_r"), col(cols).alias("_c")).agg(F.sum(col(metric)).alias("_total"))
    members = totals.select("_r").distinct()
    if col_values is None:
        axis = totals.select("_c").distinct()
        blocks = F.greatest(F.lit(1), F.ceil(axis.agg(F.count(F.lit(1))).scalar() / AXIS_BLOCK))
        listed = axis.groupBy(F.pmod(F.xxhash64("_c"), blocks).alias("_block")).agg(
            F.collect_list(F.struct("_c")).alias("_members")
        )
        spread = members.select("_r", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("_block"))
        cells = spread.join(listed, "_block").select("_r", F.inline("_members"))
    else:
        cells = members.select("_r", F.explode(F.array(*[F.lit(v) for v in col_values])).alias("_c"))
    found = totals.withColumnsRenamed({"_r": "_found_r", "_c": "_found_c"})
    return cells.join(
        found, F.col("_r").eqNullSafe(F.col("_found_r")) & F.col("_c").eqNullSafe(F.col("_found_c")), "left"
    ).select(F.col("_r").alias(rows), F.col("_c").alias(cols), F.coalesce("_total", F.lit(0.0)).alias(metric))


def series(df: DataFrame, date: str, grain: str, by: str, metric: str) -> DataFrame:
    """Totals per period and series with a zero for every missing period of the whole range; NULL is a series like the others."""
    when = period_start(col(date), grain)
    totals = df.groupBy(col(by).alias("_by"), when.alias("_period")).agg(F.sum(col(metric)).alias("_total"))
    ends = one_row(totals.agg(F.min("_period").alias("lo"), F.max("_period").alias("hi")))
    step = F.expr(f"INTERVAL {GRAINS[grain]}")
    spine = totals.select(F.col("_by").alias(by)).distinct().select(
        col(by), F.explode(F.sequence(ends["lo"], ends["hi"], step)).alias("period")
    )
    return spine.join(totals, col(by).eqNullSafe(F.col("_by")) & (F.col("period") == F.col("_period")), "left").select(
        by, "period", F.coalesce("_total", F.lit(0.0)).alias(metric)
    )


def compact_number(value: Column) -> Column:
    """``1234567`` as ``1.2M``."""
    size = F.abs(value)

    def scaled(unit: float, mark: str) -> Column:
        return F.concat(F.format_string("%.1f", (value / F.lit(unit)).cast("double")), F.lit(mark))

    return (
        F.when(size >= 1e12, scaled(1e12, "T"))
        .when(size >= 1e9, scaled(1e9, "B"))
        .when(size >= 1e6, scaled(1e6, "M"))
        .when(size >= 1e3, scaled(1e3, "K"))
        .otherwise(F.format_string("%.1f", value.cast("double")))
    )


def result_shape(df: DataFrame, query_id: str, compositional: bool = False) -> DataFrame:
    """The facts about a result that decide its chart: one row per result."""

    def kind(t: T.DataType) -> str:
        return "temporal" if is_temporal(t) else "numeric" if isinstance(t, T.NumericType) else "category"

    kinds = [kind(f.dataType) for f in df.schema.fields]
    category = next((f.name for f, k in zip(df.schema.fields, kinds) if k == "category"), None)
    groups = F.approx_count_distinct(col(category)) if category else F.lit(0)
    return df.agg(F.count(F.lit(1)).alias("row_count"), groups.cast("bigint").alias("groups")).select(
        F.lit(query_id).alias("query_id"), "row_count", "groups",
        F.lit(len(kinds)).alias("columns"),
        F.lit(kinds[0]).alias("x_kind"),
        F.lit(kinds[1] if len(kinds) > 1 else "").alias("y_kind"),
        F.lit(kinds.count("category")).alias("categories"),
        F.lit(compositional).alias("compositional"),
    )


def suggest_chart(shapes: DataFrame) -> DataFrame:
    """Add ``chart_type`` to a table of result shapes."""
    chart = (
        F.when((F.col("row_count") == 1) & (F.col("columns") == 1), "kpi_card")
        .when(F.col("x_kind") == "temporal", "line")
        .when((F.col("x_kind") == "category") & (F.col("y_kind") == "category"), "heatmap")
        .when((F.col("categories") > 0) & F.col("compositional") & (F.col("groups") <= 7), "pie")
        .when((F.col("x_kind") == "numeric") & (F.col("y_kind") == "numeric") & (F.col("categories") == 0), "scatter")
        .otherwise("bar")
    )
    return shapes.withColumn("chart_type", chart)


def check_series(df: DataFrame, date: str, value: str, order: Sequence[str], by: str | Sequence[str] | None = None) -> DataFrame:
    """Counts of null, NaN and infinite values and of moments earlier than the row before them."""
    by = as_list(by)
    if not by:
        df, by = df.withColumn("_all", F.lit(1)), ["_all"]
    v = col(value).cast("double")
    rows = neighbour(df, by, order, [date], "previous", "_before")
    inf = float("inf")
    return rows.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(v.isNull()).alias("null_values"),
        F.count_if(F.isnan(v)).alias("nan_values"),
        F.count_if((v == inf) | (v == -inf)).alias("infinite_values"),
        F.count_if(col(date) < F.col(f"_before.{date}")).alias("out_of_order"),
    ).withColumn(
        "is_valid",
        (F.col("null_values") + F.col("nan_values") + F.col("infinite_values") + F.col("out_of_order")) == 0,
    )


