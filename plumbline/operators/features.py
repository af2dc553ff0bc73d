"""Derived columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.frames import as_list, col, one_row
from plumbline.operators.quantiles import wide_quantiles


def ratio(df: DataFrame, num: str, den: str, name: str) -> DataFrame:
    """``num / den``, NULL where the divisor is zero."""
    return df.withColumn(name, F.try_divide(col(num), col(den)))


def growth_pct(df: DataFrame, value: str, order: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """Percent change against the period before, for rows already summed per period and series."""
    keys = [col(c) for c in as_list(by)] or [F.lit(1)]
    before = F.lag(col(value)).over(Window.partitionBy(*keys).orderBy(col(order)))
    return df.withColumn("growth_pct", F.try_divide((col(value) - before) * 100.0, before))


def days_between(df: DataFrame, start: str, end: str, name: str = "days") -> DataFrame:
    return df.withColumn(name, F.date_diff(col(end), col(start)).cast("bigint"))


def flag_threshold(
    df: DataFrame, name: str, threshold: float | None = None, quantile: float | None = None, flag: str = "flag",
    exact: bool = True,
) -> DataFrame:
    """True where the column reaches a fixed value or the given quantile of the column."""
    if (threshold is None) == (quantile is None):
        raise ValueError("give either threshold or quantile")
    if threshold is not None:
        return df.withColumn(flag, col(name) >= F.lit(threshold))
    limit = one_row(wide_quantiles(df, name, {"q": quantile}, None, exact))["q"]
    return df.withColumn(flag, col(name) >= limit)


def rolling_sum(df: DataFrame, value: str, date: str, by: str | Sequence[str], days: int = 30) -> DataFrame:
    """Sum per day and over the ``days`` days ending with it; rows are summed per day before the window."""
    keys = [col(c) for c in as_list(by)]
    daily = df.groupBy(*keys, F.to_date(col(date)).alias("day")).agg(F.sum(col(value)).alias("total"))
    back = Window.partitionBy(*keys).orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    return daily.withColumn("rolling_total", F.sum("total").over(back))


def add_features(df: DataFrame, defs: Sequence[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Add columns given as (name, SQL expression) and report what became of each.

    An expression is only analysed, not run, to see whether it holds; names already in use are refused.
    """
    good: dict[str, Column] = {}
    report = []
    for name, text in defs:
        if name.lower() in {c.lower() for c in [*df.columns, *good]}:
            report.append((name, text, False, "name already in use"))
            continue
        try:
            df.select("*", F.expr(text).alias(name)).schema
        except PySparkException as error:
            report.append((name, text, False, str(error).split("\n")[0]))
            continue
        good[name] = F.expr(text)
        report.append((name, text, True, None))
    status = df.sparkSession.createDataFrame(report, "name string, sql_expr string, accepted boolean, error string")
    return (df.withColumns(good) if good else df), status


def bucketize(df: DataFrame, name: str, edges: Sequence[float], labels: Sequence[str], bucket: str = "bucket") -> DataFrame:
    """Label by interval: below the first edge, between edges (lower one included), from the last on."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one label more than edges is needed")
    pick = F.when(col(name).isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        pick = pick.when(col(name) < edge, label)
    return df.withColumn(bucket, pick.otherwise(labels[-1]))


def calendar_parts(df: DataFrame, date: str, fiscal_start: int = 1) -> DataFrame:
    """Year, quarter, month, weekday and the label of the fiscal quarter (named after its closing year)."""
    d = col(date)
    moved = F.add_months(F.to_date(d), (13 - fiscal_start) % 12)
    label = F.concat(F.lit("FY"), F.year(moved).cast("string"), F.lit("-Q"), F.quarter(moved).cast("string"))
    return df.withColumns({
        "year": F.year(d), "quarter": F.quarter(d), "month": F.month(d), "weekday": F.weekday(d),
        "fiscal_quarter": label,
    })
