"""Analyses for the seven kinds of business question and the usual query angles."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.frames import as_list, col, join_groups, one_row, with_row
from plumbline.operators.ordered import row_position
from plumbline.operators.quantiles import quantiles


#: Grains of time with the length of one period.
GRAINS = {
    "minute": "1 MINUTE", "hour": "1 HOUR", "day": "1 DAY", "week": "7 DAY", "month": "1 MONTH", "quarter": "3 MONTH",
    "year": "1 YEAR",
}


def period_start(date: Column, grain: str) -> Column:
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain!r}; use one of {', '.join(GRAINS)}")
    return F.date_trunc(grain, date).cast("timestamp_ntz")


def trend(df: DataFrame, date: str, metric: str, grain: str = "month", by: str | Sequence[str] | None = None) -> DataFrame:
    """Metric per period (and series) with its change against the period before."""
    keys = [col(c) for c in as_list(by)]
    totals = df.groupBy(*keys, period_start(col(date), grain).alias("period")).agg(F.sum(col(metric)).alias("total"))
    # one row per period and series from here on
    before = F.lag("total").over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy("period"))
    return totals.withColumn("change", F.col("total") - before).withColumn(
        "change_pct", F.try_divide(F.col("change") * 100.0, F.col("total") - F.col("change"))
    )


def root_cause(
    df: DataFrame, date: str, metric: str, dims: Sequence[str], first: tuple[str, str], second: tuple[str, str]
) -> DataFrame:
    """How much each member of each dimension adds to the change between two periods (start, end excluded).

    One scan: rows are summed per combination of members, then that table is turned on its dimensions. A dimension with
    very many members is ranked in chunks.
    """

    def within(span: tuple[str, str]) -> Column:
        return (col(date) >= F.lit(span[0]).cast("timestamp_ntz")) & (col(date) < F.lit(span[1]).cast("timestamp_ntz"))

    a, b = within(first), within(second)
    cells = df.filter(a | b).groupBy(*[col(d) for d in dims]).agg(
        F.coalesce(F.sum(F.when(a, col(metric))), F.lit(0.0)).alias("before"),
        F.coalesce(F.sum(F.when(b, col(metric))), F.lit(0.0)).alias("after"),
    )
    members = cells.select(
        F.inline(F.array(*[
            F.struct(F.lit(d).alias("dimension"), col(d).cast("string").alias("member")) for d in dims
        ])),
        "before", "after",
    )
    sums = members.groupBy("dimension", "member").agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
    sums = sums.withColumn("change", F.col("after") - F.col("before"))
    sums = sums.withColumn("_size", F.abs("change"))
    totals = sums.groupBy("dimension").agg(F.sum("change").alias("_total"))
    ranked = row_position(sums, "dimension", [("_size", True), "member"], "rank")
    return join_groups(ranked, totals, ["dimension"]).select(
        "dimension", "member", "before", "after", "change", F.try_divide("change", "_total").alias("share_of_change"),
        F.col("rank").cast("int").alias("rank"),
    )


def compare(df: DataFrame, dim: str, a, b, metric: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """Member ``a`` against member ``b`` side by side."""
    keys = [col(c) for c in as_list(by)]
    sides = df.filter(col(dim).isin(a, b)).groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(col(dim) == F.lit(a), col(metric))), F.lit(0.0)).alias("total_a"),
        F.coalesce(F.sum(F.when(col(dim) == F.lit(b), col(metric))), F.lit(0.0)).alias("total_b"),
    )
    return sides.withColumn("difference", F.col("total_a") - F.col("total_b")).withColumn(
        "difference_pct", F.try_divide(F.col("difference") * 100.0, F.col("total_b"))
    )


def histogram(df: DataFrame, name: str, bins: int) -> DataFrame:
    """Equal-width bins over the range of the column with their row counts, empty bins included.

    Nulls, NaN and infinite values have no place on the axis and are left out.
    """
    v = F.when(F.abs(col(name).cast("double")) < float("inf"), col(name).cast("double"))
    range_of = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    ends = F.col("_ends")
    width = (ends["hi"] - ends["lo"]) / bins
    at = F.coalesce(F.floor(F.try_divide(v - ends["lo"], width)), F.lit(0))
    counts = with_row(df.filter(v.isNotNull()).select(col(name)), range_of, "_ends").groupBy(
        F.least(at, F.lit(bins - 1).cast("bigint")).alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"))
    axis = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return with_row(axis.join(counts, "bin", "left"), range_of, "_ends").select(
        "bin",
        (ends["lo"] + F.col("bin") * width).alias("low"),
        (ends["lo"] + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def percentiles(
    df: DataFrame, name: str, probs: Sequence[float], by: str | Sequence[str] | None = None, exact: bool = True
) -> DataFrame:
    return quantiles(df, name, probs, by, exact)


def correlation_matrix(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns in long form; all pairs in one aggregation."""
    pairs = list(combinations(range(len(names)), 2))
    cols = [col(n).cast("double") for n in names]
    wide = df.agg(*[F.corr(cols[i], cols[j]).alias(f"r_{i}_{j}") for i, j in pairs])

    def cell(i: int, j: int) -> Column:
        r = F.lit(1.0) if i == j else F.col(f"r_{min(i, j)}_{max(i, j)}")
        return F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), r.alias("correlation"))

    every = [cell(i, j) for i in range(len(names)) for j in range(len(names))]
    return wide.select(F.inline(F.array(*every)))


def top_n(
    df: DataFrame, by: str | Sequence[str], metric: str, n: int, within: str | Sequence[str] | None = None,
    ties: str = "rank", bottom: bool = False,
) -> DataFrame:
    """The ``n`` largest (or smallest) members by total, overall or per group of ``within``.

    ``ties``: ``rank`` keeps all equal at the border, ``dense_rank`` counts equal totals once,
    ``row_number`` breaks ties by member. Spark cuts each group to ``n`` before the shuffle, so a large group is not
    moved as a whole.
    """
    by, within = as_list(by), as_list(within)
    totals = df.groupBy(*[col(c) for c in [*within, *by]]).agg(F.sum(col(metric)).alias("total"))
    order = [F.asc("total") if bottom else F.desc("total")]
    if ties == "row_number":
        order += [col(c) for c in by]
    place = {"rank": F.rank, "dense_rank": F.dense_rank, "row_number": F.row_number}[ties]()
    groups = [col(c) for c in within] or [F.lit(1)]
    ranked = totals.withColumn("place", place.over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.filter(F.col("place") <= n)


def _period_number(period: Column, grain: str) -> Column:
    """Periods since a fixed origin, so that equal steps in time are equal steps in number."""
    if grain == "month":
        return (F.year(period) * 12 + F.month(period) - 1).cast("bigint")
    if grain == "year":
        return F.year(period).cast("bigint")
    if grain == "day":
        return F.unix_date(F.to_date(period)).cast("bigint")
    raise ValueError("grain is day, month or year")


def _period_of(number: Column, grain: str) -> Column:
    if grain == "month":
        return F.make_date(F.floor(number / 12).cast("int"), (number % 12 + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")
    if grain == "year":
        return F.make_date(number.cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return F.date_from_unix_date(number.cast("int")).cast("timestamp_ntz")


def fit_lines(series: DataFrame, period: str, value: str, grain: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """Straight-line fit per series: slope, intercept, last period number and residual deviation."""
    keys = [col(c) for c in as_list(by)]
    x, y = _period_number(col(period), grain).cast("double"), col(value).cast("double")
    fit = series.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.max(x).cast("bigint").alias("last_x"), F.regr_count(y, x).alias("points"),
        (F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x)).alias("_sse"),
    )
    spread = F.sqrt(F.try_divide(F.greatest(F.col("_sse"), F.lit(0.0)), F.col("points") - 2))
    return fit.withColumn("residual_std", spread).drop("_sse")


def forecast_linear(
    df: DataFrame, date: str, metric: str, by: str | Sequence[str] | None = None, horizon: int = 3,
    grain: str = "month", z: float = 1.96,
) -> DataFrame:
    """The next ``horizon`` periods of every series on its fitted line, with lower and upper bounds."""
    by = as_list(by)
    totals = df.groupBy(*[col(c) for c in by], period_start(col(date), grain).alias("period")).agg(
        F.sum(col(metric)).alias("total")
    )
    ahead = fit_lines(totals, "period", "total", grain, by).withColumn("_step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    x = F.col("last_x") + F.col("_step")
    predicted = F.col("intercept") + F.col("slope") * x
    return ahead.select(
        *[col(c) for c in by],
        _period_of(x, grain).alias("period"),
        predicted.alias("predicted"),
        (predicted - F.col("residual_std") * z).alias("lower"),
        (predicted + F.col("residual_std") * z).alias("upper"),
    )


def hold_out(df: DataFrame, date: str, metric: str, by: str | Sequence[str] | None, tail: int, grain: str = "month") -> DataFrame:
    """Actual and predicted values of the last ``tail`` periods, predicted from the periods before them."""
    by = as_list(by)
    keys = [col(c) for c in by]
    totals = df.groupBy(*keys, period_start(col(date), grain).alias("period")).agg(F.sum(col(metric)).alias("actual"))
    x = _period_number(F.col("period"), grain)
    last = F.max(x).over(Window.partitionBy(*(keys or [F.lit(1)])))
    totals = totals.withColumn("_tail", x > last - tail)
    lines = fit_lines(totals.filter("NOT _tail"), "period", "actual", grain, by)
    rest = totals.filter("_tail").drop("_tail")
    if by:
        joined = rest.join(lines, by)
        slope, intercept = F.col("slope"), F.col("intercept")
    else:
        line = F.col("_line")
        joined, slope, intercept = with_row(rest, lines, "_line"), line["slope"], line["intercept"]
    return joined.select(*keys, "period", "actual", (intercept + slope * x).alias("predicted"))


def forecast_accuracy(pairs: DataFrame, actual: str, predicted: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """Mean absolute, root mean square and mean absolute percentage error; zero actuals are left out of the last."""
    gap = col(predicted) - col(actual)
    return pairs.groupBy(*[col(c) for c in as_list(by)]).agg(
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.avg(F.abs(F.try_divide(gap, col(actual))) * 100).alias("mape"),
    )


def kpi(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """One row of headline figures."""
    return df.agg(*[c.alias(n) for n, c in measures.items()])


def breakdown(df: DataFrame, dim: str, metric: str) -> DataFrame:
    """Metric per member with its share of the total."""
    whole = one_row(df.agg(F.sum(col(metric)).alias("total")))["total"]
    return df.groupBy(col(dim)).agg(F.sum(col(metric)).alias("total")).withColumn(
        "share", F.try_divide(F.col("total"), whole)
    )


def anomalies(
    df: DataFrame, date: str, metric: str, by: str, grain: str = "hour", z: float = 3.0, trailing: int | None = None
) -> DataFrame:
    """Periods whose total lies more than ``z`` deviations from the mean of its series.

    With ``trailing`` the mean and deviation are those of that many periods before. Rows are summed per period first, so
    a window holds the periods of a series, not its rows.
    """
    totals = df.groupBy(col(by), period_start(col(date), grain).alias("period")).agg(F.sum(col(metric)).alias("total"))
    w = Window.partitionBy(col(by))
    if trailing is not None:
        w = w.orderBy("period").rowsBetween(-trailing, -1)
    scored = totals.withColumn("mean", F.avg("total").over(w)).withColumn("std", F.stddev_samp("total").over(w))
    return scored.filter(F.abs(F.col("total") - F.col("mean")) > F.col("std") * z)


def benchmark(df: DataFrame, dim: str, metric: str) -> DataFrame:
    """Mean per segment against the mean over all rows."""
    segments = df.groupBy(col(dim)).agg(F.avg(col(metric)).alias("segment_mean"), F.count(F.lit(1)).alias("n"))
    overall = F.col("overall_mean")
    return segments.withColumn("overall_mean", one_row(df.agg(F.avg(col(metric)).alias("m")))["m"]).withColumn(
        "difference_pct", F.try_divide((F.col("segment_mean") - overall) * 100.0, overall)
    )
