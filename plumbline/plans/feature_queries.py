"""Registered queries for derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import features
from plumbline.plans.registry import query, table


@query(
    "feature_ratio",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate,
      l_extendedprice / nullif(l_quantity, 0) AS price_per_unit,
      l_extendedprice / nullif(l_discount, 0) AS price_per_discount
    FROM lineitem
    """,
)
def feature_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    df = features.ratio(df, "l_extendedprice", "l_quantity", "price_per_unit")
    df = features.ratio(df, "l_extendedprice", "l_discount", "price_per_discount")
    return df.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "price_per_unit", "price_per_discount"
    )


@query(
    "feature_growth",
    """
    WITH m AS (SELECT o_orderstatus, date_trunc('month', o_orderdate)::TIMESTAMP AS month, sum(o_totalprice) AS revenue
               FROM orders GROUP BY 1, 2)
    SELECT o_orderstatus, month, round(revenue, 2) AS revenue, round(100 * (revenue - lag(revenue) OVER w)
      / lag(revenue) OVER w, 4) AS growth_pct
    FROM m WINDOW w AS (PARTITION BY o_orderstatus ORDER BY month)
    """,
)
def feature_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")
    monthly = table(spark, sf_dir, "orders").groupBy("o_orderstatus", month).agg(F.sum("o_totalprice").alias("revenue"))
    grown = features.growth_pct(monthly, "revenue", "month", "o_orderstatus")
    return grown.withColumns({"revenue": F.round("revenue", 2), "growth_pct": F.round("growth_pct", 4)})


@query(
    "feature_days_between",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, date_diff('day', o_orderdate, l_shipdate) AS days_to_ship
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
)
def feature_days_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    days = features.days_between(joined, "o_orderdate", "l_shipdate", "days_to_ship")
    return days.select("l_orderkey", "l_linenumber", "l_partkey", "days_to_ship")


@query(
    "feature_threshold",
    """
    SELECT c_custkey, c_acctbal >= (SELECT quantile_cont(c_acctbal, 0.9) FROM customer) AS is_high_value,
      c_acctbal >= 5000 AS is_over_5000
    FROM customer
    """,
)
def feature_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    df = features.flag_threshold(df, "c_acctbal", quantile=0.9, flag="is_high_value")
    df = features.flag_threshold(df, "c_acctbal", threshold=5000.0, flag="is_over_5000")
    return df.select("c_custkey", "is_high_value", "is_over_5000")


@query(
    "feature_rolling_sum",
    """
    WITH d AS (SELECT c_mktsegment, o_orderdate::DATE AS day, sum(o_totalprice) AS total
               FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
    SELECT c_mktsegment, strftime(day, '%Y-%m-%d') AS day, round(total, 2) AS total, round(sum(total) OVER (
      PARTITION BY c_mktsegment ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW), 2) AS rolling_total
    FROM d
    """,
)
def feature_rolling_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    rolled = features.rolling_sum(joined, "o_totalprice", "o_orderdate", "c_mktsegment", 30)
    return rolled.select(
        "c_mktsegment", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("total", 2).alias("total"),
        F.round("rolling_total", 2).alias("rolling_total"),
    )


@query(
    "feature_user_expressions",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round(l_extendedprice * (1 - l_discount), 4) AS net_price,
      upper(l_returnflag) || l_linestatus AS state
    FROM lineitem
    """,
)
def feature_user_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
        "l_linestatus",
    )
    more, _ = features.add_features(df, [
        ("net_price", "round(l_extendedprice * (1 - l_discount), 4)"),
        ("state", "upper(l_returnflag) || l_linestatus"),
        ("broken", "no_such_column + 1"),
        ("l_quantity", "l_quantity * 2"),
    ])
    return more.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "net_price", "state")


@query(
    "feature_bucketize",
    """
    SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class
    FROM part
    """,
)
def feature_bucketize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = features.bucketize(
        table(spark, sf_dir, "part"), "p_size", [10, 30], ["small", "medium", "large"], "size_class"
    )
    return df.select("p_partkey", "size_class")


@query(
    "feature_calendar",
    """
    SELECT o_orderkey, year(o_orderdate)::INTEGER AS year, quarter(o_orderdate)::INTEGER AS quarter,
      month(o_orderdate)::INTEGER AS month, (isodow(o_orderdate) - 1)::INTEGER AS weekday,
      'FY' || year(o_orderdate + INTERVAL 9 MONTH) || '-Q' || quarter(o_orderdate + INTERVAL 9 MONTH) AS fiscal_quarter
    FROM orders
    """,
)
def feature_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = features.calendar_parts(table(spark, sf_dir, "orders"), "o_orderdate", fiscal_start=4)
    return parts.select("o_orderkey", "year", "quarter", "month", "weekday", "fiscal_quarter")
