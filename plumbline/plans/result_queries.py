"""Registered queries for results and chart shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import results
from plumbline.plans.analysis_queries import JOINED, orders_with_region
from plumbline.plans.registry import query, table


@query(
    "result_summary",
    """
    SELECT 'q_001' AS query_id, count(*) AS row_count, 'c_custkey,c_mktsegment' AS column_names,
      (SELECT string_agg('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}', '|'
         ORDER BY c_custkey) FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 5)) AS samples
    FROM customer
    """,
)
def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    summary = results.summarize_result(df, "q_001", order_by="c_custkey")
    return summary.select(
        "query_id", "row_count", F.array_join("column_names", ",").alias("column_names"),
        F.array_join(F.array_sort("sample_rows"), "|").alias("samples"),
    )


@query(
    "result_top_with_others",
    f"""
    WITH t AS (SELECT n_name, sum(o_totalprice) AS total FROM {JOINED} GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY total DESC, n_name) AS p FROM t)
    SELECT CASE WHEN p <= 6 THEN n_name ELSE 'Others' END AS n_name, round(sum(total), 2) AS o_totalprice,
      count(*) AS members FROM r GROUP BY 1
    """,
)
def result_top_with_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = results.top_with_others(orders_with_region(spark, sf_dir), "n_name", "o_totalprice", 7)
    return slices.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query(
    "result_matrix",
    """
    SELECT f.l_returnflag, s.l_linestatus, round(coalesce(sum(l.l_quantity), 0), 2)::DOUBLE AS l_quantity
    FROM (SELECT DISTINCT l_returnflag FROM lineitem) f CROSS JOIN (SELECT DISTINCT l_linestatus FROM lineitem) s
    LEFT JOIN lineitem l ON l.l_returnflag = f.l_returnflag AND l.l_linestatus = s.l_linestatus GROUP BY 1, 2
    """,
)
def result_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.matrix(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity").withColumn(
        "l_quantity", F.round("l_quantity", 2)
    )


@query(
    "result_series",
    """
    WITH ends AS (SELECT date_trunc('day', min(ts)) AS lo, date_trunc('day', max(ts)) AS hi FROM events
                  WHERE value > 100),
    spine AS (SELECT event_type, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY)) AS period
              FROM (SELECT DISTINCT event_type FROM events WHERE value > 100), ends),
    t AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS period, sum(value) AS v FROM events WHERE value > 100
          GROUP BY 1, 2)
    SELECT s.event_type, s.period, round(coalesce(t.v, 0), 4) AS value FROM spine s
    LEFT JOIN t ON s.event_type = t.event_type AND s.period = t.period
    """,
)
def result_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "events").filter("value > 100")
    return results.series(large, "ts", "day", "event_type", "value").withColumn("value", F.round("value", 4))


@query(
    "result_compact_numbers",
    """
    SELECT o_custkey, CASE WHEN t >= 1e6 THEN printf('%.1fM', t / 1e6) WHEN t >= 1e3 THEN printf('%.1fK', t / 1e3)
      ELSE printf('%.1f', t) END AS spent
    FROM (SELECT o_custkey, round(sum(o_totalprice), 2) AS t FROM orders GROUP BY 1)
    """,
)
def result_compact_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("t"))
    return totals.select("o_custkey", results.compact_number(F.col("t")).alias("spent"))


@query(
    "result_chart_types",
    """
    SELECT 'total' AS query_id, 'kpi_card' AS chart_type FROM (SELECT count(*) FROM orders)
    UNION ALL SELECT 'by_day', 'line' FROM (SELECT count(*) FROM orders)
    UNION ALL SELECT 'by_status', CASE WHEN count(DISTINCT o_orderstatus) <= 7 THEN 'pie' ELSE 'bar' END FROM orders
    UNION ALL SELECT 'by_customer', 'bar' FROM (SELECT count(*) FROM orders)
    UNION ALL SELECT 'numbers', 'scatter' FROM (SELECT count(*) FROM orders)
    UNION ALL SELECT 'pairs', 'heatmap' FROM (SELECT count(*) FROM orders)
    """,
)
def result_chart_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    total = F.sum("o_totalprice").alias("total")
    shapes = [
        results.result_shape(orders.agg(total), "total"),
        results.result_shape(orders.groupBy("o_orderdate").agg(total), "by_day"),
        results.result_shape(orders.groupBy("o_orderstatus").agg(total), "by_status", compositional=True),
        results.result_shape(orders.groupBy(F.col("o_custkey").cast("string")).agg(total), "by_customer", True),
        results.result_shape(orders.select("o_totalprice", "o_custkey"), "numbers"),
        results.result_shape(orders.groupBy("o_orderstatus", "o_orderpriority").agg(total), "pairs"),
    ]
    return results.suggest_chart(reduce(DataFrame.unionByName, shapes)).select("query_id", "chart_type")


@query(
    "result_check_series",
    """
    WITH s AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 75 = 1 THEN 'nan'::DOUBLE
                 WHEN event_id % 99 = 2 THEN 'inf'::DOUBLE ELSE value END AS v,
                 lag(ts) OVER (PARTITION BY user_id ORDER BY value, event_id) AS before FROM events)
    SELECT count(*) AS row_count, count(*) FILTER (v IS NULL) AS null_values, count(*) FILTER (isnan(v)) AS nan_values,
      count(*) FILTER (isinf(v)) AS infinite_values, count(*) FILTER (ts < before) AS out_of_order, false AS is_valid
    FROM s
    """,
)
def result_check_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    damaged = (
        F.when(i % 50 == 0, F.lit(None)).when(i % 75 == 1, F.lit(float("nan"))).when(i % 99 == 2, F.lit(float("inf")))
        .otherwise(F.col("value"))
    )
    df = table(spark, sf_dir, "events").withColumn("v", damaged)
    return results.check_series(df, "ts", "v", ["value", "event_id"], "user_id")
