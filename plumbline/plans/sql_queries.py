"""Registered queries for the SQL surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators import ordered, relational
from plumbline.plans.registry import query, table
from plumbline.session import shared_folder


def _views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


REVENUE_BY_STATUS = "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS revenue, count(*) AS n FROM orders GROUP BY 1"


@query("sql_run", REVENUE_BY_STATUS)
def sql_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guarded, stored and read back."""
    folder = shared_folder(spark, "run")
    views = {"orders": table(spark, sf_dir, "orders")}
    done = relational.run_query(spark, REVENUE_BY_STATUS, folder, views, "by_status").first()
    return spark.read.parquet(done["result_path"])


@query(
    "sql_batch",
    """
    SELECT 'priorities' AS query_id, true AS success, count(DISTINCT o_orderpriority) AS row_count FROM orders
    UNION ALL SELECT 'days', true, count(DISTINCT o_orderdate) FROM orders
    UNION ALL SELECT 'broken', false, 0 FROM (SELECT 1)
    UNION ALL SELECT 'forbidden', false, 0 FROM (SELECT 1)
    """,
)
def sql_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    envelopes = relational.run_batch(
        spark,
        {
            "priorities": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
            "days": "SELECT o_orderdate, sum(o_totalprice) AS v FROM orders GROUP BY 1",
            "broken": "SELECT no_such_column FROM orders",
            "forbidden": "DROP VIEW orders",
        },
        shared_folder(spark, "batch"),
        {"orders": table(spark, sf_dir, "orders")},
        timeout_s=600,
    )
    return envelopes.select("query_id", "success", "row_count")


FORBIDDEN_RE2 = r"(?i)\b(DROP|DELETE|INSERT|UPDATE|CREATE|EXEC)\b|xp_"


@query(
    "sql_guard_documents",
    f"SELECT doc_id, regexp_matches(text, '{FORBIDDEN_RE2}') AS is_forbidden FROM documents",
)
def sql_guard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.scan_sql_log(table(spark, sf_dir, "documents"), "text").select("doc_id", "is_forbidden")


@query(
    "sql_guard_log",
    "SELECT event_type, event_type IN ('error', 'click') AS is_forbidden, count(*) AS n FROM events GROUP BY 1, 2",
)
def sql_guard_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("drop table t -- "), "props"))
        .when(F.col("event_type") == "click", F.concat(F.lit("select 1; XP_cmdshell "), "props"))
        .when(F.col("event_type") == "view", "SELECT created_at, updates FROM inserted")
        .otherwise(F.concat(F.lit("SELECT * FROM t WHERE k = "), "value"))
    )
    log = table(spark, sf_dir, "events").select("event_type", text.alias("text"))
    return relational.scan_sql_log(log, "text").groupBy("event_type", "is_forbidden").agg(F.count(F.lit(1)).alias("n"))


@query(
    "sql_project_filter",
    "SELECT o_orderkey AS order_id, o_totalprice * 1.1 AS gross FROM orders "
    "WHERE o_orderstatus = 'F' AND o_totalprice > 100000",
)
def sql_project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' AND o_totalprice > 100000").select(
        F.col("o_orderkey").alias("order_id"), (F.col("o_totalprice") * 1.1).alias("gross")
    )


@query(
    "sql_group_aggregates",
    """
    SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
      round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc,
      min(l_quantity) AS min_qty, max(l_extendedprice) AS max_price, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY 1, 2
    """,
)
def sql_group_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "lineitem")
    return spark.sql("""
        SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
          round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc,
          min(l_quantity) AS min_qty, max(l_extendedprice) AS max_price, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '2001-09-02 00:00:00' GROUP BY 1, 2
    """)


@query(
    "sql_count_distinct",
    "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers "
    "FROM lineitem GROUP BY 1",
)
def sql_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers")
    )


@query("sql_count_distinct_approx")
def sql_count_distinct_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("parts")
    )


def _grouped(kind: str) -> str:
    return (
        "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY "
        f"{kind}(l_returnflag, l_linestatus)"
    )


@query("sql_rollup", _grouped("ROLLUP"))
def sql_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n")
    )


@query("sql_cube", _grouped("CUBE"))
def sql_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n")
    )


SETS = """
    SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
    GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())
"""


@query("sql_grouping_sets", SETS)
def sql_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "orders")
    return spark.sql(SETS)


@query(
    "sql_lag_lead",
    """
    SELECT event_id, lag(value) OVER w AS previous_value, lead(value) OVER w AS next_value FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """,
)
def sql_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    df = ordered.neighbour(df, "user_id", ["ts", "event_id"], ["value"], "previous", "p")
    df = ordered.neighbour(df, "user_id", ["ts", "event_id"], ["value"], "next", "n")
    return df.select("event_id", F.col("p.value").alias("previous_value"), F.col("n.value").alias("next_value"))


@query(
    "sql_ranks",
    """
    SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS row_number,
      rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, round(percent_rank() OVER w, 6) AS percent_rank,
      ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS ntile
    FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size DESC)
    """,
)
def sql_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ordered.ranks(table(spark, sf_dir, "part"), "p_brand", "p_size", "p_partkey")
    return ranked.select(
        "p_partkey", "row_number", "rank", "dense_rank", F.round("percent_rank", 6).alias("percent_rank"), "ntile"
    )


@query(
    "sql_running_totals",
    """
    WITH d AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, sum(value) AS v FROM events GROUP BY 1, 2)
    SELECT event_type, day, round(sum(v) OVER (PARTITION BY event_type ORDER BY day), 4) AS running,
      round(avg(v) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS weekly_mean,
      round(sum(v) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW), 4)
        AS three_days
    FROM d
    """,
)
def sql_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    daily = table(spark, sf_dir, "events").groupBy("event_type", day).agg(F.sum("value").alias("v"))
    w = Window.partitionBy("event_type").orderBy("day")
    by_day = Window.partitionBy("event_type").orderBy(F.unix_date(F.to_date("day")))
    return daily.select(
        "event_type", "day",
        F.round(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"),
        F.round(F.avg("v").over(w.rowsBetween(-6, 0)), 4).alias("weekly_mean"),
        F.round(F.sum("v").over(by_day.rangeBetween(-2, 0)), 4).alias("three_days"),
    )


@query(
    "sql_running_rows",
    """
    SELECT event_id, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id), 4) AS running,
      row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS position
    FROM events
    """,
)
def sql_running_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running figures over single rows, safe for a key with very many rows."""
    df = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    df = ordered.running_sum(df, "event_type", ["ts", "event_id"], "value", "running")
    df = ordered.row_position(df, "event_type", ["ts", "event_id"])
    return df.select("event_id", F.round("running", 4).alias("running"), "position")


@query(
    "sql_joins",
    """
    SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS revenue
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2
    """,
)
def sql_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "orders", "customer", "nation", "region")
    return spark.sql("""
        SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS revenue
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
          JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2
    """)


@query(
    "sql_outer_joins",
    """
    SELECT coalesce(c_nationkey, s_nationkey) AS nationkey, coalesce(customers, 0) AS customers,
      coalesce(suppliers, 0) AS suppliers
    FROM (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
    FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey
    """,
)
def sql_outer_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nationkey"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nationkey"))
    both = c.agg(F.count(F.lit(1)).alias("customers")).join(
        s.agg(F.count(F.lit(1)).alias("suppliers")), "nationkey", "full"
    )
    return both.fillna(0, ["customers", "suppliers"])


@query(
    "sql_semi_anti",
    """
    SELECT 'with_orders' AS kind, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer
      WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
    UNION ALL SELECT 'without', count(*), round(sum(c_acctbal), 2) FROM customer
      WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
    """,
)
def sql_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    pending = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    parts = []
    for kind, how in (("with_orders", "left_semi"), ("without", "left_anti")):
        side = customer.join(pending, "c_custkey", how)
        parts.append(side.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")).select(
            F.lit(kind).alias("kind"), "n", "balance"
        ))
    return parts[0].unionByName(parts[1])


@query(
    "sql_range_join",
    """
    SELECT e.event_id, p.p_partkey FROM events e
    JOIN part p ON e.value * 4 >= p.p_retailprice - 899.9 AND e.value * 4 < p.p_retailprice - 899.9 + p.p_size * 0.01
    """,
)
def sql_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").select("event_id", (F.col("value") * 4).alias("at"))
    low = F.col("p_retailprice") - 899.9
    spans = table(spark, sf_dir, "part").select(
        "p_partkey", low.alias("low"), (low + F.col("p_size") * 0.01).alias("high")
    )
    return relational.range_join(points, spans, "at", "low", "high", 1.0).select("event_id", "p_partkey")


@query(
    "sql_as_of_join",
    """
    SELECT c.event_id, v.event_id AS view_id, v.value AS view_value
    FROM (SELECT * FROM events WHERE event_type = 'click') c
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.ts >= v.ts
    """,
)
def sql_as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the last view of the same user before it."""
    events = table(spark, sf_dir, "events")
    clicks = events.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    views = events.filter("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", "ts", "value")
    joined = ordered.as_of_join(clicks, views, "ts", "user_id", ["view_id", "value"], "view_id", "v")
    return joined.select("event_id", F.col("v.view_id").alias("view_id"), F.col("v.value").alias("view_value"))


SUBQUERIES = """
    WITH per_customer AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY 1)
    SELECT c_custkey, round(spent, 2) AS spent,
      (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AS finished
    FROM customer c JOIN per_customer ON c_custkey = o_custkey
    WHERE spent > (SELECT avg(spent) FROM per_customer)
"""


@query("sql_subqueries", SUBQUERIES)
def sql_subqueries(spark: SparkSession, sf_dir: str) -> DataFrame:
    _views(spark, sf_dir, "customer", "orders")
    return spark.sql(SUBQUERIES)


@query(
    "sql_set_operations",
    """
    SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'union_all', count(*) FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'intersect_all', count(*)
      FROM (SELECT c_nationkey FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'except', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'except_all', count(*)
      FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)
    """,
)
def sql_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    results = {
        "union": a.union(b).distinct(), "union_all": a.union(b), "intersect": a.intersect(b),
        "intersect_all": a.intersectAll(b), "except": a.subtract(b), "except_all": a.exceptAll(b),
    }
    out = None
    for op, df in results.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("sql_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def sql_order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return df.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(20)


CASES = """
    SELECT CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'middle' ELSE 'high' END AS class,
      count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS finished FROM orders GROUP BY 1
"""


@query("sql_case_when", f"SELECT class, n, finished::BIGINT AS finished FROM ({CASES})")
def sql_case_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    label = F.when(price < 50000, "low").when(price < 200000, "middle").otherwise("high")
    return table(spark, sf_dir, "orders").groupBy(label.alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("finished")
    )


@query(
    "sql_date_trunc",
    """
    SELECT date_trunc('week', ts)::TIMESTAMP AS week, (max(ts) + INTERVAL 7 DAY)::TIMESTAMP AS due, count(*) AS n
    FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 10 DAY GROUP BY 1
    """,
)
def sql_date_trunc(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = table(spark, sf_dir, "events").filter("ts >= TIMESTAMP_NTZ '2024-01-20 00:00:00' - INTERVAL 10 DAYS")
    return recent.groupBy(F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week")).agg(
        (F.max("ts") + F.expr("INTERVAL 7 DAYS")).alias("due"), F.count(F.lit(1)).alias("n")
    )


@query(
    "sql_safe_arithmetic",
    """
    SELECT l_linenumber, sum(CAST(l_orderkey AS HUGEINT) * 900000000000)::VARCHAR AS big_sum,
      round(sum(l_extendedprice / nullif(l_tax, 0)), 2) AS price_per_tax, count(l_extendedprice / nullif(l_tax, 0)) AS n
    FROM lineitem GROUP BY 1
    """,
)
def sql_safe_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = F.col("l_orderkey").cast("decimal(20,0)") * F.lit(900000000000).cast("decimal(12,0)")
    per_tax = relational.safe_div(F.col("l_extendedprice"), F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(
        relational.safe_sum(big).cast("string").alias("big_sum"),
        F.round(F.sum(per_tax), 2).alias("price_per_tax"), F.count(per_tax).alias("n"),
    )


@query(
    "sql_pivot",
    """
    SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS "F",
      round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS "O",
      round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS "P"
    FROM orders GROUP BY 1
    """,
)
def sql_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.pivot_table(
        table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"],
        F.round(F.sum("o_totalprice"), 2),
    )


@query(
    "sql_unpivot",
    """
    SELECT p_partkey, 'p_size' AS measure, p_size::DOUBLE AS reading FROM part
    UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part
    """,
)
def sql_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double"))
    return relational.unpivot_table(part, "p_partkey", ["p_size", "p_retailprice"], "measure", "reading")


@query(
    "sql_scalar_functions",
    """
    SELECT event_id, upper(substr(event_type, 1, 3)) || '-' || user_id AS code, sqrt(value) AS root,
      ceil(value)::BIGINT AS up, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
      regexp_replace(event_type, '[aeiou]', '_', 'g') AS masked, day(ts)::INTEGER AS day_of_month,
      len(string_split(event_type, 'i'))::INTEGER AS pieces
    FROM events
    """,
)
def sql_scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.upper(F.substring("event_type", 1, 3)), F.lit("-"), "user_id").alias("code"),
        F.sqrt("value").alias("root"), F.ceil("value").alias("up"),
        F.from_json("props", "k int")["k"].alias("k"),
        F.regexp_replace("event_type", "[aeiou]", "_").alias("masked"),
        F.dayofmonth("ts").alias("day_of_month"),
        F.size(F.split("event_type", "i")).alias("pieces"),
    )
