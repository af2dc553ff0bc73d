"""Registered queries for cleaning. The given tables have no nulls, so both sides blank the same cells first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import clean, profile
from plumbline.plans.registry import query, table

HOLES = "(SELECT event_id, event_type, user_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value FROM events)"


def events_with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events; the value of every tenth is blanked."""
    return table(spark, sf_dir, "events").select(
        "event_id", "event_type", "user_id",
        F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("value"),
    )


@query(
    "clean_fill_median",
    f"""
    SELECT event_id, e.event_type, round(coalesce(value, m), 4) AS value
    FROM {HOLES} e JOIN (SELECT event_type, median(value) AS m FROM {HOLES} GROUP BY 1) g ON e.event_type = g.event_type
    """,
)
def clean_fill_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = clean.fill_median(events_with_holes(spark, sf_dir), "value", "event_type")
    return filled.select("event_id", "event_type", F.round("value", 4).alias("value"))


@query(
    "clean_fill_median_whole",
    f"SELECT event_id, round(coalesce(value, (SELECT median(value) FROM {HOLES})), 4) AS value FROM {HOLES}",
)
def clean_fill_median_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = clean.fill_median(events_with_holes(spark, sf_dir), "value")
    return filled.select("event_id", F.round("value", 4).alias("value"))


@query(
    "clean_fill_mode",
    """
    WITH o AS (SELECT o_orderkey, o_orderstatus,
                 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders),
    ranked AS (SELECT o_orderstatus, p, row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, p) AS r
               FROM (SELECT o_orderstatus, p, count(*) AS n FROM o WHERE p IS NOT NULL GROUP BY 1, 2))
    SELECT o.o_orderkey, coalesce(o.p, m.p) AS o_orderpriority
    FROM o JOIN ranked m ON o.o_orderstatus = m.o_orderstatus AND m.r = 1
    """,
)
def clean_fill_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus",
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    return clean.fill_mode(orders, "o_orderpriority", "o_orderstatus").select("o_orderkey", "o_orderpriority")


@query(
    "clean_fill_knn",
    """
    WITH p AS (SELECT p_partkey, p_brand, p_retailprice,
                 CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size END AS s FROM part),
    d AS (SELECT a.p_partkey, b.s, rank() OVER (PARTITION BY a.p_partkey
            ORDER BY abs(a.p_retailprice - b.p_retailprice)) AS r
          FROM p a JOIN p b ON a.p_brand = b.p_brand WHERE a.s IS NULL AND b.s IS NOT NULL)
    SELECT p.p_partkey, round(coalesce(p.s, f.s), 4)::DOUBLE AS p_size
    FROM p LEFT JOIN (SELECT p_partkey, avg(s) AS s FROM d WHERE r <= 5 GROUP BY 1) f USING (p_partkey)
    """,
)
def clean_fill_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", "p_retailprice", F.when(F.col("p_partkey") % 9 != 0, F.col("p_size")).alias("p_size")
    )
    filled = clean.fill_knn(part, "p_size", "p_retailprice", "p_brand", 5)
    return filled.select("p_partkey", F.round(F.col("p_size").cast("double"), 4).alias("p_size"))


@query(
    "clean_fill_knn_features",
    """
    WITH p AS (SELECT p_partkey, p_brand, p_retailprice AS x, (p_partkey * 37 % 1000)::DOUBLE AS y,
                 CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_size END AS s FROM part),
    d AS (SELECT a.p_partkey, b.s, rank() OVER (PARTITION BY a.p_partkey
            ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS r
          FROM p a JOIN p b ON a.p_brand = b.p_brand WHERE a.s IS NULL AND b.s IS NOT NULL)
    SELECT p.p_partkey, round(coalesce(p.s, f.s), 4)::DOUBLE AS p_size
    FROM p LEFT JOIN (SELECT p_partkey, avg(s) AS s FROM d WHERE r <= 5 GROUP BY 1) f USING (p_partkey)
    """,
)
def clean_fill_knn_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By two features, the price and a number derived from the key."""
    part = table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", "p_retailprice", (F.col("p_partkey") * 37 % 1000).alias("other"),
        F.when(F.col("p_partkey") % 9 != 0, F.col("p_size")).alias("p_size"),
    )
    filled = clean.fill_knn(part, "p_size", ["p_retailprice", "other"], "p_brand", 5)
    return filled.select("p_partkey", F.round(F.col("p_size").cast("double"), 4).alias("p_size"))


@query("clean_drop_null_rows", f"SELECT event_id, event_type, value FROM {HOLES} WHERE value IS NOT NULL")
def clean_drop_null_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_null_rows(events_with_holes(spark, sf_dir), ["value", "event_type"]).drop("user_id")


@query("clean_target_rows", f"SELECT count(*) AS kept, round(sum(value), 4) AS total FROM {HOLES} WHERE value IS NOT NULL")
def clean_target_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = clean.clean_target(events_with_holes(spark, sf_dir), "value")
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.round(F.sum("value"), 4).alias("total"))


_FENCE = """
    SELECT e.event_id, e.event_type, e.value FROM {src} e {join}
    WHERE e.value IS NULL OR e.value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)
"""


@query(
    "clean_outliers_iqr",
    f"WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {HOLES} "
    "GROUP BY 1)" + _FENCE.format(src=HOLES, join="JOIN q ON e.event_type = q.event_type"),
)
def clean_outliers_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.remove_outliers_iqr(events_with_holes(spark, sf_dir), "value", "event_type").drop("user_id")


@query(
    "clean_outliers_iqr_whole",
    f"WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {HOLES})"
    + _FENCE.format(src=HOLES, join="CROSS JOIN q"),
)
def clean_outliers_iqr_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.remove_outliers_iqr(events_with_holes(spark, sf_dir), "value").drop("user_id")


@query(
    "clean_outliers_z",
    f"""
    SELECT e.event_id, e.value FROM {HOLES} e
    JOIN (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM {HOLES} GROUP BY 1) g
      ON e.event_type = g.event_type
    WHERE NOT coalesce(abs(value - m) > 3 * s, false)
    """,
)
def clean_outliers_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.remove_outliers_z(events_with_holes(spark, sf_dir), "value", "event_type").select("event_id", "value")


@query(
    "clean_normalize",
    """
    SELECT c_custkey, round((c_acctbal - lo) / nullif(hi - lo, 0), 6) AS by_range,
      round((c_acctbal - m) / nullif(s, 0), 6) AS by_deviation
    FROM customer c JOIN (SELECT c_mktsegment, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer GROUP BY 1) g
      ON c.c_mktsegment = g.c_mktsegment
    CROSS JOIN (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
    """,
)
def clean_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_mktsegment", F.col("c_acctbal").alias("by_range"), F.col("c_acctbal").alias("by_deviation")
    )
    scaled = clean.normalize(clean.normalize(df, "by_range"), "by_deviation", "z", "c_mktsegment")
    return scaled.select("c_custkey", F.round("by_range", 6).alias("by_range"), F.round("by_deviation", 6).alias("by_deviation"))


@query(
    "clean_cast_numeric",
    """
    SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN NULL
      WHEN c_nationkey < 10 THEN round(floor(c_acctbal / 100) / 10 * 1000, 2)
      ELSE round(c_acctbal, 2) END AS amount
    FROM customer
    """,
)
def clean_cast_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances written as ``N/A``, ``1.2K`` and ``$1,234.00`` come back as numbers."""
    bal = F.col("c_acctbal")
    text = (
        F.when(F.col("c_nationkey") < 5, "N/A")
        .when(F.col("c_nationkey") < 10, F.concat(F.format_number(F.floor(bal / 100) / 10, 1), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), F.format_number(bal, 2)))
    )
    messy = table(spark, sf_dir, "customer").select("c_custkey", text.alias("amount"))
    cast = clean.cast_numeric(messy, "amount")
    return cast.select("c_custkey", F.round("amount", 2).alias("amount"))


@query(
    "clean_cast_boolean",
    """
    SELECT event_id, CASE event_type WHEN 'view' THEN true WHEN 'click' THEN true WHEN 'signup' THEN true
      WHEN 'error' THEN false ELSE NULL END AS is_active
    FROM events
    """,
)
def clean_cast_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.create_map(*[
        F.lit(x) for pair in (("view", " TRUE"), ("click", "yes"), ("signup", "1"), ("error", "False"), ("purchase", ""))
        for x in pair
    ])
    messy = table(spark, sf_dir, "events").select("event_id", text[F.col("event_type")].alias("is_active"))
    return clean.cast_boolean(messy, "is_active")


@query(
    "clean_parse_currency",
    """
    SELECT o_orderkey, o_totalprice AS amount,
      CASE o_orderstatus WHEN 'O' THEN 'USD' WHEN 'F' THEN 'EUR' ELSE 'INR' END AS currency
    FROM orders
    """,
)
def clean_parse_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = F.format_number("o_totalprice", 2)
    text = (
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("$"), money))
        .when(F.col("o_orderstatus") == "F", F.concat(money, F.lit(" €")))
        .otherwise(F.concat(F.lit("INR "), money))
    )
    messy = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("price"))
    return clean.parse_currency(messy, "price").drop("price")


@query("clean_drop_sparse_columns", "SELECT event_id, event_type FROM events")
def clean_drop_sparse_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.when(F.col("event_type") == "view", F.col("value")).alias("mostly_empty")
    )
    return clean.drop_sparse_columns(df, profile.profile_columns(df, exact=False))


@query(
    "clean_deduplicate_latest",
    """
    SELECT event_id, ts, user_id, event_type, value, props FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
    """,
)
def clean_deduplicate_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.deduplicate(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"])


@query("clean_deduplicate_exact", "SELECT DISTINCT text, lang, source FROM documents")
def clean_deduplicate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.deduplicate(table(spark, sf_dir, "documents").select("text", "lang", "source"))


@query(
    "clean_trim_text",
    """
    SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS segment, c_name AS name
    FROM customer
    """,
)
def clean_trim_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") == "BUILDING", " \t ").otherwise(F.concat(F.lit("  "), "c_mktsegment")).alias("segment"),
        F.concat("c_name", F.lit(" \n")).alias("name"),
    )
    return clean.trim_text(padded, ["segment", "name"])


@query(
    "clean_parse_dates",
    """
    SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_day
    FROM orders
    """,
)
def clean_parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same dates in four spellings (and one that is none) parse to one form."""
    d, kind = F.col("o_orderdate"), F.substring("o_orderpriority", 1, 1)
    text = (
        F.when(kind == "1", F.date_format(d, "yyyy-MM-dd"))
        .when(kind == "2", F.date_format(d, "dd/MM/yyyy"))
        .when(kind == "3", F.date_format(d, "MMM d, yyyy"))
        .when(kind == "4", F.date_format(d, "yyyyMMdd"))
        .otherwise("unknown")
    )
    messy = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("order_day"))
    parsed = clean.parse_dates(messy, "order_day", ["yyyy-MM-dd", "dd/MM/yyyy", "MMM d, yyyy", "yyyyMMdd"])
    return parsed.withColumn("order_day", F.date_format("order_day", "yyyy-MM-dd"))


@query(
    "clean_log",
    f"""
    WITH b AS (SELECT count(*) AS n, count(*) - count(value) AS nulls FROM {HOLES})
    SELECT 'value' AS "column", 'fill_null' AS operation, 'median' AS strategy, nulls AS rows_affected,
      nulls AS before_nulls, 0::BIGINT AS after_nulls, 'numeric' AS rationale, true AS is_consistent FROM b
    """,
)
def clean_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = events_with_holes(spark, sf_dir)
    after = clean.fill_median(before, "value", "event_type")
    op = {"column": "value", "operation": "fill_null", "strategy": "median", "rationale": "numeric"}
    return clean.cleaning_log(before, after, [op])


@query(
    "clean_plan",
    f"""
    WITH s AS (SELECT (count(*) - count(value)) / count(*) AS nulls, skewness(value) AS sk,
                 skewness(user_id) AS sku FROM {HOLES})
    SELECT 'value' AS "column", 'fill_null' AS operation, 'median' AS strategy FROM s WHERE nulls BETWEEN 0.02 AND 0.15
    UNION ALL SELECT 'value', 'remove_outlier', CASE WHEN abs(sk) < 1 THEN 'iqr' ELSE 'z_score' END FROM s
    UNION ALL SELECT 'user_id', 'remove_outlier', CASE WHEN abs(sku) < 1 THEN 'iqr' ELSE 'z_score' END FROM s
    """,
)
def clean_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events_with_holes(spark, sf_dir)
    steps = clean.plan_cleaning(profile.profile_columns(df), clean.column_skewness(df))
    return steps.select("column", "operation", "strategy")


@query(
    "clean_quality_score",
    """
    WITH t AS (SELECT user_id, event_type, CASE WHEN event_id % 10 = 0 THEN 'N/A' ELSE value::VARCHAR END AS value,
                 CASE WHEN event_id % 4 = 0 THEN NULL ELSE props END AS props FROM events),
    s AS (SELECT (count(user_id) + count(event_type) + count(value) + count(props)) / (4 * count(*)) AS c,
            (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) / count(*) AS u,
            (count(user_id) + count(try_cast(value AS DOUBLE))) / (count(user_id) + count(value)) AS y FROM t)
    SELECT round(c, 6) AS completeness, round(u, 6) AS uniqueness, round(y, 6) AS type_consistency,
      round(0.5 * c + 0.25 * u + 0.25 * y, 6) AS quality FROM s
    """,
)
def clean_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select(
        "user_id", "event_type",
        F.when(F.col("event_id") % 10 == 0, "N/A").otherwise(F.col("value").cast("string")).alias("value"),
        F.when(F.col("event_id") % 4 != 0, F.col("props")).alias("props"),
    )
    scores = clean.quality_score(df, {"user_id": "bigint", "value": "double"})
    return scores.select(*[F.round(c, 6).alias(c) for c in scores.columns])


@query(
    "clean_repair_encoding",
    """
    SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS text,
      lang IN ('de', 'fr') AND regexp_matches(text, '[^\\x00-\\x7F]') AND NOT regexp_matches(text, '[^\\x00-\\xFF]')
        AS was_repaired
    FROM documents
    """,
)
def clean_repair_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German and French texts stored as Latin-1, the rest as UTF-8 with a mark and CRLF line ends."""
    fits = ~F.col("text").rlike("[^\\x{00}-\\x{FF}]") & F.col("lang").isin("de", "fr")
    marked = F.concat(F.lit("﻿"), F.regexp_replace("text", "\r?\n", "\r\n"))
    raw = F.when(fits, F.encode("text", "ISO-8859-1")).otherwise(F.encode(marked, "UTF-8"))
    stored = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    return clean.repair_encoding(stored, "raw").drop("raw")


@query(
    "clean_quarantine",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, array_to_string(list_filter([
        CASE WHEN l_quantity < 2 THEN 'tiny' END, CASE WHEN l_extendedprice > 90000 THEN 'huge' END,
        CASE WHEN l_discount < 0 THEN 'negative' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM lineitem WHERE l_quantity < 2 OR l_extendedprice > 90000 OR l_discount < 0
    """,
)
def clean_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"tiny": "l_quantity < 2", "huge": "l_extendedprice > 90000", "negative": "l_discount < 0"}
    marked = clean.quarantine(table(spark, sf_dir, "lineitem"), rules)
    return clean.rejected(marked).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.array_join("reasons", ",").alias("reasons")
    )


@query(
    "clean_sanitize_columns",
    "SELECT c_custkey AS customer_key, c_name AS name, c_acctbal AS account_balance, c_mktsegment AS name_2 FROM customer",
)
def clean_sanitize_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("Customer Key"), F.col("c_name").alias("Name"),
        F.col("c_acctbal").alias("accountBalance"), F.col("c_mktsegment").alias("name!"),
    )
    return clean.sanitize_columns(odd)[0]
