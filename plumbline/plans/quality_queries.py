"""Registered queries for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import clean, profile, quality
from plumbline.operators.quality import Rule
from plumbline.plans.cleaning_queries import HOLES, events_with_holes
from plumbline.plans.profile_queries import COLUMNS
from plumbline.plans.registry import query, table


@query(
    "quality_expectations",
    """
    WITH j AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT count(*) AS n FROM j),
    f AS (
      SELECT 'quantity_range' AS rule, count(*) FILTER (l_quantity < 1 OR l_quantity > 45) AS failing FROM j
      UNION ALL SELECT 'flag_allowed', count(*) FILTER (l_returnflag NOT IN ('A', 'R')) FROM j
      UNION ALL SELECT 'price_present', count(*) FILTER (l_extendedprice IS NULL) FROM j
      UNION ALL SELECT 'ships_after_order', count(*) FILTER (l_shipdate < o_orderdate) FROM j
      UNION ALL SELECT 'order_unique', coalesce(sum(k) FILTER (k > 1), 0)::BIGINT
        FROM (SELECT l_orderkey, count(*) AS k FROM j GROUP BY 1))
    SELECT rule, failing, round(failing / n, 6) AS share, failing = 0 AS passed FROM f, n
    """,
)
def quality_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    checked = quality.check_expectations(joined, [
        Rule("quantity_range", "range", "l_quantity", low=1, high=45),
        Rule("flag_allowed", "allowed", "l_returnflag", values=("A", "R")),
        Rule("price_present", "not_null", "l_extendedprice"),
        Rule("ships_after_order", "ordered", "o_orderdate", later="l_shipdate"),
        Rule("order_unique", "unique", "l_orderkey"),
    ])
    return checked.withColumn("share", F.round("share", 6))


@query(
    "quality_completeness",
    f"""
    SELECT count(event_id) + count(event_type) + count(user_id) + count(value) AS filled_cells, 4 * count(*) AS all_cells,
      round((count(event_id) + count(event_type) + count(user_id) + count(value)) / (4 * count(*)), 6) AS completeness
    FROM {HOLES}
    """,
)
def quality_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.completeness(events_with_holes(spark, sf_dir))
    return done.withColumn("completeness", F.round("completeness", 6))


@query(
    "quality_approval",
    """
    SELECT doc_id, CASE WHEN contains(lower(text), 'the') OR n_chars % 100 / 100 < 0.4 THEN 'rejected'
      WHEN n_chars % 37 / 37 >= 0.75 THEN 'approved' ELSE 'needs_review' END AS approval_status
    FROM documents
    """,
)
def quality_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "documents").select(
        "doc_id", ((F.col("n_chars") % 100) / 100).alias("quality"), ((F.col("n_chars") % 37) / 37).alias("confidence"),
        F.lower("text").contains("the").alias("injection"),
    )
    return quality.approve(scores, "confidence", "quality", "injection").select("doc_id", "approval_status")


_RUNS = """
    SELECT user_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'partial' ELSE 'success' END AS status,
      value AS quality, value / 10 AS elapsed, ts FROM events
"""


@query(
    "quality_gauntlet",
    f"""
    WITH r AS ({_RUNS}),
    a AS (SELECT user_id AS dataset, count(*) AS n, avg((status = 'success')::INTEGER) AS p, avg(quality) AS q,
            sum(elapsed) AS e FROM r WHERE ts >= '2024-01-16' GROUP BY 1),
    b AS (SELECT user_id AS dataset, count(*) AS n, avg((status = 'success')::INTEGER) AS p FROM r
          WHERE ts < '2024-01-16' GROUP BY 1)
    SELECT coalesce(a.dataset, b.dataset) AS dataset, coalesce(a.n, 0) AS runs, coalesce(b.n, 0) AS runs_before,
      round(q, 6) AS quality, round(e, 4) AS elapsed, round(a.p, 6) AS pass_rate, round(b.p, 6) AS pass_rate_before,
      round(a.p - b.p, 6) AS pass_rate_change, coalesce(a.p < b.p, false) AS is_regression
    FROM a FULL JOIN b ON a.dataset = b.dataset
    """,
)
def quality_gauntlet(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "partial")
    runs = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("dataset"), status.otherwise("success").alias("status"), F.col("value").alias("quality"),
        (F.col("value") / 10).alias("elapsed"), "ts",
    )
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    report = quality.gauntlet_report(runs.filter(F.col("ts") >= cut), runs.filter(F.col("ts") < cut))
    places = {"quality": 6, "elapsed": 4, "pass_rate": 6, "pass_rate_before": 6, "pass_rate_change": 6}
    return report.withColumns({c: F.round(c, p) for c, p in places.items()})


@query(
    "quality_invariants",
    " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, count(*) AS violations FROM (SELECT {checks}) WHERE bad"
        for rule, checks in (
            ("null_pct_range", "unnest([" + ", ".join(
                f"(SELECT (count(*) - count({c})) / count(*) NOT BETWEEN 0 AND 1 FROM orders)" for c, _ in COLUMNS["orders"]
            ) + "]) AS bad"),
            ("unique_pct_range", "unnest([" + ", ".join(
                f"(SELECT count(DISTINCT {c}) / count(*) NOT BETWEEN 0 AND 1 FROM orders)" for c, _ in COLUMNS["orders"]
            ) + "]) AS bad"),
            ("sample_count", "false AS bad"),
            ("nulls_grew", f"(SELECT count(*) - count(value) < 0 FROM {HOLES}) AS bad"),
        )
    ),
)
def quality_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = events_with_holes(spark, sf_dir)
    op = {"column": "value", "operation": "fill_null", "strategy": "median", "rationale": ""}
    log = clean.cleaning_log(before, clean.fill_median(before, "value"), [op])
    prof = profile.profile_columns(table(spark, sf_dir, "orders"), order_by="o_orderkey")
    return quality.check_invariants(prof, log)
