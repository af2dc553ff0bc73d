"""Registered queries for run, usage and access tables. ``events`` plays the run log:
user_id is the session or user, event_type the status or provider, value the tokens or seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import runs
from plumbline.plans.registry import query, table

STATUS = {"view": "routing", "click": "ingesting", "signup": "cleaning", "purchase": "complete", "error": "failed"}


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").alias("session_id"), names[F.col("event_type")].alias("status"), "value", "props"
    )


LOG = """
    (SELECT event_id, ts, user_id AS session_id, CASE event_type WHEN 'view' THEN 'routing' WHEN 'click' THEN 'ingesting'
       WHEN 'signup' THEN 'cleaning' WHEN 'purchase' THEN 'complete' ELSE 'failed' END AS status, value, props FROM events)
"""


def limits(df: DataFrame) -> DataFrame:
    """A daily limit per provider, derived from the data: nine tenths of its largest daily sum."""
    return df.groupBy("provider").agg((F.max("used") * 0.9).alias("daily_limit"))


USAGE = """
    (SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type AS provider, sum(value) AS used FROM events GROUP BY 1, 2)
"""
LIMITS = f"(SELECT provider, max(used) * 0.9 AS daily_limit FROM {USAGE} GROUP BY 1)"


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.daily_usage(table(spark, sf_dir, "events"), "ts", "event_type", "value")


@query(
    "run_latest_checkpoint",
    f"SELECT * FROM {LOG} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) = 1",
)
def run_latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.latest_checkpoint(run_log(spark, sf_dir), "session_id", ["ts", "event_id"])


@query(
    "run_latest_status",
    f"""
    SELECT session_id, arg_max(status, (ts, event_id)) AS status, coalesce(arg_max(
        CASE status WHEN 'routing' THEN 0 WHEN 'ingesting' THEN 1 WHEN 'cleaning' THEN 2 WHEN 'complete' THEN 6 END,
        (ts, event_id)) FILTER (status <> 'failed'), 0)::INTEGER AS step,
      arg_max(props, (ts, event_id)) FILTER (status = 'failed') AS error,
      arg_max(status, (ts, event_id)) = 'complete' AS is_complete
    FROM {LOG} GROUP BY 1
    """,
)
def run_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.latest_status(run_log(spark, sf_dir), "session_id", "status", ["ts", "event_id"], message="props")


@query("run_daily_usage", f"SELECT day, provider, round(used, 4) AS used FROM {USAGE}")
def run_daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usage(spark, sf_dir).withColumn("used", F.round("used", 4))


@query(
    "run_budget_status",
    f"""
    SELECT u.day, u.provider, round(used, 4) AS used, round(daily_limit, 4) AS daily_limit,
      round(100 * used / daily_limit, 4) AS used_pct, round(greatest(daily_limit - used, 0), 4) AS remaining,
      used >= 0.95 * daily_limit AS is_exhausted
    FROM {USAGE} u JOIN {LIMITS} l ON u.provider = l.provider
    """,
)
def run_budget_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = _usage(spark, sf_dir)
    status = runs.budget_status(usage, limits(usage))
    return status.withColumns({c: F.round(c, 4) for c in ("used", "daily_limit", "used_pct", "remaining")})


@query(
    "run_remaining_runs",
    f"""
    SELECT d.day, min(greatest(0, floor((daily_limit - coalesce(used, 0)) / tokens_per_run)))::BIGINT AS remaining_runs
    FROM (SELECT DISTINCT day FROM {USAGE}) d CROSS JOIN {LIMITS} l
    JOIN (SELECT event_type AS provider, avg(value) AS tokens_per_run FROM events GROUP BY 1) a ON l.provider = a.provider
    LEFT JOIN {USAGE} u ON u.day = d.day AND u.provider = l.provider
    GROUP BY 1
    """,
)
def run_remaining_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = _usage(spark, sf_dir)
    per_run = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("provider")).agg(
        F.avg("value").alias("tokens_per_run")
    )
    return runs.remaining_runs(usage, limits(usage), per_run)


@query(
    "run_quota",
    """
    SELECT event_id, user_id, run_of_day, run_of_day <= 3 AS is_allowed,
      CASE WHEN run_of_day > 3 THEN (date_trunc('day', ts) + INTERVAL 1 DAY)::TIMESTAMP END AS resets_at
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS run_of_day
          FROM events)
    """,
)
def run_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = runs.apply_quota(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    return marked.select("event_id", "user_id", "run_of_day", "is_allowed", "resets_at")


@query(
    "run_pick_provider",
    f"""
    WITH c AS (SELECT task, provider, row_number() OVER (PARTITION BY task ORDER BY md5(task || provider)) AS priority,
                 daily_limit FROM (SELECT DISTINCT o_orderpriority AS task FROM orders) CROSS JOIN {LIMITS}),
    r AS (SELECT o_orderkey AS request_id, o_orderpriority AS task,
            TIMESTAMP '2024-01-01' + to_days((o_orderkey % 30)::INTEGER) AS day FROM orders),
    o AS (SELECT request_id, c.provider, c.priority FROM r JOIN c ON r.task = c.task
          LEFT JOIN {USAGE} u ON u.day = r.day AND u.provider = c.provider
          WHERE coalesce(used, 0) < 0.95 * daily_limit)
    SELECT r.request_id, arg_min(o.provider, o.priority) AS chosen_provider
    FROM r LEFT JOIN o ON r.request_id = o.request_id GROUP BY 1
    """,
)
def run_pick_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, usage = table(spark, sf_dir, "orders"), _usage(spark, sf_dir)
    day = F.timestamp_add("DAY", (F.col("o_orderkey") % 30).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    requests = orders.select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderpriority").alias("task"), day.cast("timestamp_ntz").alias("day")
    )
    configs = _provider_configs(orders, limits(usage))
    return runs.pick_provider(requests, configs, usage).select("request_id", "chosen_provider")


def _provider_configs(orders: DataFrame, provider_limits: DataFrame) -> DataFrame:
    """Every task may use every provider; the order of preference follows a digest of both names."""
    providers = provider_limits.select(F.struct("provider", "daily_limit").alias("p"))
    known = F.array_sort(F.collect_set("p"))  # the providers are few and fixed
    options = orders.select("o_orderpriority").distinct().select(
        F.col("o_orderpriority").alias("task"), F.explode(providers.agg(known).scalar()).alias("p")
    ).select("task", "p.*")
    return options.withColumn("priority", F.md5(F.concat("task", "provider").cast("binary")))


@query(
    "run_metrics",
    """
    WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'complete' END AS status,
                 'p' || user_id % 4 AS provider, json_extract_string(props, '$.k')::DOUBLE AS k,
                 CASE WHEN value <= 5 THEN '5' WHEN value <= 50 THEN '50' ELSE 'inf' END AS bucket FROM events)
    SELECT 'runs' AS metric, status AS label, count(*)::DOUBLE AS value FROM e GROUP BY 2
    UNION ALL SELECT 'tokens', provider, sum(k) FROM e GROUP BY 2
    UNION ALL SELECT 'duration', event_type || ':le_' || bucket, count(*)::DOUBLE FROM e GROUP BY 2
    UNION ALL SELECT 'mean_quality', 'all', round(avg(k / 100), 6) FROM e
    """,
)
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k double")["k"]
    df = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "error", "failed").otherwise("complete").alias("status"),
        F.concat(F.lit("p"), F.col("user_id") % 4).alias("provider"), "event_type", k.alias("k"), "value",
        (k / 100).alias("quality"),
    )
    metrics = runs.run_metrics(df, "status", "provider", "event_type", "k", "value", "quality", [5, 50])
    return metrics.withColumn("value", F.round("value", 6))


@query(
    "run_failure_reasons",
    "SELECT props AS reason, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10",
)
def run_failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.failure_reasons(table(spark, sf_dir, "events"), "event_type", "props", 10, "error")


@query(
    "run_account_usage",
    "SELECT user_id, count(*) AS runs, round(sum(value), 4) AS amount, max(ts) AS last_run FROM events GROUP BY 1",
)
def run_account_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = runs.account_usage(table(spark, sf_dir, "events"), "user_id", "ts", "value")
    return used.withColumn("amount", F.round("amount", 4))


@query(
    "run_visible_rows",
    """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders
    WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')
    """,
)
def run_visible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are children of customers; the market segment plays the owner."""
    return runs.visible_children(
        table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", "BUILDING"
    ).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "run_cache_hits",
    """
    SELECT event_id, coalesce(ts <= lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)
      + INTERVAL 24 HOUR, false) AS is_hit FROM events
    """,
)
def run_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = runs.cache_hits(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id")
    return hits.select("event_id", "is_hit")


@query("run_state_fields", "SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def run_state_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    return runs.explode_state(df, "props", "k bigint")


@query(
    "run_usage_per_session",
    """
    WITH s AS (SELECT user_id, sum(value) AS t FROM events GROUP BY 1)
    SELECT count(*) AS sessions, round(avg(t), 4) AS mean_tokens, round(quantile_cont(t, 0.95), 4) AS p95_tokens,
      round(avg(t) * 0.002, 6) AS mean_cost, floor(1000000 / avg(t))::BIGINT AS daily_capacity FROM s
    """,
)
def run_usage_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = runs.usage_per_session(table(spark, sf_dir, "events"), "user_id", "value", 0.002, 1_000_000)
    places = {"mean_tokens": 4, "p95_tokens": 4, "mean_cost": 6}
    return used.withColumns({c: F.round(c, p) for c, p in places.items()})


@query(
    "run_stage_durations",
    f"""
    SELECT event_id, status, lead(status) OVER w AS next_status,
      (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1000000 AS seconds
    FROM {LOG} WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)
    """,
)
def run_stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = runs.stage_durations(run_log(spark, sf_dir), "session_id", "status", "ts", "event_id")
    return spans.select("event_id", "status", "next_status", "seconds")
