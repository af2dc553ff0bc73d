"""Registered streaming queries: each drains the events table as a stream and returns what it stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.registry import query, table
from plumbline.plans.run_queries import LIMITS, STATUS, _usage, limits
from plumbline.session import shared_folder
from plumbline.streaming import streams


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return streams.stream_events(spark, sf_dir, schema, "events.parquet")


def _drain(spark: SparkSession, sdf: DataFrame, mode: str = "complete") -> DataFrame:
    folder = shared_folder(spark, "stream")
    streams.stream_snapshots(sdf, f"{folder}/out", f"{folder}/checkpoint", mode).awaitTermination()
    return streams.last_snapshot(spark, f"{folder}/out")


def _newest(spark: SparkSession, sdf: DataFrame, keys: list[str]) -> DataFrame:
    folder = shared_folder(spark, "upserts")
    streams.stream_upserts(sdf, f"{folder}/out", f"{folder}/checkpoint", keys).awaitTermination()
    return streams.newest_rows(spark, f"{folder}/out", keys)


@query(
    "stream_latest_status",
    """
    SELECT session_id, arg_max(status, (ts, event_id)) AS status, coalesce(arg_max(
        CASE status WHEN 'routing' THEN 0 WHEN 'ingesting' THEN 1 WHEN 'cleaning' THEN 2 WHEN 'complete' THEN 6 END,
        (ts, event_id)) FILTER (status <> 'failed'), 0)::INTEGER AS step
    FROM (SELECT event_id, ts, user_id AS session_id, CASE event_type WHEN 'view' THEN 'routing' WHEN 'click' THEN 'ingesting'
       WHEN 'signup' THEN 'cleaning' WHEN 'purchase' THEN 'complete' ELSE 'failed' END AS status FROM events) GROUP BY 1
    """,
)
def stream_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    sdf = _stream(spark, sf_dir).select(
        "event_id", "ts", F.col("user_id").alias("session_id"), names[F.col("event_type")].alias("status")
    )
    return _newest(spark, streams.stream_latest_status(sdf, "session_id", "status", ["ts", "event_id"]), ["session_id"])


@query(
    "stream_terminal",
    """
    SELECT event_id, user_id, event_type FROM (
      SELECT *, min(CASE WHEN event_type = 'purchase' THEN (ts, event_id) END) OVER (PARTITION BY user_id) AS stop FROM events)
    WHERE stop IS NULL OR (ts, event_id) <= stop
    """,
)
def stream_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "terminal")
    streams.stream_terminal(
        _stream(spark, sf_dir), f"{folder}/out", f"{folder}/checkpoint", "user_id", "event_type", ["ts", "event_id"],
        ("purchase",),
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/out/events").select("event_id", "user_id", "event_type")


@query(
    "stream_tumbling",
    """
    SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total
    FROM events GROUP BY 1, 2
    """,
)
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = streams.stream_metrics(_stream(spark, sf_dir), "ts", "1 day", None, "2 hours", "event_type", "value")
    out = _newest(spark, daily, ["window_start", "event_type"])
    return out.select(
        streams.as_stored(F.col("window_start")).alias("window_start"), "event_type", "n", F.round("total", 4).alias("total")
    )


@query(
    "stream_sliding",
    """
    SELECT (time_bucket(INTERVAL 6 HOUR, ts) - s * INTERVAL 6 HOUR)::TIMESTAMP AS window_start, count(*) AS n
    FROM events, (SELECT unnest(range(4)) AS s) GROUP BY 1
    """,
)
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _newest(spark, streams.stream_metrics(_stream(spark, sf_dir), "ts", "24 hours", "6 hours", "2 hours"), ["window_start"])
    return out.select(streams.as_stored(F.col("window_start")).alias("window_start"), "n")


@query(
    "stream_sessions",
    """
    WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s
               FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
    SELECT user_id, min(ts) AS session_start, (max(ts) + INTERVAL 30 MINUTE)::TIMESTAMP AS session_end, count(*) AS n,
      round(sum(value), 4) AS total
    FROM i GROUP BY user_id, sid
    """,
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _drain(spark, streams.stream_sessions(_stream(spark, sf_dir), "ts", "user_id", "30 minutes", "1 hour", "value"))
    return out.select(
        "user_id", streams.as_stored(F.col("session_start")).alias("session_start"),
        streams.as_stored(F.col("session_end")).alias("session_end"), "n", F.round("total", 4).alias("total"),
    )


@query(
    "stream_first_in_ttl",
    """
    WITH RECURSIVE kept AS (
      SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY 1, 2
      UNION ALL
      SELECT k.user_id, k.event_type, min(e.ts) AS ts
      FROM kept k JOIN events e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.ts > k.ts + INTERVAL 24 HOUR
      GROUP BY k.user_id, k.event_type, k.ts)
    SELECT user_id, event_type, ts FROM kept
    """,
)
def stream_first_in_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "first")
    first = streams.stream_first_in_ttl(_stream(spark, sf_dir), ["user_id", "event_type"], "ts", "24 hours")
    streams.stream_to_table(first, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.select("user_id", "event_type", streams.as_stored(F.col("ts")).alias("ts"))


@query("stream_to_table", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def stream_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "append")
    streams.stream_to_table(_stream(spark, sf_dir), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").withColumn("ts", streams.as_stored(F.col("ts")))


@query(
    "stream_budget_alerts",
    f"""
    SELECT u.day, u.provider AS event_type, round(used, 4) AS used, round(daily_limit, 4) AS daily_limit
    FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type AS provider, sum(value) AS used FROM events GROUP BY 1, 2) u
    JOIN {LIMITS} l ON u.provider = l.provider WHERE used >= 0.95 * daily_limit
    """,
)
def stream_budget_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_provider = limits(_usage(spark, sf_dir))
    alerts = streams.stream_budget_alerts(_stream(spark, sf_dir), "ts", "event_type", "value", per_provider)
    out = _newest(spark, alerts, ["day", "event_type"])
    return out.select(
        streams.as_stored(F.col("day")).alias("day"), "event_type", F.round("used", 4).alias("used"),
        F.round("daily_limit", 4).alias("daily_limit"),
    )
