"""Tables of runs, usage and access."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.fixed_values import EXHAUSTED_AT, RUNS_PER_DAY, STATUS_STEPS
from plumbline.functions.frames import as_list, col, one_row
from plumbline.operators.ordered import ROWS_PER_CHUNK, neighbour, row_position
from plumbline.operators.quantiles import wide_quantiles


def _key(order: Sequence[str]) -> Column:
    return F.struct(*[col(c) for c in order])


def latest_checkpoint(df: DataFrame, session: str, order: Sequence[str]) -> DataFrame:
    """The newest row per session; an aggregation, so a session with very many rows is no hot spot."""
    newest = df.groupBy(col(session)).agg(
        F.max_by(F.struct(*[col(c) for c in df.columns]), _key(order)).alias("_row")
    )
    return newest.select("_row.*")


def step_of(status: Column, step_map: dict[str, int]) -> Column:
    pairs = [F.lit(x) for pair in step_map.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), status)


def latest_status(
    df: DataFrame, session: str, status: str, order: Sequence[str], step_map: dict[str, int] | None = None,
    message: str | None = None,
) -> DataFrame:
    """Per session the last status, the step of the last known status, and the message of the last failure."""
    step = step_of(col(status), step_map or STATUS_STEPS)
    key = _key(order)
    failed = F.when(col(status) == "failed", key)
    told = col(message) if message else F.lit(None).cast("string")
    return df.groupBy(col(session)).agg(
        F.max_by(col(status), key).alias("status"),
        F.coalesce(F.max_by(step, F.when(step.isNotNull(), key)), F.lit(0)).alias("step"),
        F.max_by(told, failed).alias("error"),
    ).withColumn("is_complete", F.col("status") == "complete")


def daily_usage(df: DataFrame, ts: str, provider: str, amount: str) -> DataFrame:
    """Tokens per provider and UTC day."""
    day = F.date_trunc("day", col(ts)).cast("timestamp_ntz")
    return df.groupBy(day.alias("day"), col(provider).alias("provider")).agg(F.sum(col(amount)).alias("used"))


def budget_status(usage: DataFrame, limits: DataFrame) -> DataFrame:
    """Usage against ``daily_limit`` (NULL: unlimited); a provider counts as exhausted at 95 %."""
    limit = F.col("daily_limit")
    return usage.join(limits, "provider", "left").withColumns({
        "used_pct": F.try_divide(F.col("used") * 100.0, limit),
        "remaining": F.when(limit.isNotNull(), F.greatest(limit - F.col("used"), F.lit(0.0))),
        "is_exhausted": F.coalesce(F.col("used") >= limit * EXHAUSTED_AT, F.lit(False)),
    })


def remaining_runs(usage: DataFrame, limits: DataFrame, per_run: DataFrame) -> DataFrame:
    """How many more runs each day's budget allows: the tightest provider decides, used that day or not.

    ``limits`` has provider and daily_limit (NULL: unlimited), ``per_run`` provider and tokens_per_run; both are
    configuration tables, a row per provider, which each day of ``usage`` is expanded by.
    """
    config = limits.join(per_run, "provider").agg(
        F.collect_list(F.struct("provider", "daily_limit", "tokens_per_run")).alias("providers")
    )
    days = usage.select("day").distinct().select("day", F.inline(one_row(config)["providers"]))
    left = days.join(usage, ["day", "provider"], "left")
    used = F.coalesce("used", F.lit(0))
    runs = F.floor(F.try_divide(F.col("daily_limit") - used, F.col("tokens_per_run")))
    return left.groupBy("day").agg(F.min(F.when(runs.isNotNull(), F.greatest(F.lit(0), runs))).cast("bigint").alias("remaining_runs"))


def apply_quota(
    df: DataFrame, user: str, ts: str, key: str, n: int = RUNS_PER_DAY, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Mark each run as allowed (the first ``n`` of a user's day) or refused, with the moment the count resets."""
    day = F.date_trunc("day", col(ts)).cast("timestamp_ntz")
    placed = row_position(df.withColumn("_day", day), [user, "_day"], [ts, key], "run_of_day", rows_per_chunk)
    allowed = F.col("run_of_day") <= n
    return placed.withColumns({
        "is_allowed": allowed, "resets_at": F.when(~allowed, F.col("_day") + F.expr("INTERVAL 1 DAY")),
    }).drop("_day")


def pick_provider(requests: DataFrame, configs: DataFrame, usage: DataFrame) -> DataFrame:
    """For every request the provider of best priority for its task that is not exhausted that day (NULL limit: never).

    ``requests``: request_id, task, day; ``configs``: task, provider, priority, daily_limit; ``usage``: day, provider, used.
    The choice is made once per task and day and then looked up by the requests.
    """
    days = requests.select("task", "day").distinct()
    options = days.join(configs, "task").join(usage, ["day", "provider"], "left")
    exhausted = F.coalesce(F.col("used"), F.lit(0)) >= F.col("daily_limit") * EXHAUSTED_AT
    free = options.filter(~F.coalesce(exhausted, F.lit(False)))
    choice = free.groupBy("task", "day").agg(
        F.min_by("provider", F.struct("priority", "provider")).alias("chosen_provider")
    )
    return requests.join(choice, ["task", "day"], "left")


def run_metrics(
    df: DataFrame, status: str, provider: str, stage: str, tokens: str, seconds: str, quality: str,
    edges: Sequence[float],
) -> DataFrame:
    """Runs by status, tokens by provider, durations by stage and bucket, mean quality: long form, one scan."""
    bucket = F.concat(F.lit("le_"), F.lit("inf"))
    for edge in sorted(edges, reverse=True):
        bucket = F.when(col(seconds) <= edge, F.lit(f"le_{edge:g}")).otherwise(bucket)
    cells = df.groupBy(
        col(status).alias("status"), col(provider).alias("provider"), col(stage).alias("stage"), bucket.alias("bucket")
    ).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(col(tokens)).cast("double").alias("tokens"),
        F.sum(col(quality)).cast("double").alias("quality"), F.count(col(quality)).cast("double").alias("scored"),
    )

    def line(metric: str, label: Column, value: str, weight: Column) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"), label.cast("string").alias("label"), F.col(value).alias("v"), weight.alias("w")
        )

    one = F.lit(0.0)
    lines = cells.select(F.inline(F.array(
        line("runs", F.col("status"), "n", one),
        line("tokens", F.col("provider"), "tokens", one),
        line("duration", F.concat_ws(":", "stage", "bucket"), "n", one),
        line("mean_quality", F.lit("all"), "quality", F.col("scored")),
    )))
    sums = lines.groupBy("metric", "label").agg(F.sum("v").alias("v"), F.sum("w").alias("w"))
    value = F.when(F.col("metric") == "mean_quality", F.try_divide("v", "w")).otherwise(F.col("v"))
    return sums.select("metric", "label", value.alias("value"))


def failure_reasons(df: DataFrame, status: str, reason: str, n: int = 10, failed: str = "failed") -> DataFrame:
    """The ``n`` most frequent reasons among failed runs."""
    counts = df.filter(col(status) == failed).groupBy(col(reason).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "reason").limit(n)


def account_usage(df: DataFrame, user: str, ts: str, amount: str) -> DataFrame:
    """Runs, amount and last use per account."""
    return df.groupBy(col(user)).agg(
        F.count(F.lit(1)).alias("runs"), F.sum(col(amount)).alias("amount"), F.max(col(ts)).alias("last_run")
    )


def visible_to(df: DataFrame, user, owner: str) -> DataFrame:
    """Rows the caller owns."""
    return df.filter(col(owner) == F.lit(user))


def visible_children(df: DataFrame, session: str, sessions: DataFrame, session_id: str, owner: str, user) -> DataFrame:
    """Rows that belong to a session the caller owns."""
    own = visible_to(sessions, user, owner).select(col(session_id).alias(session))
    return df.join(own, session, "left_semi")


def cache_hits(
    df: DataFrame, keys: str | Sequence[str], ts: str, key: str, ttl: str = "24 HOURS", rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Mark a question as a hit when the same one was asked at most ``ttl`` before."""
    rows = neighbour(df, as_list(keys), [ts, key], [ts], "previous", "_before", rows_per_chunk)
    recent = col(ts) <= F.col(f"_before.{ts}") + F.expr(f"INTERVAL {ttl}")
    return rows.withColumn("is_hit", F.coalesce(recent, F.lit(False))).drop("_before")


def explode_state(df: DataFrame, json_col: str, schema: str) -> DataFrame:
    """Fields of a JSON state document as columns next to the others; broken documents give NULLs."""
    parsed = df.withColumn("_state", F.from_json(col(json_col), schema))
    return parsed.select(*[col(c) for c in df.columns if c != json_col], "_state.*")


def usage_per_session(df: DataFrame, session: str, tokens: str, price: float, limit: float) -> DataFrame:
    """Mean and 95th percentile of tokens per session, mean cost, and sessions a daily limit would carry."""
    sums = df.groupBy(col(session)).agg(F.sum(col(tokens)).alias("tokens"))
    p95 = one_row(wide_quantiles(sums, "tokens", {"p95": 0.95}))["p95"]
    mean = F.col("mean_tokens")
    return sums.agg(F.count(F.lit(1)).alias("sessions"), F.avg("tokens").alias("mean_tokens")).withColumns({
        "p95_tokens": p95, "mean_cost": mean * price, "daily_capacity": F.floor(F.try_divide(F.lit(float(limit)), mean)),
    })


def stage_durations(
    df: DataFrame, session: str, status: str, ts: str, key: str, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Seconds from each status of a session to its next one (NULL for the last)."""
    rows = neighbour(df, session, [ts, key], [ts, status], "next", "_next", rows_per_chunk)
    micros = F.unix_micros(F.col(f"_next.{ts}").cast("timestamp")) - F.unix_micros(col(ts).cast("timestamp"))
    return rows.withColumns({"next_status": F.col(f"_next.{status}"), "seconds": micros / 1e6}).drop("_next")
