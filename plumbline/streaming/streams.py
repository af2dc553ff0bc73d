"""Run events as streams. Moments are read as TIMESTAMP because a watermark needs that type."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.utils import AnalysisException

from plumbline.fixed_values import EXHAUSTED_AT, STATUS_STEPS
from plumbline.functions.frames import as_list, col
from plumbline.operators.runs import step_of

TERMINAL = ("complete", "failed", "close")


def stream_events(
    spark: SparkSession, folder: str, schema: T.StructType | str, glob: str = "*.parquet", ts: str = "ts",
    files_per_batch: int | None = None,
) -> DataFrame:
    """New Parquet files of a folder as a stream; ``ts`` becomes a TIMESTAMP."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder).withColumn(ts, col(ts).cast("timestamp"))


def stream_latest_status(
    sdf: DataFrame, session: str, status: str, order: Sequence[str], step_map: dict[str, int] | None = None
) -> DataFrame:
    """Last status and step per session, kept as a running aggregate (update mode, see ``stream_upserts``)."""
    key = F.struct(*[col(c) for c in order])
    step = step_of(col(status), step_map or STATUS_STEPS)
    return sdf.groupBy(col(session)).agg(
        F.max_by(col(status), key).alias("status"),
        F.coalesce(F.max_by(step, F.when(step.isNotNull(), key)), F.lit(0)).alias("step"),
    )


def stream_metrics(
    sdf: DataFrame, ts: str, width: str, slide: str | None = None, watermark: str = "1 hour",
    by: str | Sequence[str] | None = None, value: str | None = None,
) -> DataFrame:
    """Counts and sums per tumbling or sliding window.

    In update mode (``stream_upserts``) a window is given out each time it changes, and leaves the state once the watermark has
    passed its end.
    """
    w = F.window(col(ts), width, slide) if slide else F.window(col(ts), width)
    keys = [col(c) for c in as_list(by)]
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(col(value)).alias("total")] if value else [])
    out = sdf.withWatermark(ts, watermark).groupBy(w.alias("_w"), *keys).agg(*aggs)
    return out.select(F.col("_w.start").alias("window_start"), *keys, *[c for c in ("n", "total") if c in out.columns])


def stream_sessions(
    sdf: DataFrame, ts: str, by: str, gap: str = "30 minutes", watermark: str = "1 hour", value: str | None = None
) -> DataFrame:
    """Activity sessions per key: a pause longer than ``gap`` starts a new one.

    A very active key sends few rows if the session merges windows inside each task before the shuffle
    (spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition, which ``local_session`` sets).
    """
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(col(value)).alias("total")] if value else [])
    out = sdf.withWatermark(ts, watermark).groupBy(F.session_window(col(ts), gap).alias("_w"), col(by)).agg(*aggs)
    return out.select(
        col(by), F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"),
        *[c for c in ("n", "total") if c in out.columns],
    )


def _micros(moments: pd.Series) -> np.ndarray:
    """Microseconds since 1970 of the moments as their zone's clock shows them."""
    if getattr(moments.dtype, "tz", None) is not None:
        moments = moments.dt.tz_localize(None)
    return moments.to_numpy("datetime64[us]").astype(np.int64)


def _a_span_apart(moments: np.ndarray, last: int | None, span: int) -> list[int]:
    """Places in ascending ``moments`` of the first one more than ``span`` after ``last``, of the first one so long after that, and so on."""
    at, kept = 0 if last is None else int(moments.searchsorted(last + span, "right")), []
    while at < len(moments):
        kept.append(at)
        at = int(moments.searchsorted(moments[at] + span, "right"))
    return kept


def _identity(sdf: DataFrame, names: Sequence[str]) -> Column:
    """The key columns as one text, different for different keys; nulls equal nulls, and -0.0 equals 0.0."""

    def text(name: str) -> Column:
        kind = sdf.schema[name].dataType
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return (col(name) + F.lit(0).cast(kind)).cast("string")
        return F.base64(col(name)) if isinstance(kind, T.BinaryType) else col(name).cast("string")

    return F.to_json(F.array(*[text(n) for n in names]))


def stream_first_in_ttl(
    sdf: DataFrame, keys: str | Sequence[str], ts: str, ttl: str = "24 hours", tie: str | Sequence[str] | None = None,
    buckets: int = 1024,
) -> DataFrame:
    """Keep an event if it comes more than ``ttl`` after the last kept one of the same keys.

    The moment of the last kept event is each key's state; the events of a micro-batch are taken in order of time (equal
    moments by ``tie``, else as they arrive), so
    the result does not depend on how they fall into batches as long as these come in order. Once the watermark
    is ``ttl`` past that moment the state goes. Keys are numbers, texts, booleans, dates, moments or bytes.

    Python is called once for each of the ``buckets`` into which the keys are hashed, as a call costs much more than a key's
    few rows. So a micro-batch's share of a bucket must fit into a task, and a checkpoint belongs to its number of buckets.
    """
    names = as_list(keys)
    span = pd.Timedelta(ttl).value // 1000
    ties = as_list(tie)
    columns = sdf.columns

    def keep(_bucket, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames))
        if ties:
            rows = rows.sort_values(ties, kind="stable")
        last = dict(zip(*state.get)) if state.exists else {}
        codes, found = pd.factorize(rows["_ttl_key"])
        moments = _micros(rows[ts])
        order = np.lexsort((moments, codes))
        moments, bounds = moments[order], np.searchsorted(codes[order], np.arange(len(found) + 1)).tolist()
        kept = []
        for key, start, stop in zip(found, bounds, bounds[1:]):
            places = _a_span_apart(moments[start:stop], last.get(key), span)
            if places:
                last[key] = int(moments[start + places[-1]])
                kept += [start + at for at in places]
        watermark = state.getCurrentWatermarkMs()
        held = {k: v for k, v in last.items() if (v + span) // 1000 + 1 > watermark}
        if held:
            state.update((list(held), list(held.values())))
            state.setTimeoutTimestamp((max(held.values()) + span) // 1000 + 1)
        elif state.exists:
            state.remove()
        if kept:
            yield rows.iloc[order[kept]][columns]

    timed = sdf.withWatermark(ts, ttl).filter(col(ts).isNotNull()).withColumn("_ttl_key", _identity(sdf, names))
    # a key column is null in all rows of a bucket or in none, as pandas has no null among whole numbers
    nulls = [F.when(col(n).isNull(), "-").otherwise("+") for n in names]
    bucket = F.concat(*nulls, F.pmod(F.xxhash64("_ttl_key"), F.lit(buckets)).cast("string"))
    return timed.withColumn("_ttl_bucket", bucket).groupBy("_ttl_bucket").applyInPandasWithState(
        keep, sdf.schema, "keys array<string>, last array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def stream_budget_alerts(
    sdf: DataFrame, ts: str, provider: str, amount: str, limits: DataFrame, watermark: str = "1 hour"
) -> DataFrame:
    """Providers whose usage of the day has reached 95 % of the limit (update mode)."""
    daily = stream_metrics(sdf, ts, "1 day", None, watermark, provider, amount)
    joined = daily.join(limits, daily[provider] == limits["provider"]).drop(limits["provider"])
    return joined.filter(F.col("total") >= F.col("daily_limit") * EXHAUSTED_AT).select(
        F.col("window_start").alias("day"), col(provider), F.col("total").alias("used"), "daily_limit"
    )


def stream_to_table(sdf: DataFrame, path: str, checkpoint: str, available_now: bool = True, every: str = "1 minute") -> StreamingQuery:
    """Append each micro-batch to a Parquet table; a restart with the same checkpoint goes on where it stopped."""
    writer = sdf.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.outputMode("append").start()


def stream_snapshots(sdf: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Write every micro-batch of an aggregate to ``path/batch=N``; a repeated batch replaces its own folder."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        sdf.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save)
        .trigger(availableNow=True).start()
    )


def last_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot of a complete-mode stream."""
    every = spark.read.parquet(path)
    newest = every.agg(F.max("batch").alias("b")).first()["b"]
    return every.filter(F.col("batch") == newest).drop("batch")


def stream_upserts(
    sdf: DataFrame, path: str, checkpoint: str, keys: str | Sequence[str], compact_every: int = 20, available_now: bool = True,
    every: str = "1 minute",
) -> StreamingQuery:
    """Keep the newest row per key of an aggregate in update mode; ``newest_rows`` reads them.

    A micro-batch holds only the keys that changed, and only these are written, to ``path/changes/batch=N``. Every
    ``compact_every`` batches all newest rows are written once, to ``path/base/batch=N``, so that a reader never meets more than
    that many versions of a key. Both replace their own folder, so a repeated batch changes nothing.
    """
    names = as_list(keys)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        if (number + 1) % compact_every == 0:
            newest_rows(batch.sparkSession, path, names, number).write.mode("overwrite").parquet(f"{path}/base/batch={number}")

    writer = sdf.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def newest_rows(spark: SparkSession, path: str, keys: str | Sequence[str], upto: int | None = None) -> DataFrame:
    """The newest row of each key that ``stream_upserts`` has written, as of batch ``upto`` where given.

    Reads the last compacted base and the changes after it; versions of a key meet in an aggregation that
    combines before the shuffle.
    """
    names = as_list(keys)
    try:
        bases = spark.read.parquet(f"{path}/base")
        if upto is not None:  # the base of this very batch may be left from an attempt that broke off
            bases = bases.filter(F.col("batch") < upto)
        base = bases.agg(F.max("batch")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        base = None
    rows = spark.read.parquet(f"{path}/changes")
    if upto is not None:
        rows = rows.filter(F.col("batch") <= upto)
    if base is not None:
        rows = rows.filter(F.col("batch") > base).unionByName(bases.filter(F.col("batch") == base))
    fields = [c for c in rows.columns if c != "batch"]
    newest = rows.groupBy(*[col(k) for k in names]).agg(F.max_by(F.struct(*[col(c) for c in fields]), "batch").alias("_row"))
    return newest.select("_row.*")


def _ended_before(spark: SparkSession, ledger: str, number: int) -> DataFrame | None:
    """Sessions that ended before batch ``number``, from the last compacted ledger and what came after it."""
    rows, base = None, -1
    if number > 0:
        rows = spark.read.parquet(f"{ledger}/ended").filter(F.col("batch") < number)
        try:
            bases = spark.read.parquet(f"{ledger}/base").filter(F.col("batch") < number)
            base = bases.agg(F.max("batch")).first()[0]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            base = None
        if base is not None:
            rows = rows.filter(F.col("batch") > base).unionByName(bases.filter(F.col("batch") == base))
    return rows


def stream_terminal(
    sdf: DataFrame, path: str, checkpoint: str, session: str, status: str, order: Sequence[str],
    terminal: Sequence[str] = TERMINAL, remember: str | None = None, compact_every: int = 20,
) -> StreamingQuery:
    """Forward a session's events up to and including its first terminal one; drop what comes later.

    Each micro-batch finds the terminal moments of its sessions by a map-side-combined aggregation and adds them to a
    ledger table; events are then filtered by a join with the ledger. So no session's events pass through one
    task, and a repeated batch replaces exactly its own folders. Every ``compact_every`` batches the ledger is written anew as
    one row per session, and batches read that and what came after it. With ``remember`` (as "7 days"; the first column of
    ``order`` is then a moment) sessions that ended longer before the newest end are left out of it, so that it stops
    growing; events that come even later are forwarded again.
    """
    events_path, ledger_path = f"{path}/events", f"{path}/ledger"
    key = F.struct(*[col(c) for c in order])

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ended = batch.filter(col(status).isin(*terminal)).groupBy(col(session).alias("_session")).agg(
            F.min(key).alias("_end")
        )
        ended.write.mode("overwrite").parquet(f"{ledger_path}/ended/batch={number}")
        this_time = spark.read.schema(ended.schema).parquet(f"{ledger_path}/ended/batch={number}")
        earlier = _ended_before(spark, ledger_path, number)
        alive = batch
        if earlier is not None:
            alive = batch.join(earlier.select("_session").distinct(), col(session) == F.col("_session"), "left_anti")
        kept = alive.join(this_time, col(session) == F.col("_session"), "left").filter(
            F.col("_end").isNull() | (key <= F.col("_end"))
        )
        kept.select(*[col(c) for c in batch.columns]).write.mode("overwrite").parquet(f"{events_path}/batch={number}")
        if (number + 1) % compact_every == 0:
            known = this_time if earlier is None else earlier.drop("batch").unionByName(this_time)
            once = known.groupBy("_session").agg(F.min("_end").alias("_end"))
            if remember is not None:
                newest = known.agg(F.max("_end").alias("e")).select(F.col("e")[order[0]]).scalar()
                once = once.filter(F.col("_end")[order[0]] >= newest - F.expr(f"INTERVAL {remember}"))
            once.write.mode("overwrite").parquet(f"{ledger_path}/base/batch={number}")

    return (
        sdf.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()
    )


def as_stored(moment: Column) -> Column:
    """Back to the type moments have in the stored tables."""
    return moment.cast("timestamp_ntz")
