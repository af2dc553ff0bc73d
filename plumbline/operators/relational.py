"""SQL text runs, guards, and relational operators Spark has no single call for."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Sequence

from pyspark import InheritableThread
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.fixed_values import FORBIDDEN_SQL_PREFIX, FORBIDDEN_SQL_WORDS
from plumbline.functions.frames import as_list, col
from plumbline.sources.sinks import store_result

FORBIDDEN = rf"(?i)\b({'|'.join(FORBIDDEN_SQL_WORDS)})\b|{FORBIDDEN_SQL_PREFIX}"
ENVELOPE = "query_id string, success boolean, result_path string, error string, row_count bigint, ms bigint"


def guard_sql(text: str) -> str:
    """The text itself, or an error when it holds a word a read-only query may not use."""
    if re.search(FORBIDDEN, text):
        raise ValueError("only read-only queries are allowed")
    return text


def read_only(text: str) -> str:
    """The query as the source of a SELECT: there the parser takes queries only and refuses every command."""
    return f"SELECT * FROM (\n{text.strip().rstrip(';')}\n) AS _query"


def scan_sql_log(df: DataFrame, name: str) -> DataFrame:
    """Mark the rows of a query log that break the read-only rule."""
    return df.withColumn("is_forbidden", col(name).rlike(FORBIDDEN))


def validate_sql(spark: SparkSession, text: str) -> str | None:
    """None if the query holds, else the error; analysis only, no data is read and no command runs."""
    try:
        spark.sql(read_only(text)).schema
    except (PySparkException, ValueError) as error:
        return str(error)
    return None


def _run(spark: SparkSession, query_id: str, text: str, base: str) -> tuple:
    start = time.perf_counter()
    try:
        path = store_result(spark.sql(read_only(text)), base, query_id)
        rows = spark.read.parquet(path).count()
        outcome = (query_id, True, path, None, rows)
    except (PySparkException, ValueError) as error:
        outcome = (query_id, False, None, str(error), 0)
    except Exception as error:  # a cancelled job surfaces as a plain JVM error
        outcome = (query_id, False, None, f"stopped: {type(error).__name__}", 0)
    return (*outcome, int((time.perf_counter() - start) * 1000))


def run_query(
    spark: SparkSession, text: str, base: str, views: dict[str, DataFrame] | None = None, query_id: str = "query"
) -> DataFrame:
    """Run one query, store its result under ``base`` and return the one-row envelope."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.createDataFrame([_run(spark, query_id, text, base)], ENVELOPE)


def run_batch(
    spark: SparkSession,
    queries: dict[str, str],
    base: str,
    views: dict[str, DataFrame] | None = None,
    timeout_s: float | None = None,
    parallel: int = 4,
) -> DataFrame:
    """Run several queries side by side; one that fails or overruns ``timeout_s`` does not stop the rest.

    The time of a query includes waiting for cores, so set ``parallel`` to what the cluster can run at once.
    """
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    context = spark.sparkContext
    seats = threading.Semaphore(parallel)
    outcomes: list[tuple] = []

    def stop(tag: str, done: threading.Event) -> None:
        """From the time limit on cancel the query's jobs, again and again: it may be between two of them."""
        overdue = done.wait(timeout_s)
        while not overdue:
            context.cancelJobsWithTag(tag)
            overdue = done.wait(0.5)

    def work(query_id: str, text: str) -> None:
        tag = f"batch-{uuid.uuid4().hex}"
        with seats:
            context.addJobTag(tag)
            context.setLocalProperty("spark.scheduler.pool", tag)  # its own share under the FAIR scheduler
            done = threading.Event()
            if timeout_s is not None:
                threading.Thread(target=stop, args=(tag, done), daemon=True).start()
            try:
                outcomes.append(_run(spark, query_id, text, base))
            finally:
                done.set()
                context.removeJobTag(tag)

    threads = [InheritableThread(target=work, args=item) for item in queries.items()]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return spark.createDataFrame(outcomes, ENVELOPE)


def safe_div(a: Column, b: Column) -> Column:
    """Quotient, NULL for a zero divisor."""
    return F.try_divide(a, b)


def safe_sum(c: Column) -> Column:
    """Sum of whole numbers that cannot overflow."""
    return F.sum(c.cast("decimal(38,0)"))


def range_join(points: DataFrame, intervals: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with ``low <= at < high``, by an equi-join instead of all pairs, however uneven the intervals are.

    The axis is divided into slices of ``width``, and these are paired to a binary tree. An interval stands at the fewest tree
    nodes that cover its slices, at most two per level: some dozens for a year in slices of a second. A point
    asks each level that is in use for the one node above its slice. So ``width`` suits the shortest intervals;
    only in an interval's end slices pairs are met that the last comparison drops.
    """
    w = F.lit(float(width))
    whole = intervals.filter(col(low) < col(high)).withColumns({"_a": F.floor(col(low) / w), "_b": F.floor(col(high) / w) + 1})
    # at level l the cover still lacks nodes a to b (exclusive); an odd end cannot wait for its parent
    a = "shiftright(_a + shiftleft(1L, l) - 1, l)"
    b = "shiftright(_b, l)"
    nodes = f"""
        filter(flatten(transform(sequence(0, CAST(ceil(log2(_b - _a)) AS INT)), l -> array(
          IF(pmod({a}, 2) = 1 AND {a} < {b}, named_struct('level', l, 'node', {a}), NULL),
          IF(pmod({b}, 2) = 1 AND {a} + pmod({a}, 2) < {b}, named_struct('level', l, 'node', {b} - 1), NULL)
        ))), n -> n IS NOT NULL)"""
    covered = whole.withColumn("_n", F.explode(F.expr(nodes))).withColumns({"_level": F.col("_n.level"), "_node": F.col("_n.node")}).drop("_n", "_a", "_b")
    levels = [r["_level"] for r in covered.select("_level").distinct().collect()]  # at most 63
    slice_ = F.floor(col(at) / w)
    left = points.withColumn("_level", F.explode(F.array(*[F.lit(n) for n in sorted(levels)]).cast("array<int>")))
    left = left.withColumn("_slice", slice_).withColumn("_node", F.expr("shiftright(_slice, _level)")).drop("_slice")
    joined = left.join(covered, ["_level", "_node"])
    return joined.filter((col(at) >= col(low)) & (col(at) < col(high))).drop("_level", "_node")


def pivot_table(
    df: DataFrame, rows: str | Sequence[str], column: str, values: Sequence, measure: Column
) -> DataFrame:
    """One row per row key and one column per listed value; listing them saves a pass over the data."""
    return df.groupBy(*[col(c) for c in as_list(rows)]).pivot(column, list(values)).agg(measure)


def unpivot_table(df: DataFrame, ids: str | Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot([col(c) for c in as_list(ids)], [col(c) for c in values], name, value)
