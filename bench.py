"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from plumbline.operators.profile import profile_columns, summarize  # noqa: E402
from plumbline.plans import all_queries  # noqa: E402
from plumbline.session import local_session, shared_folder  # noqa: E402
from plumbline.sources.readers import read_table  # noqa: E402

HEADLINE = (
    "profile_summary_sketch",
    "profile_summary_lineitem",
    "profile_columns_sketch",
    "profile_columns_orders",
    "source_csv",
    "clean_fill_median",
    "clean_fill_knn",
    "clean_deduplicate_latest",
    "clean_quality_score",
    "feature_rolling_sum",
    "sql_group_aggregates",
    "sql_joins",
    "sql_lag_lead",
    "sql_as_of_join",
    "sql_ranks",
    "analysis_trend",
    "analysis_root_cause",
    "analysis_percentiles",
    "analysis_correlation",
    "analysis_ranking",
    "analysis_forecast",
    "analysis_anomalies",
    "question_classes_documents",
    "result_matrix",
    "quality_expectations",
    "vector_knn",
    "run_cache_hits",
    "run_stage_durations",
    "stream_tumbling",
    "stream_terminal",
)


def warm_up(spark, sf_dir: str) -> None:
    """Start the JVM, its compiler and the Python workers on the small tables; none of them is timed below."""
    for name in ("supplier", "nation", "benchmark"):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        summarize(df, exact=True).collect()
        df.mapInPandas(lambda batches: batches, df.schema).groupBy(df.columns[0]).count().collect()


def million_rows(spark) -> str:
    """A CSV of 1,000,000 rows and four columns, the input of the reference's own timing."""
    path = shared_folder(spark, "million")
    spark.range(1_000_000).select(
        "id", F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("category"),
        (F.col("id") * 0.37 % 1000).alias("value"), (F.col("id") % 3 == 0).alias("is_active"),
    ).write.option("header", True).csv(path)
    return path


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=max(8, int(cpus)) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    builders = all_queries.builders()
    warm_up(spark, sf_dir)
    seconds = {}
    path = million_rows(spark)
    start = time.perf_counter()
    profile_columns(read_table(spark, path, "csv"), exact=False).collect()
    seconds["profile_csv_million"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        builders[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
