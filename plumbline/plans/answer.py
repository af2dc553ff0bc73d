"""One question from table to stored, summarised answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.analyses import trend
from plumbline.operators.clean import deduplicate
from plumbline.operators.profile import infer_semantic_types, profile_columns
from plumbline.operators.results import result_shape, suggest_chart, summarize_result
from plumbline.session import shared_folder
from plumbline.sources.readers import read_table
from plumbline.sources.sinks import store_result


def _first_of(kinds: dict[str, str], wanted: str) -> str:
    for name, kind in kinds.items():
        if kind == wanted:
            return name
    raise ValueError(f"the table has no {wanted} column to answer with")


def revenue_trend_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """"Show the monthly revenue trend": one row with the stored result, its summary and its chart type."""
    orders = read_table(spark, f"{sf_dir}/orders.parquet", "parquet")
    profile = infer_semantic_types(profile_columns(orders, exact=False))
    kinds = {r["name"]: r["semantic_type"] for r in profile.select("name", "semantic_type").collect()}
    date, metric = _first_of(kinds, "date"), _first_of(kinds, "currency")
    answer = trend(deduplicate(orders), date, metric, "month")
    path = store_result(answer, shared_folder(spark, "answer"), "q_001")
    stored = read_table(spark, path, "parquet")
    chart = suggest_chart(result_shape(stored, "q_001")).select("query_id", "chart_type")
    return summarize_result(stored, "q_001", path, order_by="period").join(F.broadcast(chart), "query_id")
