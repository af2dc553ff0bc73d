"""Table sinks: Parquet tables, stored query results, JSON records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.frames import col


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] | None = None) -> str:
    """Write as Parquet (replacing what is there) and return the path."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def result_path(base: str, query_id: str) -> str:
    return f"{base.rstrip('/')}/result_{query_id}.parquet"


def store_result(df: DataFrame, base: str, query_id: str) -> str:
    """Store a whole query result; callers keep only the path and a summary."""
    return write_table(df, result_path(base, query_id))


def to_records(df: DataFrame, digits: int = 3) -> DataFrame:
    """One JSON object per row, moments in ISO-8601 with ``digits`` digits of the second (6 for all there are), NULL fields kept.

    Three digits are the form in which the records of a query result have always been handed out; what is beyond is cut off.
    """
    whole = F.struct(*[col(c) for c in df.columns])
    moment = "yyyy-MM-dd'T'HH:mm:ss" + ("." + "S" * digits if digits else "")
    moments = {
        "timestampFormat": moment,
        "timestampNTZFormat": moment,
        "dateFormat": "yyyy-MM-dd",
        "ignoreNullFields": "false",
    }
    return df.select(F.to_json(whole, moments).alias("record"))
