"""Registered queries for the sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import results
from plumbline.plans.registry import query, table
from plumbline.session import shared_folder
from plumbline.sources import landing, readers, sinks

ORDERS = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
"""


def _typed_orders(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint"), "o_orderstatus",
        F.col("o_totalprice").cast("double"), F.col("o_orderdate").cast("timestamp_ntz"), "o_orderpriority",
    )


@query("source_csv", ORDERS)
def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "csv")
    table(spark, sf_dir, "orders").write.option("header", True).csv(path)
    return _typed_orders(readers.read_table(spark, path, ".CSV"))


@query("source_json", ORDERS)
def source_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "json")
    table(spark, sf_dir, "orders").write.json(path)
    return _typed_orders(readers.read_table(spark, path, "ndjson"))


@query("source_csv_quoted", "SELECT doc_id, text, lang, source FROM documents")
def source_csv_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "csv-quoted")
    writer = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").write
    writer.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return readers.read_table(spark, path, "csv", "doc_id bigint, text string, lang string, source string", multi_line=True)


@query("source_json_mixed", "SELECT doc_id, text, lang FROM documents UNION ALL SELECT item_id, text, NULL FROM benchmark")
def source_json_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of newline-delimited files and files that hold one array."""
    path = shared_folder(spark, "json-mixed")
    table(spark, sf_dir, "documents").select("doc_id", "text", "lang").write.json(path)
    items = table(spark, sf_dir, "benchmark").select(F.to_json(F.struct(F.col("item_id").alias("doc_id"), "text")).alias("item"))
    few = items.groupBy(F.pmod(F.xxhash64("item"), F.lit(4))).agg(F.collect_list("item").alias("items"))
    few.select(F.concat(F.lit("[\n"), F.array_join("items", ",\n"), F.lit("\n]")).alias("value")).repartition(4).write.mode("append").text(path)
    return readers.read_table(spark, path, "json").select("doc_id", "text", "lang")


@query("source_parquet", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def source_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_table(spark, f"{sf_dir}/events.parquet", "parquet")


@query(
    "source_load_envelope",
    """
    SELECT 'lineitem.parquet' AS table_name, count(*) AS row_count, 11 AS column_count,
      'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,'
      || 'l_linestatus,l_shipdate' AS column_names
    FROM lineitem
    """,
)
def source_load_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = readers.read_table(spark, f"{sf_dir}/lineitem.parquet", "parquet", describe=True)
    return df.select("table_name", "row_count", "column_count", F.array_join("columns", ",").alias("column_names"))


_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@query(
    "source_landing_catalog",
    " UNION ALL ".join(
        f"SELECT '{n}.parquet' AS file_name, 'parquet' AS kind, false AS extension_lies, true AS accepted, "
        f"count(*) AS row_estimate FROM {n}"
        for n in _NAMES
    ),
)
def source_landing_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = landing.admit_files(landing.catalog_files(spark, sf_dir, glob="*.parquet"))
    return catalog.select("file_name", "kind", "extension_lies", "accepted", "row_estimate")


@query(
    "source_row_counts",
    """
    SELECT 'lineitem.parquet' AS file_name, count(*) AS row_count FROM lineitem
    UNION ALL SELECT 'documents.csv', count(*) FROM documents
    """,
)
def source_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "counts")
    table(spark, sf_dir, "documents").write.options(header=True, quoteAll=True, escape='"').csv(path)
    parquet = landing.count_rows_by_file(spark, f"{sf_dir}/lineitem.parquet", "parquet")
    csv = landing.count_rows_by_file(spark, path, "csv", multi_line=True).agg(F.sum("row_count").alias("row_count"))
    return parquet.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "row_count").unionByName(
        csv.select(F.lit("documents.csv").alias("file_name"), "row_count")
    )


@query(
    "sink_parquet",
    "SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_returnflag, l_shipdate FROM lineitem",
)
def sink_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate"
    )
    path = sinks.write_table(df, shared_folder(spark, "table"), partition_by=["l_returnflag"])
    return spark.read.parquet(path)


@query(
    "sink_stored_result",
    """
    WITH r AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
    SELECT 'by_priority' AS query_id, count(*) AS row_count, 'o_orderpriority,n' AS column_names, 5 AS samples
    FROM r
    """,
)
def sink_stored_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    path = sinks.store_result(result, shared_folder(spark, "results"), "by_priority")
    summary = results.summarize_result(spark.read.parquet(path), "by_priority", path, order_by="o_orderpriority")
    return summary.select(
        "query_id", "row_count", F.array_join("column_names", ",").alias("column_names"),
        F.size("sample_rows").alias("samples"),
    )


@query(
    "sink_records",
    """
    SELECT '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_totalprice":'
      || o_totalprice || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000"}' AS record
    FROM orders
    """,
)
def sink_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.to_records(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    )


@query(
    "sink_records_micros",
    """
    SELECT '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '"}' AS record
    FROM (SELECT event_id, ts + to_microseconds(event_id % 1000) AS ts FROM events)
    """,
)
def sink_records_micros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments that differ by microseconds."""
    later = F.expr("ts + make_dt_interval(0, 0, 0, CAST(event_id % 1000 AS DECIMAL(18,6)) / 1000000)")
    return sinks.to_records(table(spark, sf_dir, "events").select("event_id", later.alias("ts")), digits=6)


@query(
    "source_json_types",
    """
    SELECT 'd' || doc_id AS code, doc_id::DOUBLE AS amount, lang, NULL AS note FROM documents
    UNION ALL SELECT item_id::VARCHAR, item_id + 0.5, NULL, 'n' || item_id FROM benchmark
    """,
)
def source_json_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder in which a column is text in some files and a number in others."""
    path = shared_folder(spark, "json-types")
    docs = table(spark, sf_dir, "documents")
    docs.select(F.concat(F.lit("d"), "doc_id").alias("code"), F.col("doc_id").alias("amount"), "lang").write.json(path)
    items = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("code"), (F.col("item_id") + 0.5).alias("amount"), F.concat(F.lit("n"), "item_id").alias("note")
    )
    one = items.select(F.to_json(F.struct("code", "amount", "note")).alias("item"))
    few = one.groupBy(F.pmod(F.xxhash64("item"), F.lit(4))).agg(F.collect_list("item").alias("items"))
    few.select(F.concat(F.lit("[\n"), F.array_join("items", ",\n"), F.lit("\n]")).alias("value")).repartition(4).write.mode("append").text(path)
    return readers.read_table(spark, path, "json").select("code", "amount", "lang", "note")
