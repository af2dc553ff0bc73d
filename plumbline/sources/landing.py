"""Catalog of a landing folder: what each file really is, how many rows it holds, whether to admit it."""

from __future__ import annotations

import io
import re
from urllib.parse import unquote

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.fixed_values import MAX_UPLOAD_BYTES
from plumbline.sources.byte_ranges import RANGE_BYTES, csv_records, large_files, reachable


@F.pandas_udf(T.LongType())
def _rows_in_footer(footers: pd.Series) -> pd.Series:
    """Row count from the closing bytes of a Parquet file."""

    def rows(tail):
        if tail is None:
            return None
        try:
            return pq.read_metadata(io.BytesIO(b"PAR1" + bytes(tail))).num_rows
        except Exception:  # damaged footer: counted as one row like other unreadable files
            return 1

    return footers.map(rows)


def _kind(content: Column, text: Column) -> Column:
    body = F.regexp_replace(text, r"^\s+", "")
    whole_json = F.try_parse_json(text).isNotNull()
    line_json = F.try_parse_json(F.regexp_extract(body, r"^([^\n]*)", 1)).isNotNull()
    magic = F.hex(F.substring(content, 1, 4))
    raw = F.decode(content, "ISO-8859-1")
    return (
        F.when(F.length(content) == 0, F.lit(None))
        .when(F.trim(body) == "", F.lit(None))
        .when(magic == "50415231", "parquet")
        .when((magic == "504B0304") & (raw.contains("xl/") | raw.contains("[Content_Types].xml")), "xlsx")
        .when(F.is_valid_utf8(content.cast("string")) & body.startswith("{") & (whole_json | line_json), "json")
        .when(F.is_valid_utf8(content.cast("string")) & body.startswith("[") & whole_json, "json")
        .when(F.instr(F.substring(raw, 1, 10000), "\u0000") > 0, F.lit(None))
        .otherwise("csv")
    )


def _rows(content: Column, text: Column, kind: Column) -> Column:
    raw = F.decode(content, "ISO-8859-1")  # one character per byte, so that damaged text keeps its line ends
    breaks = F.length(raw) - F.length(F.replace(raw, F.lit("\n"), F.lit("")))
    lines = breaks + F.when(raw.endswith("\n"), 0).otherwise(1)
    filled = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    body = F.regexp_replace(text, r"^\s+", "")
    lists = F.filter(
        F.map_values(F.from_json(text, "map<string,string>")), lambda v: F.ltrim(v).startswith("[")
    )
    one_document = F.coalesce(F.json_array_length(F.get(lists, F.lit(0))), F.lit(1))
    size = F.length(content)
    little_endian = F.concat(*[F.hex(F.substring(content, size - i, 1)) for i in (4, 5, 6, 7)])
    tail = F.conv(little_endian, 16, 10).cast("int") + 8
    footer = F.when(kind == "parquet", F.substring(content, size - tail + 1, tail))
    return (
        F.when(kind == "parquet", _rows_in_footer(footer))
        .when(kind == "csv", F.greatest(F.lit(0), lines - 1))
        .when((kind == "json") & body.startswith("["), F.json_array_length(text))
        .when((kind == "json") & (filled > 1), filled)  # an estimate: one object over several lines counts its lines
        .when(kind == "json", one_document)
        .when(kind.isNotNull(), F.lit(1))
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def _plain_path(listed: str) -> str:
    """A listed file address as the source's ``path`` column writes it."""
    return re.sub(r"^file:/+", "file:/", unquote(listed))


def catalog_files(
    spark: SparkSession, folder: str, max_bytes: int = MAX_UPLOAD_BYTES, glob: str = "*", range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Path, size, kind by content, whether the extension disagrees, and a row estimate for every file.

    Files of up to ``max_bytes`` are looked at whole. Larger ones, which ``admit_files`` refuses, are read in byte ranges,
    many tasks to a file (``byte_ranges.large_files`` says by which rules); only in stores that no task can open by itself they keep a
    NULL kind and estimate.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    content = F.col("content")
    text = content.cast("string")
    small = files.filter(F.col("length") <= max_bytes).withColumn("kind", _kind(content, text))
    small = small.select("path", "length", "kind", _rows(content, text, F.col("kind")).alias("row_estimate"))
    if reachable(folder):
        large = large_files(spark, folder, max_bytes, glob, range_bytes)
    else:
        large = files.filter(F.col("length") > max_bytes).select(
            "path", "length", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("bigint").alias("row_estimate")
        )
    # the source passes over empty files, so those come from the file listing, which the driver holds anyway
    listed = [(_plain_path(name),) for name in files.inputFiles()]
    named_only = spark.createDataFrame(listed, "path string").join(files.select("path"), "path", "left_anti").select(
        "path", F.lit(0).cast("bigint").alias("length"), F.lit(None).cast("string").alias("kind"),
        F.lit(0).cast("bigint").alias("row_estimate"),
    )
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    named = F.when(extension.isin("jsonl", "ndjson"), "json").otherwise(extension)
    return small.unionByName(large).unionByName(named_only).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"),
        "path",
        F.col("length").alias("size_bytes"),
        "kind",
        (F.col("kind").isNotNull() & (named != F.col("kind"))).alias("extension_lies"),
        "row_estimate",
    )


def admit_files(catalog: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Add ``reason`` (NULL when accepted) and ``accepted``."""
    reason = (
        F.when(F.col("size_bytes") == 0, "empty file")
        .when(F.col("size_bytes") > max_bytes, "file too large")
        .when(F.col("kind").isNull(), "unsupported content")
    )
    return catalog.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def count_rows_by_file(spark: SparkSession, path: str, kind: str, multi_line: bool = False) -> DataFrame:
    """Rows per file without reading columns: Parquet from row groups, text by its lines (CSV less its header).

    ``multi_line`` is for CSV with line breaks inside quotes, whose records are then told apart range by range.
    """
    if kind == "parquet":
        rows = spark.read.parquet(path)
    elif kind == "csv" and multi_line and reachable(path):
        return csv_records(spark, path).groupBy("path").agg((F.count(F.lit(1)) - 1).alias("row_count"))
    elif kind == "csv" and multi_line:
        rows = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
        kind = "records"
    else:
        rows = spark.read.text(path).filter(F.length("value") > 0)
    counts = rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("row_count"))
    if kind == "csv":
        counts = counts.withColumn("row_count", F.greatest(F.lit(0), F.col("row_count") - 1))
    return counts
