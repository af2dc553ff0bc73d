"""Table sources: CSV, JSON, Parquet and JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.fixed_values import FILE_KINDS, JSON_NAMES
from plumbline.functions.frames import is_integral, is_numeric, quoted
from plumbline.sources import byte_ranges


def file_kind(name: str) -> str:
    """Normalise a file type as given by a user (``".CSV"``, ``"ndjson"``) or refuse it."""
    kind = name.strip().lower().strip(".")
    if kind in JSON_NAMES:
        return "json"
    if kind in FILE_KINDS:
        return kind
    raise ValueError(f"unsupported file type {name!r}; use one of {', '.join(FILE_KINDS)}")


def _array_files(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The files of ``path`` whose first character that is not blank is ``[``, and the other ones."""
    at = F.col("_metadata.file_block_start")
    heads = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), at.alias("at"), F.monotonically_increasing_id().alias("line"),
        F.substring(F.ltrim("value"), 1, 1).alias("c"),
    ).filter("c <> ''")
    first = heads.groupBy("file").agg((F.min_by("c", F.struct("at", "line")) == "[").alias("array"))
    listed = first.groupBy("array").agg(F.collect_list("file").alias("files"))  # file names, as the reader needs them
    files = {r["array"]: r["files"] for r in listed.collect()}
    return files.get(True, []), files.get(False, [])


def merged_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """A type that holds what either of two inferred ones does; where they disagree, text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        other = {f.name: f.dataType for f in b.fields}
        fields = [T.StructField(f.name, merged_type(f.dataType, other.pop(f.name, f.dataType))) for f in a.fields]
        return T.StructType(fields + [T.StructField(n, t) for n, t in other.items()])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merged_type(a.elementType, b.elementType))
    if is_numeric(a) and is_numeric(b):
        return T.LongType() if is_integral(a) and is_integral(b) else T.DoubleType()
    return T.StringType()


def _value(row: Row) -> str:
    return row[0]


def _quoted_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None, sampling_ratio: float, range_bytes: int
) -> DataFrame:
    """CSV with line breaks inside quotes, as records found by ``byte_ranges`` and parsed by Spark."""
    options = {"escape": '"', "mode": "PERMISSIVE"}
    records = byte_ranges.csv_records(spark, path, range_bytes)
    rows = records.filter("not head").select("value")
    if schema is None:
        head = records.filter("head").orderBy("path").select("value").first()
        if head is None:
            return spark.createDataFrame([], T.StructType([]))
        texts = spark.sparkContext.parallelize([head[0]], 1).union(rows.rdd.map(_value))  # what the reader takes to infer types from
        schema = spark.read.options(header=True, inferSchema=True, samplingRatio=sampling_ratio, **options).csv(texts).schema
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    names = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    return rows.select(F.from_csv("value", names, options).alias("record")).select("record.*")


def read_table(
    spark: SparkSession,
    path: str,
    kind: str,
    schema: T.StructType | str | None = None,
    sampling_ratio: float = 1.0,
    describe: bool = False,
    multi_line: bool = False,
    range_bytes: int = byte_ranges.RANGE_BYTES,
) -> DataFrame:
    """Read files of one kind; ``path`` may name any store Spark reaches (``s3a://``, ``hdfs://`` ...).

    Text formats without ``schema`` are scanned to infer one (a share of them with
    ``sampling_ratio``); cells that do not fit become NULL. Newline-delimited JSON stays splittable; of a folder, the
    files that open with ``[`` are read as one document each, the others line by line, all by one schema in which text wins. ``multi_line`` is for CSV with line
    breaks inside quotes: a file is read in ranges of ``range_bytes``, whose quotes are counted first to find where records
    start, so that it is many tasks (only in stores that no task can open by itself a file is one task). With ``describe`` the load envelope is
    returned instead: table name, row count, column count and column names.
    """
    kind = file_kind(kind)
    if kind == "parquet":
        df = spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    else:
        reader = spark.read.option("mode", "PERMISSIVE")
        if schema is not None:
            reader = reader.schema(schema)
        else:
            reader = reader.option("samplingRatio", sampling_ratio)
        if kind == "csv" and multi_line and byte_ranges.reachable(path):
            df = _quoted_csv(spark, path, schema, sampling_ratio, range_bytes)
        elif kind == "csv":
            reader = reader.option("header", True).option("escape", '"').option("multiLine", multi_line)
            df = (reader if schema is not None else reader.option("inferSchema", True)).csv(path)
        else:
            arrays, lines = _array_files(spark, path)
            if not arrays or not lines:
                df = reader.option("multiLine", bool(arrays)).json(path)
            else:
                if schema is None:
                    inferred = [reader.option("multiLine", many).json(files).schema for many, files in ((False, lines), (True, arrays))]
                    schema = merged_type(*inferred)
                df = spark.read.schema(schema).option("multiLine", False).json(lines)
                df = df.unionByName(spark.read.schema(schema).option("multiLine", True).json(arrays))
    return load_envelope(df, path.rstrip("/").rsplit("/", 1)[-1]) if describe else df


def load_envelope(df: DataFrame, table_name: str) -> DataFrame:
    """One row saying what was loaded; the count is the only job."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(table_name).alias("table_name"),
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
    )


def jdbc_options(
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int = 200,
    fetch_size: int = 10_000,
    driver: str | None = None,
) -> dict[str, str]:
    """Reader options; with a partition column the table is read by that many parallel range queries."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), "pushDownAggregate": "true"}
    if driver:
        options["driver"] = driver
    if partition_column is not None:
        if bounds is None:
            raise ValueError("a partition column needs its lower and upper bound")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, url: str, table: str, **more) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **more)).load()


def list_jdbc_tables(spark: SparkSession, url: str, driver: str | None = None) -> DataFrame:
    """Tables of a database that has the standard information schema."""
    tables = "(SELECT table_schema, table_name FROM information_schema.tables) AS listed_tables"
    return read_jdbc(spark, url, tables, driver=driver)
