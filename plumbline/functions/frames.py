"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import shared_folder

#: Pieces into which ranges are cut at most; each costs a task, and a few sampled rows on the driver.
MOST_PIECES = 20_000


#: Options of ``to_json`` under which rows that differ in anything also differ in their text.
EXACT_JSON = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def quoted(name: str) -> str:
    """A column name safe to use in an expression, whatever it contains."""
    return "`" + name.replace("`", "``") + "`"


def text_literal(text: str) -> str:
    """A SQL string literal holding exactly ``text``."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def col(name: str) -> Column:
    return F.col(quoted(name))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def as_list(by: str | Sequence[str] | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def join_groups(
    df: DataFrame, stats: DataFrame, by: Sequence[str], how: str = "left", null_safe: bool = True
) -> DataFrame:
    """Join per-group figures back to rows.

    No broadcast hint: the number of groups has no known bound, so Spark decides from the measured
    size and splits a hot group by its skew-join rule when it has to shuffle. A NULL group counts as
    a group, as it does in GROUP BY; with ``null_safe=False`` (keys known to be present) the plain
    equality lets rows already hashed on the keys stay where they are.
    """
    renamed = stats
    for i, name in enumerate(by):
        renamed = renamed.withColumnRenamed(name, f"_group_{i}")
    match = F.lit(True)
    for i, name in enumerate(by):
        other = F.col(f"_group_{i}")
        match = match & (col(name).eqNullSafe(other) if null_safe else col(name) == other)
    return df.join(renamed, match, how).drop(*[f"_group_{i}" for i in range(len(by))])


def one_row(stats: DataFrame) -> Column:
    """The columns of a one-row aggregate as one struct value, without a join.

    Spark runs it as a scalar subquery: one row, once, handed to every task as a constant. Where several
    of its fields are used, put it into a column first (``with_row``): each mention is planned anew.
    """
    return stats.select(F.struct(*[col(c) for c in stats.columns]).alias("s")).scalar()


def with_row(df: DataFrame, stats: DataFrame, name: str = "_row") -> DataFrame:
    """Add a one-row aggregate to every row as struct ``name``."""
    return df.withColumn(name, one_row(stats))


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: what follows rereads files if an executor is lost."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_pieces(df: DataFrame, order: Sequence[Column], rows: int, rows_per_piece: int, name: str) -> DataFrame:
    """Cut ``df`` along ``order`` into pieces of about ``rows_per_piece`` of its ``rows`` rows, numbered from 0 in ``name``.

    Spark's range partitioning draws the borders from a sample of the whole ordering tuple, nulls, NaN and descending columns
    as in a sort; only rows equal in all of it stay together. Written at once, as a second run might draw other borders.
    """
    pieces = max(1, min(MOST_PIECES, -(-rows // rows_per_piece)))
    return written(df.repartitionByRange(pieces, *order).withColumn(name, F.spark_partition_id().cast("bigint")), "pieces")
