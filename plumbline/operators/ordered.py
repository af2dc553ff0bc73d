"""Row-order operators that hold up when one key owns a large share of the rows.

A plain window puts a whole key into one task. Here the rows per key are counted first (one small job). If no key is
too large for a task, the plain window is used. If some are, each such key is cut along the whole ordering tuple into
chunks of about ``rows_per_chunk`` rows by range partitioning; the window runs inside a chunk, and what must cross a chunk
border (the last row, a sum so far) comes from a per-chunk aggregate, which is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.frames import as_list, col, in_pieces, join_groups

ROWS_PER_CHUNK = 2_000_000
CHUNK = "_chunk"
#: An ordering column: its name, or (name, True) for descending order with nulls last.
Order = str | tuple[str, bool]


def _sorted(order: Sequence[Order]) -> list[Column]:
    return [col(o) if isinstance(o, str) else col(o[0]).desc_nulls_last() if o[1] else col(o[0]) for o in order]


def add_chunks(df: DataFrame, by: Sequence[str], order: Sequence[Order], rows_per_chunk: int) -> DataFrame | None:
    """Add ``_chunk``, or return None when no key exceeds ``rows_per_chunk`` rows.

    Rows of a large key are told apart by all of ``order`` (a tie column included), so chunks are even however few moments
    there are; only rows that agree in every ordering column, whose order is undefined anyway, share a chunk for certain.
    Rows of all other keys are chunk 0; the large keys' chunks count from 1.
    """
    by = list(by)
    keys = [col(c) for c in by]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > rows_per_chunk)
    found = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("_rows").alias("rows")).first()
    if found["n"] == 0:
        return None
    large = sizes.select(*keys, F.lit(True).alias("_large"))
    flagged = join_groups(df, large, by)
    cut = in_pieces(flagged.filter("_large"), [*keys, *_sorted(order)], found["rows"], rows_per_chunk, CHUNK)
    rest = flagged.filter("_large is null").withColumn(CHUNK, F.lit(-1).cast("bigint"))
    return cut.unionByName(rest).withColumn(CHUNK, F.col(CHUNK) + 1).drop("_large")


def _join_carried(rows: DataFrame, carried: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bring what crosses chunk borders to the rows."""
    return join_groups(rows, carried, [*by, CHUNK])


def neighbour(
    df: DataFrame,
    by: str | Sequence[str],
    order: Sequence[str],
    cols: Sequence[str],
    step: str = "previous",
    name: str = "neighbour",
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add the given columns of the row before (``previous``) or after (``next``) as struct ``name``."""
    if step not in ("previous", "next"):
        raise ValueError("step is 'previous' or 'next'")
    by, order = as_list(by), list(order)
    shift = F.lag if step == "previous" else F.lead
    packed = F.struct(*[col(c) for c in cols])
    sort = [col(c) for c in order]
    keys = [col(c) for c in by]
    rows = add_chunks(df, by, order, rows_per_chunk)
    if rows is None:
        return df.withColumn(name, shift(packed).over(Window.partitionBy(*keys).orderBy(*sort)))
    edge = F.max_by if step == "previous" else F.min_by
    local = rows.withColumn(name, shift(packed).over(Window.partitionBy(*keys, CHUNK).orderBy(*sort)))
    edges = rows.filter(F.col(CHUNK) > 0).groupBy(*keys, CHUNK).agg(edge(packed, F.struct(*sort)).alias("_edge"))
    carried = edges.withColumn("_carry", shift("_edge").over(Window.partitionBy(*keys).orderBy(CHUNK))).drop("_edge")
    joined = _join_carried(local, carried, by)
    return joined.withColumn(name, F.coalesce(F.col(name), F.col("_carry"))).drop("_carry", CHUNK)


def running_sum(
    df: DataFrame,
    by: str | Sequence[str],
    order: Sequence[Order],
    value: str,
    name: str = "running",
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add the sum of ``value`` over the rows of the group up to and including this one; NULL before the first value."""
    by = as_list(by)
    keys = [col(c) for c in by]
    sort = _sorted(order)
    upto = F.sum(col(value))
    rows = add_chunks(df, by, order, rows_per_chunk)
    if rows is None:
        whole = Window.partitionBy(*keys).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, upto.over(whole))
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.filter(F.col(CHUNK) > 0)
        .groupBy(*keys, CHUNK)
        .agg(upto.alias("_in_chunk"))
        .withColumn("_offset", F.sum("_in_chunk").over(before))
        .drop("_in_chunk")
    )
    summed = _join_carried(rows.withColumn(name, upto.over(inside)), offsets, by)
    total = F.coalesce(F.col(name) + F.col("_offset"), F.col(name), F.col("_offset"))
    return summed.withColumn(name, total).drop("_offset", CHUNK)


def row_position(
    df: DataFrame,
    by: str | Sequence[str],
    order: Sequence[Order],
    name: str = "position",
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add the 1-based place of each row within its group, in the given order."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_sum(ones, by, order, "_one", name, rows_per_chunk).drop("_one")


def ranks(
    df: DataFrame,
    by: str | Sequence[str],
    value: str,
    tie: str,
    descending: bool = True,
    tiles: int = 4,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add row_number, rank, dense_rank, percent_rank and ntile within the group, by the value in its own type.

    NULLs come last in descending order and first in ascending order. ``tie`` is a unique column that orders equal values for row_number and ntile.
    """
    by = as_list(by)
    keys = [col(c) for c in by]
    rows = df.withColumn("_measure", col(value))
    order = ("_measure", descending)
    placed = row_position(rows, by, [order, tie], "row_number", rows_per_chunk)
    peers = placed.groupBy(*keys, "_measure").agg(F.min("row_number").alias("rank"))
    peers = row_position(peers, by, [order], "dense_rank", rows_per_chunk)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    joined = join_groups(join_groups(placed, peers, [*by, "_measure"]), sizes, by)
    # the first (size mod tiles) tiles hold one row more than the others
    small = F.floor(F.col("_size") / tiles)
    extra = F.col("_size") % tiles
    in_big = extra * (small + 1)
    at = F.col("row_number") - 1
    tile = F.when(at < in_big, F.floor(at / (small + 1))).otherwise(extra + F.floor(F.try_divide(at - in_big, small)))
    share = F.when(F.col("_size") > 1, (F.col("rank") - 1) / (F.col("_size") - 1)).otherwise(0.0)
    return joined.withColumn("percent_rank", share).withColumn("ntile", tile + 1).drop("_measure", "_size")


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: str | Sequence[str],
    right_cols: Sequence[str],
    tie: str,
    name: str = "match",
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Every left row with the latest right row at or before it (same ``by``), as struct ``name``.

    One union and one ordered pass; no pairs are formed. Right rows at the same moment are taken in
    order of ``tie``, the last one winning. Unmatched left rows keep a NULL.
    """
    by = as_list(by)
    keys = [col(c) for c in by]
    left_pack = F.struct(*[col(c) for c in left.columns])
    right_pack = F.struct(*[col(c) for c in right_cols])
    left_type = left.select(left_pack.alias("l")).schema["l"].dataType
    right_type = right.select(right_pack.alias("r")).schema["r"].dataType
    tie_type = right.schema[tie].dataType
    a = left.select(
        *keys, col(on), F.lit(1).alias("_side"), F.lit(None).cast(tie_type).alias("_tie"),
        left_pack.alias("_l"), F.lit(None).cast(right_type).alias("_r"),
    )
    b = right.select(
        *keys, col(on), F.lit(0).alias("_side"), col(tie).alias("_tie"),
        F.lit(None).cast(left_type).alias("_l"), right_pack.alias("_r"),
    )
    both = a.unionByName(b)
    sort = [col(on), F.col("_side"), F.col("_tie")]
    latest = F.last("_r", ignorenulls=True)
    rows = add_chunks(both, by, [on, "_side", "_tie"], rows_per_chunk)
    if rows is None:
        upto = Window.partitionBy(*keys).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn(name, latest.over(upto)).filter("_side = 1").select("_l.*", name)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_hit", latest.over(inside)).filter("_side = 1")
    edges = rows.filter(F.col(CHUNK) > 0).groupBy(*keys, CHUNK).agg(
        F.max_by("_r", F.when(F.col("_side") == 0, F.struct(col(on), F.col("_tie")))).alias("_edge")
    )
    carried = edges.withColumn("_carry", F.last("_edge", ignorenulls=True).over(before)).drop("_edge")
    joined = _join_carried(local.drop("_r", "_tie", "_side"), carried, by)
    return joined.select("_l.*", F.coalesce("_hit", "_carry").alias(name))
