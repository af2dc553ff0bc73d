"""Cleaning: missing values, outliers, casts, text repair, duplicates, the log and the plan."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.fixed_values import DROP_COLUMN_ABOVE, DROP_ROWS_BELOW
from plumbline.functions.frames import EXACT_JSON, as_list, col, is_numeric, join_groups, with_row, written
from plumbline.operators.ordered import running_sum
from plumbline.operators.quantiles import most_frequent, wide_quantiles

ROW_REMOVING = ("drop", "iqr", "z_score", "deduplicate")


def _with_stats(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """Add the columns of ``stats``: per group by a join, for the whole table as a constant."""
    if by:
        return join_groups(df, stats, by)
    row = F.col("_row")
    return with_row(df, stats).withColumns({c: row[c] for c in stats.columns}).drop("_row")


# missing values


def fill_median(df: DataFrame, name: str, by: str | Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    by = as_list(by)
    stats = wide_quantiles(df, name, {"_median": 0.5}, by, exact)
    return _with_stats(df, stats, by).withColumn(name, F.coalesce(col(name), F.col("_median"))).drop("_median")


def fill_mode(df: DataFrame, name: str, by: str | Sequence[str] | None = None) -> DataFrame:
    by = as_list(by)
    stats = most_frequent(df, name, by, "_mode")
    return _with_stats(df, stats, by).withColumn(name, F.coalesce(col(name), F.col("_mode"))).drop("_mode")


def fill_knn(
    df: DataFrame, name: str, feature: str | Sequence[str], block: str | Sequence[str], k: int = 5
) -> DataFrame:
    """Fill with the mean of the ``k`` complete rows nearest in ``feature`` within the block.

    Rows as near as the k-th one all count, so the result does not depend on row order. Of several features the
    straight distance counts (see ``_fill_knn_grid``). Of one, complete rows are
    first summed per distinct feature value; a missing value then looks at the ``k`` distinct values on
    either side by their place in the sorted list (an equi-join), never at all rows of its block.
    """
    block = as_list(block)
    if len(as_list(feature)) > 1:
        return _fill_knn_grid(df, name, as_list(feature), block, k)
    feature = as_list(feature)[0]
    keys = [col(c) for c in block]
    spot = col(feature).cast("double")
    complete = col(name).isNotNull()
    places = (
        df.filter(col(feature).isNotNull())
        .groupBy(*keys, spot.alias("_at"))
        .agg(
            F.sum(F.when(complete, col(name).cast("double"))).alias("_sum"),
            F.count_if(complete).alias("_n"),
            F.max(~complete).alias("_asked"),
        )
        .withColumn("_known", F.when(F.col("_n") > 0, 1).otherwise(0))
    )
    placed = running_sum(places, block, ["_at"], "_known", "_place")
    known = placed.filter("_known = 1").select(*keys, "_place", "_at", "_sum", "_n")
    around = placed.filter("_asked").select(
        *keys, F.col("_at").alias("_spot"),
        F.explode(F.sequence(F.greatest(F.lit(1), F.col("_place") - k + 1), F.col("_place") + k)).alias("_place"),
    )
    near = join_groups(around, known, [*block, "_place"], "inner")
    near = near.withColumn("_gap", F.abs(F.col("_at") - F.col("_spot")))
    # at most 2k rows per asked place
    nearest = Window.partitionBy(*keys, "_spot").orderBy("_gap").rangeBetween(Window.unboundedPreceding, 0)
    level = Window.partitionBy(*keys, "_spot", "_gap")
    near = near.withColumn("_nearer", F.sum("_n").over(nearest) - F.sum("_n").over(level))
    fills = near.filter(F.col("_nearer") < k).groupBy(*keys, "_spot").agg(
        F.try_divide(F.sum("_sum"), F.sum("_n")).alias("_fill")
    )
    joined = join_groups(df.withColumn("_spot", spot), fills, [*block, "_spot"])
    return joined.withColumn(name, F.coalesce(col(name), F.col("_fill"))).drop("_fill", "_spot")


def _fill_knn_grid(df: DataFrame, name: str, features: list[str], block: list[str], k: int) -> DataFrame:
    """kNN fill over several features, exact, by a grid that is made coarser for those who are not done.

    Complete rows are summed per distinct place. Cells of a block hold about ``k`` of these on average. A missing place meets the
    places in its own and all neighbouring cells by an equi-join; it is done once its k-th distance is no
    larger than a cell is wide, since whatever lies beyond the neighbours is farther. For the rest the cells become wider, by ever larger
    steps (1, 2, 4, 16, 256 times ...), until neighbours hold the whole block. Rows with a null, NaN or infinite feature are neither filled nor used.
    """
    keys, axes = [col(c) for c in block], range(len(features))
    spots = [col(f).cast("double") for f in features]
    usable = reduce(lambda a, b: a & b, [s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")) for s in spots])
    complete = col(name).isNotNull()
    places = written(
        df.filter(usable).groupBy(*keys, *[(s + F.lit(0.0)).alias(f"_at{i}") for i, s in enumerate(spots)]).agg(
            F.sum(F.when(complete, col(name).cast("double"))).alias("_sum"), F.count_if(complete).alias("_n"),
            F.max(~complete).alias("_asked"),
        ), "knn-places",
    )
    known = places.filter("_n > 0")
    spans = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_places"),
        *[F.min(f"_at{i}").alias(f"_low{i}") for i in axes], *[F.max(f"_at{i}").alias(f"_high{i}") for i in axes],
    )
    per_axis = F.greatest(F.lit(1.0), F.pow(F.col("_places") / k, F.lit(1 / len(features))))
    spans = spans.select(
        *keys, *[f"_low{i}" for i in axes], *[f"_high{i}" for i in axes],
        *[F.when(F.col(f"_high{i}") > F.col(f"_low{i}"), (F.col(f"_high{i}") - F.col(f"_low{i}")) / per_axis).otherwise(1.0).alias(f"_width{i}") for i in axes],
    )
    known = join_groups(known.select(*keys, "_sum", "_n", *[f"_at{i}" for i in axes]), spans, block, "inner")
    waiting = join_groups(places.filter("_asked").select(*keys, *[f"_at{i}" for i in axes]), spans, block, "inner")
    waiting = written(waiting.withColumn("_id", F.monotonically_increasing_id()), "knn-waiting")
    fills, coarser = [], 0
    while not waiting.isEmpty():
        scale = float(2**coarser)
        # places far outside the known ones only need to be told from these
        number = lambda i, at: F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), (F.col(at) - F.col(f"_low{i}")) / (F.col(f"_width{i}") * scale))))
        cell = [number(i, f"_at{i}") for i in axes]
        cells = known.select(*keys, "_sum", "_n", *[F.col(f"_at{i}").alias(f"_is{i}") for i in axes], *[c.alias(f"_cell{i}") for i, c in enumerate(cell)])
        around = waiting
        for i, c in enumerate(cell):
            around = around.withColumn(f"_cell{i}", F.explode(F.sequence(c - 1, c + 1)))
        near = join_groups(around, cells, [*block, *[f"_cell{i}" for i in axes]], "inner")
        gap = reduce(lambda a, b: a + b, [(F.col(f"_at{i}") - F.col(f"_is{i}")) * (F.col(f"_at{i}") - F.col(f"_is{i}")) for i in axes])
        sums = near.withColumn("_gap", gap).groupBy("_id", "_gap").agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
        upto = Window.partitionBy("_id").orderBy("_gap")
        sums = sums.withColumn("_nearer", F.sum("_n").over(upto) - F.col("_n")).filter(F.col("_nearer") < k)
        found = sums.groupBy("_id").agg(
            F.max("_gap").alias("_farthest"), F.sum("_n").alias("_met"), F.try_divide(F.sum("_sum"), F.sum("_n")).alias("_fill")
        )
        reach = F.least(*[F.col(f"_width{i}") * scale for i in axes])
        # the neighbours hold every known place of the block
        covers = reduce(lambda x, y: x & y, [(c <= 1) & (c + 1 >= number(i, f"_high{i}")) for i, c in enumerate(cell)])
        done = (F.col("_met") >= k) & (F.col("_farthest") <= reach * reach)
        judged = written(
            waiting.join(found.withColumnRenamed("_id", "_of"), F.col("_id") == F.col("_of"), "left").withColumn(
                "_done", F.coalesce(done, F.lit(False)) | covers
            ), "knn-round",
        )
        fills.append(judged.filter("_done").select(*keys, *[f"_at{i}" for i in axes], "_fill"))
        waiting = judged.filter("not _done").drop("_of", "_farthest", "_met", "_fill", "_done")
        coarser = max(1, 2 * coarser)
    rows = df.withColumns({f"_at{i}": F.when(usable, s + F.lit(0.0)) for i, s in enumerate(spots)})
    if not fills:
        return df.withColumn(name, col(name).cast("double"))
    filled = reduce(DataFrame.unionByName, fills)
    joined = join_groups(rows, filled, [*block, *[f"_at{i}" for i in axes]])
    return joined.withColumn(name, F.coalesce(col(name), F.col("_fill"))).drop("_fill", *[f"_at{i}" for i in axes])


def drop_null_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def clean_target(df: DataFrame, name: str) -> DataFrame:
    """The asked-for metric is never filled; rows without it go."""
    return df.filter(col(name).isNotNull())


def drop_sparse_columns(df: DataFrame, profile: DataFrame, max_null: float = DROP_COLUMN_ABOVE) -> DataFrame:
    """Drop columns whose share of nulls is above ``max_null`` (the profile holds one row per column)."""
    sparse = [r["name"] for r in profile.filter(F.col("null_pct") > max_null).select("name").collect()]
    return df.drop(*sparse)


# outliers and scale


def remove_outliers_iqr(
    df: DataFrame, name: str, by: str | Sequence[str] | None = None, k: float = 1.5, exact: bool = True
) -> DataFrame:
    """Keep rows inside the quartile fences; missing values stay."""
    by = as_list(by)
    stats = wide_quantiles(df, name, {"_q1": 0.25, "_q3": 0.75}, by, exact)
    reach = (F.col("_q3") - F.col("_q1")) * k
    inside = col(name).between(F.col("_q1") - reach, F.col("_q3") + reach)
    return _with_stats(df, stats, by).filter(inside | col(name).isNull()).drop("_q1", "_q3")


def remove_outliers_z(df: DataFrame, name: str, by: str | Sequence[str] | None = None, z: float = 3.0) -> DataFrame:
    """Keep rows within ``z`` standard deviations; a group without a deviation keeps its rows."""
    by = as_list(by)
    stats = df.groupBy(*[col(c) for c in by]).agg(
        F.avg(col(name)).alias("_mean"), F.stddev_samp(col(name)).alias("_std")
    )
    far = F.abs(col(name) - F.col("_mean")) > F.col("_std") * z
    return _with_stats(df, stats, by).filter(~F.coalesce(far, F.lit(False))).drop("_mean", "_std")


def normalize(df: DataFrame, name: str, method: str = "min_max", by: str | Sequence[str] | None = None) -> DataFrame:
    """Rescale to 0..1 (``min_max``) or to deviations from the mean (``z``); NULL where there is no spread."""
    by = as_list(by)
    c = col(name)
    if method == "min_max":
        aggs = [F.min(c).alias("_base"), (F.max(c) - F.min(c)).cast("double").alias("_spread")]
    elif method == "z":
        aggs = [F.avg(c).alias("_base"), F.stddev_samp(c).alias("_spread")]
    else:
        raise ValueError("method is 'min_max' or 'z'")
    stats = df.groupBy(*[col(b) for b in by]).agg(*aggs)
    scaled = F.try_divide(c - F.col("_base"), F.col("_spread"))
    return _with_stats(df, stats, by).withColumn(name, scaled).drop("_base", "_spread")


# casts and text


def numeric_text(text: Column) -> Column:
    """``$1,234.00``, ``1.2K`` or ``(12)`` as a number; anything else NULL.

    A comma behind points that mark thousands, or a lone one with one or two digits behind it, is a decimal
    comma (``€1.234,56``, ``12,5``); other commas mark thousands.
    """
    bare = F.upper(F.regexp_replace(F.trim(text), r"[$€₹\s]", ""))
    minus = bare.rlike(r"^\(.*\)$")
    bare = F.when(minus, F.regexp_extract(bare, r"^\((.*)\)$", 1)).otherwise(bare)
    comma = bare.rlike(r"^[-+]?([0-9]{1,3}(\.[0-9]{3})+,[0-9]+|[0-9]+,[0-9]{1,2})[KMB]?$")
    bare = F.when(comma, F.translate(bare, ",.", ".")).otherwise(F.translate(bare, ",", ""))
    factor = F.when(bare.endswith("K"), 1e3).when(bare.endswith("M"), 1e6).when(bare.endswith("B"), 1e9).otherwise(1.0)
    number = F.regexp_replace(bare, "[KMB]$", "")
    plain = number.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)(E[-+]?[0-9]+)?$")
    value = F.when(plain, number.try_cast("double") * factor)
    return F.when(minus, -value).otherwise(value)


def cast_numeric(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, numeric_text(col(name)))


def cast_boolean(df: DataFrame, name: str) -> DataFrame:
    text = F.lower(F.trim(col(name)))
    flag = F.when(text.isin("true", "t", "yes", "y", "1"), True).when(text.isin("false", "f", "no", "n", "0"), False)
    return df.withColumn(name, flag)


def parse_currency(df: DataFrame, name: str, amount: str = "amount", code: str = "currency") -> DataFrame:
    """Split text such as ``€1,200.50`` or ``INR 300`` into an amount and a currency code."""
    text = F.upper(F.trim(col(name)))
    word = F.regexp_extract(text, r"(USD|EUR|INR)", 1)
    symbol = F.when(text.contains("$"), "USD").when(text.contains("€"), "EUR").when(text.contains("₹"), "INR")
    number = numeric_text(F.regexp_replace(text, "USD|EUR|INR", ""))
    return df.withColumn(amount, number).withColumn(code, F.coalesce(F.nullif(word, F.lit("")), symbol))


def trim_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Remove surrounding white space; blank text becomes NULL."""
    bare = {c: F.regexp_replace(col(c), r"^\s+|\s+$", "") for c in cols}
    return df.withColumns({c: F.nullif(v, F.lit("")) for c, v in bare.items()})


def parse_dates(df: DataFrame, name: str, formats: Sequence[str]) -> DataFrame:
    """The first format that fits gives the date; text that fits none becomes NULL."""
    return df.withColumn(name, F.coalesce(*[F.try_to_date(col(name), f) for f in formats]))


def repair_encoding(df: DataFrame, bytes_col: str, text_col: str = "text") -> DataFrame:
    """Bytes to text: UTF-8 where valid, Latin-1 otherwise; no byte-order mark, line ends as ``\\n``."""
    raw = col(bytes_col)
    valid = F.is_valid_utf8(raw.cast("string"))
    text = F.when(valid, raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))
    text = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n", "\n")
    return df.withColumn(text_col, text).withColumn("was_repaired", ~valid)


# duplicates and impossible values


def deduplicate(df: DataFrame, subset: Sequence[str] | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """Drop exact copies, or keep the latest row (by ``order_by``) per ``subset``.

    Both are aggregations that combine map-side, so a key with very many copies is not gathered.
    """
    if subset is None:
        return df.distinct()
    if not order_by:
        return df.dropDuplicates(list(subset))
    whole = F.struct(*[col(c) for c in df.columns])
    latest = df.groupBy(*[col(c) for c in subset]).agg(
        F.max_by(whole, F.struct(*[col(c) for c in order_by])).alias("_row")
    )
    return latest.select("_row.*")


def quarantine(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Add ``reasons``: the names of the rules (SQL conditions for a bad row) that a row breaks."""
    marks = F.array(*[F.when(F.expr(bad), F.lit(name)) for name, bad in rules.items()])
    return df.withColumn("reasons", F.filter(marks, lambda r: r.isNotNull()))


def accepted(marked: DataFrame) -> DataFrame:
    return marked.filter(F.size("reasons") == 0).drop("reasons")


def rejected(marked: DataFrame) -> DataFrame:
    return marked.filter(F.size("reasons") > 0)


# names


def safe_names(names: Sequence[str]) -> list[str]:
    """Unique snake_case names for the given ones, in order."""
    taken: set[str] = set()
    out = []
    for name in names:
        base = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
        base = re.sub(r"[^0-9a-zA-Z]+", "_", base).strip("_").lower() or "column"
        if base[0].isdigit():
            base = f"c_{base}"
        pick, n = base, 1
        while pick in taken:
            n += 1
            pick = f"{base}_{n}"
        taken.add(pick)
        out.append(pick)
    return out


def sanitize_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Rename all columns to safe names; also returns safe name -> original name."""
    names = safe_names(df.columns)
    return df.toDF(*names), dict(zip(names, df.columns))


# plan, log and score


def column_skewness(df: DataFrame) -> DataFrame:
    """Skewness of every numeric column in one aggregation."""
    numbers = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    if not numbers:
        return df.sparkSession.createDataFrame([], "name string, skewness double")
    wide = df.agg(*[F.skewness(col(c)).alias(f"s_{i}") for i, c in enumerate(numbers)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(f"s_{i}").alias("skewness")) for i, c in enumerate(numbers)
    ])))


def plan_cleaning(profile: DataFrame, skewness: DataFrame | None = None) -> DataFrame:
    """The cleaning steps a profile calls for: one row per column and operation."""
    if skewness is not None:
        profile = profile.join(skewness, "name", "left")
    else:
        profile = profile.withColumn("skewness", F.lit(None).cast("double"))
    numeric = F.col("dtype").rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
    nulls = F.col("null_pct")

    def step(operation: str, strategy: str, why: str) -> Column:
        return F.struct(
            F.lit(operation).alias("operation"), F.lit(strategy).alias("strategy"), F.lit(why).alias("rationale")
        )

    missing = (
        F.when(nulls == 0, F.lit(None))
        .when(F.col("is_target_metric"), step("fill_null", "drop", "rows without the asked-for metric are dropped"))
        .when(nulls < DROP_ROWS_BELOW, step("fill_null", "drop", "few nulls: drop the rows"))
        .when(nulls > DROP_COLUMN_ABOVE, step("drop_column", "drop", "too many nulls: drop the column"))
        .when(numeric, step("fill_null", "median", "numeric column: fill with the median"))
        .otherwise(step("fill_null", "mode", "categorical column: fill with the mode"))
    )
    measured = numeric & ~F.col("is_primary_key") & (nulls <= DROP_COLUMN_ABOVE)
    outliers = F.when(
        measured & (F.abs("skewness") < 1), step("remove_outlier", "iqr", "close to symmetric: quartile fences")
    ).when(measured & (F.abs("skewness") >= 1), step("remove_outlier", "z_score", "skewed: distance from the mean"))
    steps = F.filter(F.array(missing, outliers), lambda s: s.isNotNull())
    return profile.select(F.col("name").alias("column"), F.explode(steps).alias("s")).select("column", "s.*")


def _null_counts(df: DataFrame, columns: Sequence[str], side: str) -> DataFrame:
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            (F.count(F.lit(1)) - F.count(col(c)) if c in df.columns else F.lit(0)).alias(f"n_{i}")
            for i, c in enumerate(columns)
        ],
    )
    return wide.select(
        F.col("rows").alias(f"rows_{side}"),
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"n_{i}").cast("bigint").alias(f"{side}_nulls"))
            for i, c in enumerate(columns)
        ])),
    )


def cleaning_log(before: DataFrame, after: DataFrame | Sequence[DataFrame], ops: Sequence[dict[str, str]]) -> DataFrame:
    """One row per operation with nulls before and after; a single aggregation over each table.

    ``after`` is the table after all operations, or the tables after each of them in turn. ``rows_affected`` is the number
    of rows removed for row-removing strategies, else of nulls resolved; several operations that remove rows can only be
    told apart by their own tables.
    """
    if not isinstance(after, DataFrame):
        if len(after) != len(ops):
            raise ValueError("give one table per operation")
        steps = [cleaning_log(a, b, [op]) for a, b, op in zip([before, *after[:-1]], after, ops)]
        return reduce(DataFrame.unionByName, steps)
    if sum(op.get("strategy") in ROW_REMOVING for op in ops) > 1:
        raise ValueError("several operations remove rows; give the table after each operation")
    columns = sorted({op["column"] for op in ops})
    listed = F.array(*[
        F.struct(*[F.lit(op.get(k, "")).alias(k) for k in ("column", "operation", "strategy", "rationale")])
        for op in ops
    ])
    a = _null_counts(before, columns, "before")
    b = _null_counts(after, columns, "after")
    steps = before.sparkSession.range(1).select(F.inline(listed))
    joined = steps.join(a, "column").join(b, "column")
    removed = F.col("strategy").isin(*ROW_REMOVING) & (F.col("operation") != "drop_column")
    changed = F.when(removed, F.col("rows_before") - F.col("rows_after")).otherwise(
        F.abs(F.col("before_nulls") - F.col("after_nulls"))
    )
    return joined.select(
        "column", "operation", "strategy", changed.cast("bigint").alias("rows_affected"), "before_nulls",
        "after_nulls", "rationale",
        ((F.col("after_nulls") <= F.col("before_nulls")) & (F.col("rows_after") <= F.col("rows_before"))).alias(
            "is_consistent"
        ),
    )


def quality_score(df: DataFrame, expected_types: dict[str, str], weights: tuple = (0.5, 0.25, 0.25)) -> DataFrame:
    """Completeness, uniqueness of rows and type consistency, and their weighted mean, as one row.

    Equal rows meet by a 256-bit digest, so only digests and sums are shuffled, combined map-side.
    """
    zero = lambda c: col(c) + F.lit(0.0) if isinstance(df.schema[c].dataType, T.FractionalType) else col(c)
    # adding nothing turns a negative zero into a plain one
    cells = F.struct(*[zero(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    digest = F.sha2(F.to_json(cells, EXACT_JSON), 256)
    filled = sum((col(c).isNotNull().cast("bigint") for c in df.columns), F.lit(0))
    typed = sum((col(c).isNotNull().cast("bigint") for c in expected_types), F.lit(0))
    fits = sum((col(c).try_cast(t).isNotNull().cast("bigint") for c, t in expected_types.items()), F.lit(0))
    groups = df.groupBy(digest.alias("_digest")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(filled).alias("filled"), F.sum(typed).alias("typed"), F.sum(fits).alias("fits")
    )
    totals = groups.agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"), F.sum("filled").alias("filled"),
        F.sum("typed").alias("typed"), F.sum("fits").alias("fits"),
    )
    shares = totals.select(
        F.coalesce(F.try_divide("filled", F.col("rows") * len(df.columns)), F.lit(0.0)).alias("completeness"),
        F.coalesce(F.try_divide("distinct_rows", "rows"), F.lit(0.0)).alias("uniqueness"),
        F.coalesce(F.try_divide("fits", "typed"), F.lit(1.0)).alias("type_consistency"),
    )
    score = (
        F.col("completeness") * weights[0] + F.col("uniqueness") * weights[1] + F.col("type_consistency") * weights[2]
    )
    return shares.withColumn("quality", score)

