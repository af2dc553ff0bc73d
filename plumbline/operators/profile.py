"""Column profiles: schema, samples, statistics, keys, semantic types, fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.fixed_values import KEY_UNIQUE_SHARE, MAX_SAMPLES
from plumbline.functions.frames import (
    as_list, col, is_integral, is_numeric, is_temporal, quoted, text_literal, with_row,
)
from plumbline.operators.quantiles import quantiles_of_counts

LONG_TEXT = 64
SKETCH_ACCURACY = 1000  # rank error of sketched quartiles: one in a thousand rows
#: Relative deviation of the sketches that rule key columns out.
SKETCH_DEVIATION = 0.01


def describe_schema(df: DataFrame) -> DataFrame:
    """Name, type and nullability of every column, with the table's row count."""
    fields = F.array(*[
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("column_type"),
            F.lit(f.nullable).alias("nullable"),
        )
        for f in df.schema.fields
    ])
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(F.inline(fields), "row_count")


def sample_rows(df: DataFrame, n: int = MAX_SAMPLES, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """The first ``n`` rows; pass ``order_by`` for the same rows every time."""
    keys = [col(c) for c in as_list(order_by)]
    return (df.orderBy(*keys) if keys else df).limit(n)


def _cell(field: T.StructField) -> str:
    """One cell as (column name, text identity, whole number, number), in SQL text."""
    c, kind = quoted(field.name), field.dataType
    text, whole, number = "NULL", "NULL", "NULL"
    if is_integral(kind):
        whole, number = c, c
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        number = f"nanvl({c}, NULL)"
        text = f"CASE WHEN isnan({c}) THEN 'NaN' END"
    elif isinstance(kind, T.DecimalType):
        text, number = c, c
    elif is_temporal(kind):
        whole = f"unix_micros(CAST({c} AS TIMESTAMP))"
    elif isinstance(kind, T.BooleanType):
        whole = f"CAST({c} AS INT)"
    elif _is_nested(kind):
        text = f"sha2(to_json({c}), 256)"
    elif isinstance(kind, T.BinaryType):
        text = f"sha2({c}, 256)"
    else:
        # a long text is told apart by its digest, so that distinct counting ships little
        text = f"CASE WHEN length({c}) > {LONG_TEXT} THEN concat('#', sha2({c}, 256)) ELSE CAST({c} AS STRING) END"
    return (
        f"named_struct('column_name', {text_literal(field.name)}, 'txt', CAST({text} AS STRING), "
        f"'whole', CAST({whole} AS BIGINT), 'num', CAST({number} AS DOUBLE))"
    )


def cell_counts(df: DataFrame) -> DataFrame:
    """How often each distinct value of each column occurs: one scan, one map-side-combined shuffle."""
    cells = df.select(F.expr(f"inline(array({', '.join(_cell(f) for f in df.schema.fields)}))"))
    filled = cells.filter("txt IS NOT NULL OR whole IS NOT NULL OR num IS NOT NULL")
    return filled.groupBy("column_name", "txt", "whole", "num").agg(F.count(F.lit(1)).alias("_n"))


def _is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.StructType, T.MapType))


def _base_stats(df: DataFrame, distinct: bool, quartiles: bool) -> DataFrame:
    """A row per column: plain statistics in one aggregation, sketches (where asked for) in a second one.

    Plain figures compile to one tight loop. Sketches in the same aggregation would take that away and cost
    several times the processor time, far more than reading the columns again. The expressions are
    written as SQL text, since a wide table needs very many of them.
    """
    plain, sketches = ["count(1) AS n"], []
    for i, field in enumerate(df.schema.fields):
        c = quoted(field.name)
        plain.append(f"count({c}) AS count_{i}")
        if not _is_nested(field.dataType) and not isinstance(field.dataType, T.BinaryType):
            plain += [f"min({c}) AS min_{i}", f"max({c}) AS max_{i}"]
        if is_numeric(field.dataType):
            plain += [f"avg({c}) AS avg_{i}", f"stddev_samp({c}) AS std_{i}"]
            if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
                plain.append(f"coalesce(max(isnan({c})), false) AS nan_{i}")
            if quartiles:
                sketches.append(
                    f"percentile_approx(CAST({c} AS DOUBLE), array(0.25, 0.5, 0.75), {SKETCH_ACCURACY}) AS q_{i}"
                )
        if distinct:
            seen = f"to_json({c})" if _is_nested(field.dataType) else c
            sketches.append(f"approx_count_distinct({seen}) AS unique_{i}")
    wide = df.agg(*[F.expr(e) for e in plain])
    have = {name: name for name in wide.columns}
    if sketches:
        sketch = df.agg(*[F.expr(e) for e in sketches])
        wide = with_row(wide, sketch, "_sketch")
        have |= {name: f"_sketch.{name}" for name in sketch.columns}

    def get(name: str, kind: str) -> str:
        return f"CAST({have.get(name, 'NULL')} AS {kind})"

    rows = []
    for i, field in enumerate(df.schema.fields):
        q = get(f"q_{i}", "array<double>")
        rows.append(
            f"named_struct('column_name', {text_literal(field.name)}, "
            f"'column_type', {text_literal(field.dataType.simpleString())}, "
            f"'min', {get(f'min_{i}', 'string')}, 'max', {get(f'max_{i}', 'string')}, "
            f"'unique', {get(f'unique_{i}', 'bigint')}, 'avg', {get(f'avg_{i}', 'double')}, "
            f"'std', {get(f'std_{i}', 'double')}, 'q25', get({q}, 0), 'q50', get({q}, 1), 'q75', get({q}, 2), "
            f"'has_nan', {get(f'nan_{i}', 'boolean')}, 'present', count_{i}, 'n', n)"
        )
    return wide.select(F.expr(f"inline(array({', '.join(rows)}))"))


def summarize(df: DataFrame, exact: bool = False) -> DataFrame:
    """Per column: min, max, distinct, mean, deviation, quartiles, row count and null percentage.

    The default sketches distinct counts and quartiles and moves next to nothing between tasks;
    ``exact`` adds one shuffle of value counts that serves both.
    """
    base = _base_stats(df, distinct=not exact, quartiles=not exact)
    if exact:
        base = base.drop("unique", "q25", "q50", "q75").join(_exact_figures(df), "column_name", "left")
    # the value counts leave NaN out; it is one more value
    unique = F.coalesce("unique", F.lit(0)) + (F.when(F.col("has_nan"), 1).otherwise(0) if exact else 0)
    return base.select(
        "column_name", "column_type", "min", "max", unique.cast("bigint").alias("approx_unique"),
        "avg", "std", "q25", "q50", "q75",
        F.col("n").alias("count"),
        F.try_divide((F.col("n") - F.col("present")) * 100.0, F.col("n")).alias("null_percentage"),
    )


def _exact_figures(df: DataFrame) -> DataFrame:
    """Distinct counts of all columns and quartiles of the numeric ones from one shuffle of value counts each."""
    numbers = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    others = [c for c in df.columns if c not in numbers]
    parts = []
    if numbers:
        counts = cell_counts(df.select(*[col(c) for c in numbers])).withColumnRenamed("num", "_v")
        long = quantiles_of_counts(counts.filter("_v IS NOT NULL"), [0.25, 0.5, 0.75], "column_name")
        parts.append(long.groupBy("column_name").agg(F.max("distinct_count").alias("unique"), *[
            F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))
        ]))
    if others:
        counts = cell_counts(df.select(*[col(c) for c in others]))
        parts.append(counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def summary_as_text(summary: DataFrame) -> DataFrame:
    """The summary with every cell rendered: numbers to three places, missing as N/A, line breaks removed."""

    def cell(field: T.StructField) -> Column:
        c = col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            text = F.when(~F.isnan(c), F.regexp_replace(F.format_number(c, 3), ",", ""))
        else:
            text = F.regexp_replace(c.cast("string"), "\n", " ")
            text = F.when(~F.lower(text).isin("nan", "nat"), text)
        return F.coalesce(text, F.lit("N/A")).alias(field.name)

    return summary.select(*[cell(f) for f in summary.schema.fields])


def profile_columns(
    df: DataFrame, exact: bool = True, order_by: str | Sequence[str] | None = None, nan_as_null: bool = False
) -> DataFrame:
    """One row per column: shares of nulls and distinct values, samples, key flag.

    ``exact`` counts distinct values exactly, which the key flag needs; without it a sketch is used.
    Samples are the non-missing values among the first five rows (of ``order_by``).
    """
    if nan_as_null:
        df = df.select(*[
            F.when(~F.isnan(col(f.name)), col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else col(f.name)
            for f in df.schema.fields
        ])
    base = _base_stats(df, distinct=not exact, quartiles=False)
    if exact:
        unique = cell_counts(df).groupBy("column_name").agg(F.count(F.lit(1)).alias("unique"))
        base = base.drop("unique").join(unique, "column_name", "left")
    head = sample_rows(df, MAX_SAMPLES, order_by)

    def shown(field: T.StructField) -> Column:
        c = col(field.name)
        if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            return F.to_json(c)
        return F.when(~F.lower(c.cast("string")).isin("nan", "nat"), c.cast("string"))

    # at most five rows are gathered here
    samples = head.agg(*[F.collect_list(shown(f)).alias(f"s_{i}") for i, f in enumerate(df.schema.fields)]).select(
        F.inline(F.array(*[
            F.struct(F.lit(f.name).alias("column_name"), F.col(f"s_{i}").alias("sample_values"))
            for i, f in enumerate(df.schema.fields)
        ]))
    )
    null_share = F.when(F.col("n") == 0, 1.0).otherwise(F.try_divide(F.col("n") - F.col("present"), F.col("n")))
    unique_share = F.when(F.col("n") == 0, 0.0).otherwise(
        F.least(F.lit(1.0), F.try_divide(F.coalesce("unique", F.lit(0)), F.col("n")))
    )
    return (
        base.join(samples, "column_name", "left")
        .withColumn("_nulls", null_share)
        .withColumn("_unique", unique_share)
        .select(
            F.col("column_name").alias("name"),
            F.col("column_name").alias("original_name"),
            F.col("column_type").alias("dtype"),
            F.lit("unknown").alias("semantic_type"),
            F.lit("").alias("business_label"),
            F.round("_nulls", 4).alias("null_pct"),
            F.round("_unique", 4).alias("unique_pct"),
            F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
            ((F.col("_unique") > KEY_UNIQUE_SHARE) & (F.col("_nulls") == 0)).alias("is_primary_key"),
            F.lit(False).alias("is_target_metric"),
        )
    )


def possible_keys(df: DataFrame) -> list[str]:
    """Columns without nulls whose sketched number of distinct values leaves open that they are unique enough for a key.

    One aggregation of mergeable sketches, a row in all. A key is ruled out with a chance of about one in a million
    (five deviations of the sketch).
    """
    columns = [f.name for f in df.schema.fields]
    seen = [F.to_json(F.struct(col(f.name))) if _is_nested(f.dataType) else col(f.name) for f in df.schema.fields]
    figures = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count(col(c)).alias(f"count_{i}") for i, c in enumerate(columns)],
        *[F.approx_count_distinct(s, SKETCH_DEVIATION).alias(f"distinct_{i}") for i, s in enumerate(seen)],
    ).first()
    least = (KEY_UNIQUE_SHARE - 5 * SKETCH_DEVIATION) * figures["n"]
    return [c for i, c in enumerate(columns) if figures[f"count_{i}"] == figures["n"] and figures[f"distinct_{i}"] >= least]


def candidate_keys(df: DataFrame, exact: bool = True) -> DataFrame:
    """Columns that could serve as a key; with ``exact`` only the cells of ``possible_keys`` are shuffled and counted."""
    if exact:
        df = df.select(*[col(c) for c in possible_keys(df)])
        if not df.columns:
            return df.sparkSession.createDataFrame([], "name string, unique_pct double")
    return profile_columns(df, exact).filter("is_primary_key").select("name", "unique_pct")


def text_lengths(df: DataFrame) -> DataFrame:
    """Mean length of every text column (an input to the semantic types), in one aggregation."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df.sparkSession.createDataFrame([], "name string, mean_length double")
    wide = df.agg(*[F.avg(F.length(col(c))).alias(f"len_{i}") for i, c in enumerate(texts)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(f"len_{i}").alias("mean_length")) for i, c in enumerate(texts)
    ])))


def infer_semantic_types(profile: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Fill ``semantic_type`` by name, type and uniqueness; the first rule that applies wins.

    A fractional number is never taken for an identifier, however unique its values.
    """
    name, dtype = F.lower("name"), F.col("dtype")
    numeric = dtype.rlike(r"^(tinyint|smallint|int|bigint|float|double|decimal)")
    fractional = dtype.rlike("^(float|double|decimal)")
    if lengths is not None:
        profile = profile.join(lengths, "name", "left")
    else:
        sample_length = F.aggregate(
            F.col("sample_values"), F.lit(0.0), lambda acc, v: acc + F.length(v), lambda acc: acc
        )
        profile = profile.withColumn("mean_length", F.try_divide(sample_length, F.size("sample_values")))
    flags = F.filter("sample_values", lambda v: F.lower(v).isin("true", "false", "yes", "no", "0", "1"))
    all_flags = (F.size("sample_values") > 0) & (F.size(flags) == F.size("sample_values")) & (F.col("unique_pct") < 0.5)
    kind = (
        F.when((dtype == "boolean") | (all_flags & (dtype == "string")), "boolean")
        .when(
            dtype.rlike("^(date|timestamp)") | name.rlike("(^|_)(date|time|ts|day|month|year)($|_)"), "date"
        )
        .when((F.col("is_primary_key") & ~fractional) | name.rlike("(^|_)(id|key)$"), "identifier")
        .when(numeric & name.rlike("price|cost|revenue|sales|amount|bal|salary|charge"), "currency")
        .when(numeric & name.rlike("pct|percent|rate|ratio|discount|tax"), "percentage")
        .when(name.rlike("country|region|nation|city|state|zip|lat|lon"), "geographic")
        .when(numeric, "metric")
        .when((dtype == "string") & (F.col("mean_length") > 50), "text_description")
        .when((dtype == "string") & (F.col("unique_pct") <= 0.5), "dimension")
        .otherwise("unknown")
    )
    return profile.withColumn("semantic_type", kind).drop("mean_length")


def business_labels(profile: DataFrame) -> DataFrame:
    """Fill ``business_label`` with a readable form of the column name."""
    words = F.regexp_replace(F.regexp_replace("name", r"([a-z0-9])([A-Z])", "$1 $2"), r"[_\s]+", " ")
    return profile.withColumn("business_label", F.initcap(F.trim(words)))


def flag_target_metrics(profile: DataFrame, entities: Sequence[str]) -> DataFrame:
    """Mark the columns the question names."""
    named = F.exists(
        F.array(*[F.lit(e.lower()) for e in entities]).cast("array<string>"), lambda e: F.lower("name").contains(e)
    )
    return profile.withColumn("is_target_metric", named)


def flag_ambiguous_names(profile: DataFrame) -> DataFrame:
    """Mark names such as ``col1`` or ``value`` that say nothing about their content."""
    return profile.withColumn(
        "is_ambiguous", F.lower("name").rlike(r"^(col|c|x|v|field|data|value)[0-9]*$")
    )


def compact_profile(profile: DataFrame) -> DataFrame:
    """One short line per column: name in 20 characters, type, semantic type, null percent, two samples."""
    name = F.rpad(F.substring("name", 1, 20), 20, " ")
    # bround rounds halves to even, as the percentage format it reproduces does
    share = F.concat(F.bround(F.col("null_pct") * 100, 0).cast("int").cast("string"), F.lit("%"))
    line = F.concat(
        F.lit("| "), name, F.lit(" | "), F.col("dtype"), F.lit(" | "), F.col("semantic_type"), F.lit(" | "),
        share, F.lit(" | "), F.concat_ws(", ", F.slice("sample_values", 1, 2)), F.lit(" |"),
    )
    return profile.select("name", line.alias("line"))


def schema_fingerprint(df: DataFrame) -> str:
    """SHA-256 over sorted column names and types; the order of columns does not matter."""
    parts = sorted(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def fingerprint_catalog(columns: DataFrame, dataset: str, name: str, dtype: str) -> DataFrame:
    """The fingerprint of every dataset in a table of columns (a dataset's columns form one short list)."""
    parts = columns.select(col(dataset), F.concat(col(name), F.lit(":"), col(dtype)).alias("_part")).distinct()
    return parts.groupBy(col(dataset)).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list("_part")), ","), 256).alias("fingerprint"),
        F.count(F.lit(1)).alias("column_count"),
    )


def project_for(df: DataFrame, consumer: str, allow: dict[str, list[str]]) -> DataFrame:
    """Only the columns a consumer may see; ``*`` is all, an unknown consumer gets none."""
    fields = allow.get(consumer, [])
    if fields == ["*"]:
        return df
    return df.select(*[col(c) for c in fields if c in df.columns])

