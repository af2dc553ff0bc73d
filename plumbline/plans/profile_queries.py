"""Registered queries for the column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.fixed_values import CONSUMER_FIELDS
from plumbline.operators import mergeable, profile
from plumbline.plans.registry import query, table
from plumbline.session import shared_folder

COLUMNS = {
    "customer": [
        ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
        ("c_mktsegment", "string"),
    ],
    "events": [
        ("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
        ("value", "double"), ("props", "string"),
    ],
    "lineitem": [
        ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
        ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
        ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
    ],
    "orders": [
        ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
        ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
    ],
}
NUMBERS = ("bigint", "int", "double")


def _per_column(name: str, one) -> str:
    return " UNION ALL ".join(f"({one(c, t)} FROM {name})" for c, t in COLUMNS[name])


def _summary_sql(name: str) -> str:
    def one(c: str, t: str) -> str:
        if t in NUMBERS:
            stats = (
                f"round(avg({c}), 4) AS avg, round(stddev_samp({c}), 4) AS std, "
                f"round(quantile_cont({c}, 0.25)::DOUBLE, 4) AS q25, round(quantile_cont({c}, 0.5)::DOUBLE, 4) AS q50, "
                f"round(quantile_cont({c}, 0.75)::DOUBLE, 4) AS q75"
            )
        else:
            stats = ", ".join(f"NULL::DOUBLE AS {n}" for n in ("avg", "std", "q25", "q50", "q75"))
        return (
            f"SELECT '{c}' AS column_name, '{t}' AS column_type, min({c})::VARCHAR AS min, max({c})::VARCHAR AS max, "
            f"count(DISTINCT {c}) AS approx_unique, {stats}, count(*) AS count, "
            f"100.0::DOUBLE * (count(*) - count({c})) / count(*) AS null_percentage"
        )

    return _per_column(name, one)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 4) for n in names})


@query(
    "profile_describe",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS column_type, true AS nullable, count(*) AS row_count FROM events"
        for c, t in COLUMNS["events"]
    ),
)
def profile_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.describe_schema(table(spark, sf_dir, "events"))


@query("profile_sample", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def profile_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.sample_rows(table(spark, sf_dir, "orders"), 5, order_by="o_orderkey")


def _summary(name: str) -> None:
    @query(f"profile_summary_{name}", _summary_sql(name))
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(
            profile.summarize(table(spark, sf_dir, name), exact=True), "avg", "std", "q25", "q50", "q75"
        )


_summary("events")
_summary("lineitem")


@query("profile_summary_sketch")
def profile_summary_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default summary: one aggregation with sketches (its closeness to the exact one is unit-tested)."""
    return profile.summarize(table(spark, sf_dir, "lineitem"))


@query("profile_columns_sketch")
def profile_columns_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile with sketched distinct counts, for wide or very large tables."""
    return profile.profile_columns(table(spark, sf_dir, "lineitem"), exact=False, order_by="l_orderkey")


def _profile_sql(name: str, key: str, where: str = "") -> str:
    def one(c: str, t: str) -> str:
        samples = (
            f"(SELECT string_agg({c}::VARCHAR, '|' ORDER BY {key}) FROM "
            f"(SELECT {c}, {key} AS {key}_ FROM {name} {where} ORDER BY {key} LIMIT 5))"
        ).replace(f"ORDER BY {key})", f"ORDER BY {key}_)")
        return (
            f"SELECT '{c}' AS name, '{c}' AS original_name, '{t}' AS dtype, 'unknown' AS semantic_type, "
            f"'' AS business_label, "
            f"CASE WHEN count(*) = 0 THEN 1.0::DOUBLE ELSE round((count(*) - count({c})) / count(*), 4) END AS null_pct, "
            f"CASE WHEN count(*) = 0 THEN 0.0::DOUBLE ELSE round(least(1.0::DOUBLE, count(DISTINCT {c}) / count(*)), 4) END "
            f"AS unique_pct, coalesce({samples}, '') AS samples, "
            f"count(*) > 0 AND count(*) = count({c}) AND count(DISTINCT {c}) / count(*) > 0.99 AS is_primary_key, "
            f"false AS is_target_metric FROM {name} {where}"
        )

    return " UNION ALL ".join(f"({one(c, t)})" for c, t in COLUMNS[name])


def _flat_profile(df: DataFrame) -> DataFrame:
    return df.withColumn("samples", F.array_join("sample_values", "|")).drop("sample_values")


@query("profile_columns_customer", _profile_sql("customer", "c_custkey"))
def profile_columns_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_profile(profile.profile_columns(table(spark, sf_dir, "customer"), order_by="c_custkey"))


@query("profile_columns_orders", _profile_sql("orders", "o_orderkey"))
def profile_columns_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_profile(profile.profile_columns(table(spark, sf_dir, "orders"), order_by="o_orderkey"))


@query("profile_empty_table", _profile_sql("customer", "c_custkey", "WHERE c_acctbal > 1e12"))
def profile_empty_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = table(spark, sf_dir, "customer").filter("c_acctbal > 1e12")
    return _flat_profile(profile.profile_columns(none, order_by="c_custkey"))


@query(
    "profile_candidate_keys",
    f"""
    SELECT name, unique_pct FROM ({_profile_sql('events', 'event_id')}) WHERE is_primary_key
    """,
)
def profile_candidate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.candidate_keys(table(spark, sf_dir, "events"))


def _typed(df: DataFrame, entities: list[str] | None = None) -> DataFrame:
    prof = profile.profile_columns(df, order_by=df.columns[0])
    prof = profile.business_labels(profile.infer_semantic_types(prof, profile.text_lengths(df)))
    return profile.flag_target_metrics(prof, entities) if entities else prof


@query(
    "profile_semantic_types",
    """
    WITH shares AS (
      SELECT count(DISTINCT c_custkey) / count(*) AS k, count(DISTINCT c_name) / count(*) AS n,
        count(DISTINCT c_mktsegment) / count(*) AS m,
        avg(length(c_name)) AS ln, avg(length(c_mktsegment)) AS lm
      FROM customer)
    SELECT 'c_custkey' AS name, CASE WHEN k > 0.99 THEN 'identifier' ELSE 'metric' END AS semantic_type,
      'C Custkey' AS business_label, false AS is_target_metric, false AS is_ambiguous FROM shares
    UNION ALL SELECT 'c_name', CASE WHEN n > 0.99 THEN 'identifier' WHEN ln > 50 THEN 'text_description'
      WHEN n <= 0.5 THEN 'dimension' ELSE 'unknown' END, 'C Name', false, false FROM shares
    UNION ALL SELECT 'c_nationkey', 'geographic', 'C Nationkey', false, false FROM shares
    UNION ALL SELECT 'c_acctbal', 'currency', 'C Acctbal', true, false FROM shares
    UNION ALL SELECT 'c_mktsegment', CASE WHEN lm > 50 THEN 'text_description' WHEN m <= 0.5 THEN 'dimension'
      ELSE 'unknown' END, 'C Mktsegment', false, false FROM shares
    """,
)
def profile_semantic_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    prof = profile.flag_ambiguous_names(_typed(table(spark, sf_dir, "customer"), ["AcctBal", "profit"]))
    return prof.select("name", "semantic_type", "business_label", "is_target_metric", "is_ambiguous")


@query(
    "profile_compact",
    f"""
    SELECT name, '| ' || rpad(substr(name, 1, 20), 20, ' ') || ' | ' || dtype || ' | unknown | '
      || round(null_pct * 100)::INTEGER || '% | ' || array_to_string(list_slice(string_split(samples, '|'), 1, 2), ', ')
      || ' |' AS line
    FROM ({_profile_sql('orders', 'o_orderkey')})
    """,
)
def profile_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.compact_profile(profile.profile_columns(table(spark, sf_dir, "orders"), order_by="o_orderkey"))


@query(
    "profile_fingerprints",
    """
    SELECT user_id, sha256(string_agg(part, ',' ORDER BY part)) AS fingerprint, count(*) AS column_count
    FROM (SELECT DISTINCT user_id, event_type || ':' || CASE WHEN value < 20 THEN 'int' ELSE 'double' END AS part
          FROM events)
    GROUP BY user_id
    """,
)
def profile_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user stands for a dataset, the event types seen for its columns."""
    columns = table(spark, sf_dir, "events").select(
        "user_id", "event_type", F.when(F.col("value") < 20, "int").otherwise("double").alias("dtype")
    )
    return profile.fingerprint_catalog(columns, "user_id", "event_type", "dtype")


@query(
    "profile_consumer_view",
    "SELECT raw_query, raw_row_count, raw_col_count FROM (SELECT text AS raw_query, doc_id AS raw_row_count, "
    "n_chars AS raw_col_count, lang AS hidden FROM documents)",
)
def profile_consumer_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The router sees its listed fields only; one it may see but that is missing is left out."""
    state = table(spark, sf_dir, "documents").select(
        F.col("text").alias("raw_query"), F.col("doc_id").alias("raw_row_count"),
        F.col("n_chars").alias("raw_col_count"), F.col("lang").alias("hidden"),
    )
    return profile.project_for(state, "router", CONSUMER_FIELDS)


@query(
    "profile_summary_text",
    f"""
    SELECT column_name, column_type, coalesce(replace(min, chr(10), ' '), 'N/A') AS min,
      coalesce(replace(max, chr(10), ' '), 'N/A') AS max, approx_unique::VARCHAR AS approx_unique,
      coalesce(printf('%.3f', avg), 'N/A') AS avg, coalesce(printf('%.3f', std), 'N/A') AS std,
      coalesce(printf('%.3f', q25), 'N/A') AS q25, coalesce(printf('%.3f', q50), 'N/A') AS q50,
      coalesce(printf('%.3f', q75), 'N/A') AS q75, count::VARCHAR AS count,
      printf('%.3f', null_percentage) AS null_percentage
    FROM ({_summary_sql('orders')})
    """,
)
def profile_summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = profile.summarize(table(spark, sf_dir, "orders"), exact=True)
    return profile.summary_as_text(_rounded(summary, "avg", "std", "q25", "q50", "q75"))


@query(
    "profile_merged_days",
    """
    WITH l AS (
      SELECT 'event_id' AS column_name, event_id::DOUBLE AS v, event_id::VARCHAR AS t FROM events
      UNION ALL SELECT 'user_id', user_id::DOUBLE, user_id::VARCHAR FROM events
      UNION ALL SELECT 'value', value, value::VARCHAR FROM events
      UNION ALL SELECT 'event_type', NULL, event_type FROM events)
    SELECT column_name, count(*) AS rows, count(*) - count(t) AS nulls, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std,
      true AS distinct_fits, CASE WHEN column_name = 'event_type' THEN NULL ELSE true END AS quartiles_fit
    FROM l GROUP BY column_name
    """,
)
def profile_merged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of days, stored in two runs and merged; the sketched figures are held against exact ones."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type", F.to_date("ts").alias("day"))
    path = shared_folder(spark, "day-profiles")
    mergeable.update_profiles(events.filter("day < '2024-01-16'"), F.col("day"), path)
    merged = mergeable.update_profiles(events, F.col("day"), path).filter("column_name <> 'day'")
    exact = profile.summarize(events.drop("day"), exact=True).select("column_name", F.col("approx_unique").alias("unique"))
    numbers = events.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in ("event_id", "user_id", "value")
    ])))
    # the share of rows below, and up to, each merged quartile
    held = numbers.join(merged.select("column_name", "q25", "q50", "q75"), "column_name").groupBy("column_name").agg(*[
        ((F.avg((F.col("v") < F.col(q)).cast("int")) <= p + mergeable.RANK_ERROR) & (F.avg((F.col("v") <= F.col(q)).cast("int")) >= p - mergeable.RANK_ERROR)).alias(q)
        for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))
    ]).select("column_name", (F.col("q25") & F.col("q50") & F.col("q75")).alias("quartiles_fit"))
    return merged.join(exact, "column_name").join(held, "column_name", "left").select(
        "column_name", "rows", "nulls", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
        (F.abs(F.col("approx_unique") - F.col("unique")) <= 0.05 * F.col("unique")).alias("distinct_fits"), "quartiles_fit",
    )
