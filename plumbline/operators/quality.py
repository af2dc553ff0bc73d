"""Checks on tables, results and runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.fixed_values import APPROVE_AT, MAX_SAMPLES, REJECT_BELOW
from plumbline.functions.frames import col


@dataclass(frozen=True)
class Rule:
    """An expectation: ``kind`` is range, not_null, unique, allowed or ordered."""

    name: str
    kind: str
    column: str
    low: float | None = None
    high: float | None = None
    values: tuple = ()
    later: str | None = None


def _broken(rule: Rule) -> Column:
    c = col(rule.column)
    if rule.kind == "range":
        tests = []
        if rule.low is not None:
            tests.append(c < rule.low)
        if rule.high is not None:
            tests.append(c > rule.high)
        return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))
    if rule.kind == "not_null":
        return c.isNull()
    if rule.kind == "allowed":
        return F.coalesce(~c.isin(*rule.values), F.lit(False))
    if rule.kind == "ordered":
        return F.coalesce(col(rule.later) < c, F.lit(False))
    raise ValueError(f"unknown kind of rule {rule.kind}")


def check_expectations(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Failing rows and their share per rule: all row rules in one aggregation, all unique columns in another."""
    row_rules = [r for r in rules if r.kind != "unique"]
    parts = []
    if row_rules:
        wide = df.agg(
            F.count(F.lit(1)).alias("rows"), *[F.count_if(_broken(r)).alias(f"f_{i}") for i, r in enumerate(row_rules)]
        )
        parts.append(wide.select(
            "rows",
            F.inline(F.array(*[
                F.struct(F.lit(r.name).alias("rule"), F.col(f"f_{i}").alias("failing")) for i, r in enumerate(row_rules)
            ])),
        ))
    unique = [r for r in rules if r.kind == "unique"]
    if unique:
        cells = F.array(*[F.struct(F.lit(i).alias("i"), col(r.column).cast("string").alias("value")) for i, r in enumerate(unique)])
        copies = df.select(F.inline(cells)).groupBy("i", "value").agg(F.count(F.lit(1)).alias("n"))
        repeated = F.when((F.col("n") > 1) & F.col("value").isNotNull(), F.col("n"))
        counted = copies.groupBy("i").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(repeated), F.lit(0)).alias("failing"))
        # a row per rule also for an empty table
        listed = df.sparkSession.createDataFrame([(i, r.name) for i, r in enumerate(unique)], "i int, rule string")
        parts.append(listed.join(counted, "i", "left").select(
            F.coalesce("rows", F.lit(0)).alias("rows"), "rule", F.coalesce("failing", F.lit(0)).alias("failing")
        ))
    all_rules = reduce(DataFrame.unionByName, parts)
    return all_rules.select(
        "rule", "failing", F.coalesce(F.try_divide("failing", "rows"), F.lit(0.0)).alias("share"),
        (F.col("failing") == 0).alias("passed"),
    )


def completeness(df: DataFrame) -> DataFrame:
    """Non-null cells as a share of all cells."""
    filled = reduce(lambda a, b: a + b, [F.count(col(c)) for c in df.columns])
    cells = F.count(F.lit(1)) * len(df.columns)
    return df.agg(filled.alias("filled_cells"), cells.alias("all_cells")).withColumn(
        "completeness", F.coalesce(F.try_divide("filled_cells", "all_cells"), F.lit(0.0))
    )


def approve(scores: DataFrame, confidence: str, quality: str, injection: str) -> DataFrame:
    """Add ``approval_status`` to a table of scores."""
    status = (
        F.when(col(injection) | (col(quality) < REJECT_BELOW), "rejected")
        .when(col(confidence) >= APPROVE_AT, "approved")
        .otherwise("needs_review")
    )
    return scores.withColumn("approval_status", status)


def gauntlet_report(runs: DataFrame, previous: DataFrame) -> DataFrame:
    """Per dataset the run counts, mean quality, pass rate and its change against the previous run.

    Both inputs have ``dataset``, ``status`` (success, partial, failed), ``quality`` and ``elapsed``.
    """

    def rates(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("dataset").agg(
            F.count(F.lit(1)).alias(f"runs{tag}"),
            F.avg((F.col("status") == "success").cast("double")).alias(f"pass_rate{tag}"),
            F.avg("quality").alias(f"quality{tag}"),
            F.sum("elapsed").alias(f"elapsed{tag}"),
        )

    both = rates(runs, "").join(rates(previous, "_before"), "dataset", "full")
    return both.select(
        "dataset",
        F.coalesce("runs", F.lit(0)).alias("runs"),
        F.coalesce("runs_before", F.lit(0)).alias("runs_before"),
        "quality", "elapsed", "pass_rate", "pass_rate_before",
        (F.col("pass_rate") - F.col("pass_rate_before")).alias("pass_rate_change"),
        F.coalesce(F.col("pass_rate") < F.col("pass_rate_before"), F.lit(False)).alias("is_regression"),
    )


def check_invariants(profile: DataFrame, log: DataFrame) -> DataFrame:
    """Violations of the value ranges of profile and log tables, one count per rule."""
    p = profile.agg(
        F.count_if(~F.col("null_pct").between(0, 1)).alias("null_pct_range"),
        F.count_if(~F.col("unique_pct").between(0, 1)).alias("unique_pct_range"),
        F.count_if(F.size("sample_values") > MAX_SAMPLES).alias("sample_count"),
    )
    q = log.agg(F.count_if(F.col("after_nulls") > F.col("before_nulls")).alias("nulls_grew"))

    def long(df: DataFrame) -> DataFrame:
        return df.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in df.columns
        ])))

    return long(p).unionByName(long(q))
