from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plumbline.fixed_values import CONSUMER_FIELDS, SEMANTIC_TYPES
from plumbline.operators import profile


def by_name(df):
    return {r["name"]: r for r in df.collect()}


def test_small_clean_table(spark):
    df = spark.createDataFrame([(1, "Ann", 9.5), (2, "Bob", None), (3, "Cy", 7.0)], "id int, name string, score double")
    p = by_name(profile.profile_columns(df, order_by="id"))
    assert p["id"]["is_primary_key"] and p["id"]["sample_values"] == ["1", "2", "3"]
    assert p["score"]["null_pct"] == 0.3333 and p["score"]["sample_values"] == ["9.5", "7.0"]
    assert not p["score"]["is_primary_key"]


def test_sketch_profile_is_close(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    exact = {r["column_name"]: r for r in profile.summarize(df, exact=True).collect()}
    for r in profile.summarize(df).collect():
        e = exact[r["column_name"]]
        assert r["approx_unique"] == pytest.approx(e["approx_unique"], rel=0.12)
        assert (r["min"], r["max"], r["count"]) == (e["min"], e["max"], e["count"])
        if e["q50"] is not None:
            assert r["q50"] == pytest.approx(e["q50"], rel=0.05, abs=0.02)


def test_nan_counts_as_value_unless_asked(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (2.0,)], "v double")
    assert by_name(profile.profile_columns(df))["v"]["null_pct"] == 0.25
    assert by_name(profile.profile_columns(df, nan_as_null=True))["v"]["null_pct"] == 0.5
    s = profile.summarize(df, exact=True).first()
    assert s["approx_unique"] == 3 and s["q50"] == 1.5


def test_nested_odd_names_and_long_texts(spark):
    long_a, long_b = "x" * 100, "x" * 99 + "y"
    df = spark.createDataFrame(
        [(1, {"c": "red"}, [1, 2], long_a), (2, {"c": "red"}, [1], long_b), (3, {"c": "blue"}, [1], long_a)],
        "`a ``b'c` int, m map<string,string>, l array<int>, t string",
    )
    p = by_name(profile.profile_columns(df, order_by="a `b'c"))
    assert p["a `b'c"]["is_primary_key"]
    assert p["t"]["unique_pct"] == p["l"]["unique_pct"] == p["m"]["unique_pct"] == 0.6667


def test_large_integers_stay_apart(spark):
    df = spark.createDataFrame([(2**60 + i,) for i in range(50)], "id long")
    assert by_name(profile.profile_columns(df))["id"]["unique_pct"] == 1.0
    assert profile.summarize(df, exact=True).first()["approx_unique"] == 50


def test_empty_table(spark):
    p = by_name(profile.profile_columns(spark.createDataFrame([], "a int, b string")))
    assert all((r["null_pct"], r["unique_pct"], r["sample_values"], r["is_primary_key"]) == (1.0, 0.0, [], False)
               for r in p.values())
    assert profile.summarize(spark.createDataFrame([], "a int, b string"), exact=True).count() == 2


def test_semantic_types(spark):
    rng = random.Random(1)
    rows = [
        (i, f"2024-01-{i % 28 + 1:02d}", rng.choice(["North", "South"]), rng.random() * 100, rng.random(), rng.choice(["yes", "no"]),
         rng.randint(1, 9), "word " * 20 + str(i % 7), rng.choice(["A", "B"]), i % 2 == 0)
        for i in range(200)
    ]
    df = spark.createDataFrame(
        rows, "order_id int, order_date string, region string, unit_price double, discount_pct double, is_active string, "
        "quantity int, notes string, product string, flag boolean"
    )
    p = by_name(profile.infer_semantic_types(profile.profile_columns(df, order_by="order_id"), profile.text_lengths(df)))
    kinds = {n: r["semantic_type"] for n, r in p.items()}
    assert kinds == {
        "order_id": "identifier", "order_date": "date", "region": "geographic", "unit_price": "currency",
        "discount_pct": "percentage", "is_active": "boolean", "quantity": "metric", "notes": "text_description",
        "product": "dimension", "flag": "boolean",
    }
    assert set(kinds.values()) <= set(SEMANTIC_TYPES)


def test_labels_targets_and_ambiguous_names(spark):
    df = spark.createDataFrame([(1, 2.0, 3)], "rev_mth int, unitPrice double, col1 int")
    p = profile.flag_ambiguous_names(profile.business_labels(profile.profile_columns(df)))
    p = by_name(profile.flag_target_metrics(p, ["Price"]))
    assert p["rev_mth"]["business_label"] == "Rev Mth" and p["unitPrice"]["business_label"] == "Unit Price"
    assert p["unitPrice"]["is_target_metric"] and not p["rev_mth"]["is_target_metric"]
    assert p["col1"]["is_ambiguous"] and not p["rev_mth"]["is_ambiguous"]


def test_compact_profile(spark):
    rows = [("a_very_long_column_name_indeed", "double", "currency", 0.125, ["1200", "3400", "9"]),
            ("id", "int", "identifier", 0.0, [])]
    df = spark.createDataFrame(rows, "name string, dtype string, semantic_type string, null_pct double, sample_values array<string>")
    lines = [r["line"] for r in profile.compact_profile(df).collect()]
    assert lines[0] == "| a_very_long_column_n | double | currency | 12% | 1200, 3400 |"
    assert lines[1] == "| id                   | int | identifier | 0% |  |"


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([], "x int, y string")
    b = spark.createDataFrame([], "y string, x int")
    c = spark.createDataFrame([], "y string, x bigint")
    assert profile.schema_fingerprint(a) == profile.schema_fingerprint(b) != profile.schema_fingerprint(c)
    cols = spark.createDataFrame([("a", "y", "string"), ("a", "x", "int")], "d string, n string, t string")
    assert profile.fingerprint_catalog(cols, "d", "n", "t").first()["fingerprint"] == profile.schema_fingerprint(a)


def test_consumer_views(spark):
    df = spark.createDataFrame([("q", 1, "x")], "raw_query string, raw_row_count int, secret string")
    assert profile.project_for(df, "router", CONSUMER_FIELDS).columns == ["raw_query", "raw_row_count"]
    assert profile.project_for(df, "qa", CONSUMER_FIELDS).columns == df.columns
    assert profile.project_for(df, "nobody", CONSUMER_FIELDS).columns == []


def test_summary_text(spark):
    df = spark.createDataFrame([(1.5, "a\nb"), (2.5, None)], "v double, t string")
    text = {r["column_name"]: r for r in profile.summary_as_text(profile.summarize(df, exact=True)).collect()}
    assert text["v"]["avg"] == "2.000" and text["t"]["avg"] == "N/A" and text["t"]["min"] == "a b"
    assert text["t"]["null_percentage"] == "50.000"


def test_describe_counts_rows(spark):
    rows = profile.describe_schema(spark.range(4).withColumn("v", F.lit(1.0))).collect()
    assert [(r["column_name"], r["column_type"], r["row_count"]) for r in rows] == [("id", "bigint", 4), ("v", "double", 4)]


def test_only_possible_keys_are_counted(spark):
    df = spark.range(5000).select(
        "id", *[(F.col("id") % (i + 2)).alias(f"c{i}") for i in range(40)], F.concat(F.lit("u"), "id").alias("name"),
        F.when(F.col("id") > 0, F.col("id")).alias("holes"), F.greatest(F.col("id"), F.lit(20)).alias("nearly"), F.greatest(F.col("id"), F.lit(200)).alias("less"),
    )
    assert profile.possible_keys(df) == ["id", "name", "nearly", "less"]
    assert {r["name"] for r in profile.candidate_keys(df).collect()} == {"id", "name", "nearly"}
    assert profile.candidate_keys(df.select("c1")).count() == 0
