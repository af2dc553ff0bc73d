from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import clean, features, profile, quality


@pytest.fixture(scope="module")
def staff(spark):
    """A messy staff table: nulls in salary, mixed flags."""
    rng = random.Random(11)
    rows = []
    for i in range(300):
        salary = None if rng.random() < 0.1 else float(rng.randint(30, 120) * 1000)
        rows.append((f"E{i:04d}", rng.choice(["Eng", "Ops", "HR"]), salary, rng.randint(20, 65),
                     rng.choice(["true", "false", "True", "FALSE", "yes", "1", ""])))
    return spark.createDataFrame(rows, "emp_id string, dept string, salary double, age int, is_active string").cache()


def test_fill_knn_equals_brute_force(staff):
    rows = [r.asDict() for r in staff.collect()]
    want = {}
    for r in rows:
        if r["salary"] is not None:
            want[r["emp_id"]] = r["salary"]
            continue
        near = [(abs(o["age"] - r["age"]), o["salary"]) for o in rows if o["dept"] == r["dept"] and o["salary"] is not None]
        border = sorted(d for d, _ in near)[4]
        picked = [s for d, s in near if d <= border]
        want[r["emp_id"]] = sum(picked) / len(picked)
    got = {r["emp_id"]: r["salary"] for r in clean.fill_knn(staff, "salary", "age", "dept", 5).collect()}
    assert got == pytest.approx(want)


def test_fill_knn_keeps_rows_it_cannot_fill(spark):
    df = spark.createDataFrame([(1, "a", None, 1.0), (2, "b", 5.0, None), (3, "b", None, None)], "id int, b string, v double, f double")
    assert {(r["id"], r["v"]) for r in clean.fill_knn(df, "v", "f", "b", 2).collect()} == {(1, None), (2, 5.0), (3, None)}


def test_median_by_null_group(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, 3.0), (3, None, None), (4, "x", None)], "id int, g string, v double")
    got = {r["id"]: r["v"] for r in clean.fill_median(df, "v", "g").collect()}
    assert got == {1: 1.0, 2: 3.0, 3: 2.0, 4: None}


def test_numeric_texts(spark):
    texts = {"$1,234.00": 1234.0, "1.2K": 1200.0, "N/A": None, "(12)": -12.0, " 7 ": 7.0, "-3e2": -300.0, "2.5M": 2.5e6,
             "": None, "K": None, "1.2.3": None, "€5": 5.0, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("raw", F.col("t"))
    assert {r["raw"]: r["t"] for r in clean.cast_numeric(df, "t").collect()} == texts


def test_booleans(staff):
    got = {(r["raw"], r["is_active"]) for r in clean.cast_boolean(staff.withColumn("raw", F.col("is_active")), "is_active").collect()}
    assert got == {("true", True), ("True", True), ("yes", True), ("1", True), ("false", False), ("FALSE", False), ("", None)}


def test_currency(spark):
    df = spark.createDataFrame([("$1,200.50",), ("EUR 3",), ("₹300",), ("12",), ("x",)], "p string")
    got = [(r["amount"], r["currency"]) for r in clean.parse_currency(df, "p").collect()]
    assert got == [(1200.5, "USD"), (3.0, "EUR"), (300.0, "INR"), (12.0, None), (None, None)]


def test_dates(spark):
    df = spark.createDataFrame([("2024-02-29",), ("31/12/2023",), ("Jan 5, 2024",), ("2023-02-29",), (None,)], "d string")
    got = [str(r["d"]) for r in clean.parse_dates(df, "d", ["yyyy-MM-dd", "dd/MM/yyyy", "MMM d, yyyy"]).collect()]
    assert got == ["2024-02-29", "2023-12-31", "2024-01-05", "None", "None"]


def test_encoding(spark):
    raw = [("plain".encode(),), ("﻿mark\r\nx".encode(),), ("José".encode("latin-1"),), ("José".encode(),)]
    got = clean.repair_encoding(spark.createDataFrame(raw, "b binary"), "b").collect()
    assert [r["text"] for r in got] == ["plain", "mark\nx", "José", "José"]
    assert [r["was_repaired"] for r in got] == [False, False, True, False]


def test_safe_names():
    assert clean.safe_names(["Order ID", "order_id", "2nd", "!!", "unitPrice", "é", "ORDER id"]) == [
        "order_id", "order_id_2", "c_2nd", "column", "unit_price", "column_2", "order_id_3"]


def test_plan(spark):
    rows = [
        ("few", "double", 0.01, False, False), ("some", "double", 0.1, False, False), ("words", "string", 0.1, False, False),
        ("many", "string", 0.3, False, False), ("goal", "double", 0.1, False, True), ("whole", "string", 0.0, False, False),
        ("key", "int", 0.0, True, False),
    ]
    prof = spark.createDataFrame(rows, "name string, dtype string, null_pct double, is_primary_key boolean, is_target_metric boolean")
    skew = spark.createDataFrame([("few", 0.2), ("some", 4.0), ("goal", -0.5)], "name string, skewness double")
    got = {(r["column"], r["operation"], r["strategy"]) for r in clean.plan_cleaning(prof, skew).collect()}
    assert got == {
        ("few", "fill_null", "drop"), ("few", "remove_outlier", "iqr"), ("some", "fill_null", "median"),
        ("some", "remove_outlier", "z_score"), ("words", "fill_null", "mode"), ("many", "drop_column", "drop"),
        ("goal", "fill_null", "drop"), ("goal", "remove_outlier", "iqr"),
    }


def test_log_and_invariants(staff):
    after = clean.drop_null_rows(staff, ["salary"])
    log = clean.cleaning_log(staff, after, [
        {"column": "salary", "operation": "fill_null", "strategy": "drop", "rationale": "few"}
    ])
    row = log.first()
    gone = staff.filter("salary IS NULL").count()
    assert (row["rows_affected"], row["before_nulls"], row["after_nulls"], row["is_consistent"]) == (gone, gone, 0, True)
    checks = quality.check_invariants(profile.profile_columns(staff), log)
    assert {r["violations"] for r in checks.collect()} == {0}
    worse = clean.cleaning_log(after, staff, [{"column": "salary", "operation": "fill_null", "strategy": "median"}])
    assert not worse.first()["is_consistent"]


def test_outliers_without_spread(spark):
    df = spark.createDataFrame([("one", 5.0), ("two", 1.0), ("two", 1.0), ("two", None)], "g string, v double")
    assert clean.remove_outliers_z(df, "v", "g").count() == 4
    assert clean.remove_outliers_iqr(df, "v", "g").count() == 4
    assert {r["v"] for r in clean.normalize(df, "v", "min_max", "g").collect()} == {None}


def test_sparse_columns(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "a int, b string")
    assert clean.drop_sparse_columns(df, profile.profile_columns(df)).columns == ["a"]


def test_quarantine_splits_everything(staff):
    marked = clean.quarantine(staff, {"no_salary": "salary IS NULL", "old": "age > 60"})
    assert clean.accepted(marked).count() + clean.rejected(marked).count() == staff.count()


def test_quality_of_empty_and_duplicate_tables(spark):
    empty = clean.quality_score(spark.createDataFrame([], "a int"), {"a": "int"}).first()
    assert empty["completeness"] == 0.0
    twice = clean.quality_score(spark.createDataFrame([(1,), (1,)], "a int"), {"a": "int"}).first()
    assert (twice["completeness"], twice["uniqueness"], twice["quality"]) == (1.0, 0.5, 0.875)


def test_feature_definitions_report(spark):
    df = spark.createDataFrame([(10.0, 0.0)], "revenue double, units double")
    more, report = features.add_features(df, [
        ("per_unit", "try_divide(revenue, units)"), ("revenue", "1"), ("bad", "nope + 1"), ("total", "sum(revenue)"), ("per_unit", "2"),
    ])
    assert more.columns == ["revenue", "units", "per_unit"] and more.first()["per_unit"] is None
    assert [r["accepted"] for r in report.collect()] == [True, False, False, False, False]


def test_fiscal_quarters(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-31' AS d UNION ALL SELECT TIMESTAMP_NTZ '2024-04-01'")
    got = [r["fiscal_quarter"] for r in features.calendar_parts(df, "d", 4).orderBy("d").collect()]
    assert got == ["FY2024-Q4", "FY2025-Q1"]
    assert features.calendar_parts(df, "d").orderBy("d").first()["fiscal_quarter"] == "FY2024-Q1"


def test_buckets(spark):
    df = spark.createDataFrame([(None,), (1.0,), (10.0,), (99.0,)], "v double")
    got = [r["bucket"] for r in features.bucketize(df, "v", [10, 20], ["low", "mid", "high"]).collect()]
    assert got == [None, "low", "mid", "high"]


def test_european_amounts_and_brackets(spark):
    texts = ["€1.234,56", "12)", "(12)", "1,234.50", "12,5", "1,234", "(1.234.567,8)"]
    df = clean.cast_numeric(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    assert [r["t"] for r in df.collect()] == [1234.56, None, -12.0, 1234.5, 12.5, 1234.0, -1234567.8]


def test_log_of_two_steps_that_remove_rows(spark):
    before = spark.createDataFrame([(1, 1.0), (2, None), (2, 3.0)], "k int, v double")
    first = before.filter("v is not null")
    ops = [{"column": "v", "operation": "fill_null", "strategy": "drop"}, {"column": "k", "operation": "dedupe", "strategy": "deduplicate"}]
    log = {r["column"]: r["rows_affected"] for r in clean.cleaning_log(before, [first, first.filter("k = 1")], ops).collect()}
    assert log == {"v": 1, "k": 1}
    with pytest.raises(ValueError, match="table after each"):
        clean.cleaning_log(before, first, ops)


def test_knn_over_features_equals_brute_force(spark):
    import random

    rng = random.Random(8)
    rows = []
    for i in range(220):
        block = rng.choice("aab")
        spot = [rng.choice([rng.gauss(0, 1), rng.gauss(0, 1) * 1e-3, float(rng.randint(0, 3))]) for _ in range(2)]
        rows.append((i, block, *spot, rng.choice([None, None, float(rng.randint(0, 99))])))
    rows += [(300, "a", 1e9, -1e9, None), (301, "b", None, 0.0, None), (302, "b", float("nan"), 0.0, 5.0), (303, "c", 0.0, 0.0, None)]
    rows += [(304, "d", 0.0, 0.0, None), (305, "d", 5.0, 5.0, 3.0), (306, None, 0.0, 0.0, None), (307, None, 1.0, 1.0, 4.0)]
    got = {r["i"]: r["v"] for r in clean.fill_knn(spark.createDataFrame(rows, "i int, k string, x double, y double, v double"), "v", ["x", "y"], "k", 3).collect()}
    usable = [r for r in rows if r[2] is not None and r[2] == r[2]]
    for i, block, x, y, v in rows:
        want = v
        if v is None and x is not None:
            near = sorted(((x - r[2]) ** 2 + (y - r[3]) ** 2, r[4]) for r in usable if r[1] == block and r[4] is not None)
            near = [n for n in near if sum(m[0] < n[0] for m in near) < 3]
            want = sum(n[1] for n in near) / len(near) if near else None
        assert got[i] == want or abs(got[i] - want) < 1e-9, i


def test_microseconds_make_rows_differ(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00.000001' AS t UNION ALL SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00.000002'")
    assert clean.quality_score(df, {}).first()["uniqueness"] == 1.0
