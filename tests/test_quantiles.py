from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.operators import quantiles as q

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def check(spark, groups):
    rows = [(k, float(v)) for k, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r["k"], r["prob"]): r["value"] for r in q.quantiles(df, "v", PROBS, "k").collect()}
    for k, values in groups.items():
        for p in PROBS:
            assert got[(k, p)] == pytest.approx(np.quantile(values, p), rel=1e-9, abs=1e-12), (k, p)


def test_spread_values_and_outliers(spark):
    rng = np.random.default_rng(3)
    check(spark, {
        "normal": rng.normal(0, 100, 500), "heavy": np.exp(rng.normal(0, 8, 400)),
        "extreme": np.concatenate([rng.random(50), [1e15, -1e15, 0.0]]), "same": np.full(30, 7.5),
        "small": np.array([1e-9, -1e-9, 0.0]), "one": np.array([3.25]),
    })


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e9, 1e9, allow_nan=False), min_size=1, max_size=40))
def test_any_values(spark, values):
    check(spark, {"k": np.array(values) + 0.0})


def test_nulls_and_nan_are_left_out(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert q.quantiles(df, "v", [0.5]).first()["value"] == 2.0


@pytest.mark.parametrize("values_per_piece", [7, 10**6])
def test_pieces_do_not_change_quantiles(spark, values_per_piece):
    rng = np.random.default_rng(9)
    groups = {
        "far": 1e12 + rng.permutation(300), "wide": np.exp(rng.normal(0, 200, 200)) * rng.choice([-1, 1], 200),
        "hot": np.repeat([1.0, 2.0, 3.0], [500, 1, 1]), "one": np.array([5.0]), "ends": np.array([-np.inf, 1.0, np.inf, np.inf]),
    }
    df = spark.createDataFrame([(k, float(v)) for k, values in groups.items() for v in values], "k string, v double")
    got = {(r["k"], r["prob"]): (r["value"], r["distinct_count"]) for r in q.quantiles_of_counts(q.value_counts(df, "v", "k"), [0.0, 0.5, 1.0], "k", values_per_piece).collect()}
    for k, values in groups.items():
        for p, name in ((0.0, np.min), (0.5, np.median), (1.0, np.max)):
            assert got[(k, p)] == (pytest.approx(name(values), rel=1e-12), len(set(values))), (k, p)
    whole = q.quantiles_of_counts(q.value_counts(df.filter("k = 'far'"), "v"), [0.25], None, values_per_piece).first()
    assert whole["value"] == np.quantile(groups["far"], 0.25)


def test_a_narrow_column_far_from_zero_is_spread(spark):
    counts = q.value_counts(spark.range(10**12, 10**12 + 200_000).select(F.col("id").cast("double").alias("v")), "v")
    pieces = q.in_pieces(counts, [F.col("_v")], 200_000, 1000, "_piece").groupBy("_piece").count()
    assert pieces.count() > 100 and pieces.agg(F.max("count")).first()[0] < 5000


def test_mode_tie_goes_to_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,), (None,), (None,)], "v string")
    assert q.most_frequent(df, "v").first()["mode"] == "a"
