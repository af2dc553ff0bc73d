"""Merged part profiles against one pass over all rows."""

from __future__ import annotations

import random
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators.mergeable import RANK_ERROR, merge_profiles, part_profiles, update_profiles


def test_merged_equals_one_pass(spark, tmp_path):
    rng = random.Random(2)
    rows = [
        (i, rng.choice([None, "a", "b"]), rng.choice([None, float("nan"), rng.gauss(1e9, 1.0), 1e9]), datetime(2024, 1, 1 + i % 7), [i % 5], i % 6)
        for i in range(6000)
    ]
    df = spark.createDataFrame(rows, "id long, name string, v double, ts timestamp_ntz, list array<int>, day int")
    one = merge_profiles(part_profiles(df, F.lit("all")))
    path = str(tmp_path / "parts")
    update_profiles(df.filter("day < 2"), F.col("day"), path)
    assert spark.read.parquet(path).count() == 2 * 6
    merged = update_profiles(df, F.col("day"), path)
    assert spark.read.parquet(path).count() == 6 * 6  # a row per day and column, none twice
    both = {r["column_name"]: (r, s) for r in merged.collect() for s in one.collect() if s["column_name"] == r["column_name"]}
    values = np.sort([r[2] for r in rows if r[2] is not None and r[2] == r[2]])
    for name, (m, o) in both.items():
        for figure in ("rows", "nulls", "min", "max"):
            assert m[figure] == o[figure], (name, figure)
        assert abs(m["approx_unique"] - o["approx_unique"]) <= max(2, 0.03 * o["approx_unique"])
    m = both["v"][0]
    assert abs(m["mean"] - values.mean()) < 1e-6 and abs(m["std"] - values.std(ddof=1)) < 1e-6
    for p, q in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
        below, upto = np.searchsorted(values, m[q]) / len(values), np.searchsorted(values, m[q], side="right") / len(values)
        assert below - RANK_ERROR <= p <= upto + RANK_ERROR
    assert both["name"][0]["q50"] is None and both["list"][0]["approx_unique"] == 5
    before = spark.read.parquet(path).count()
    update_profiles(df, F.col("day"), path)  # nothing new
    assert spark.read.parquet(path).count() == before
    assert merge_profiles(part_profiles(df.limit(0), F.col("day"))).count() == 0
