"""The chunked path must equal the plain one, whatever the share of the largest key."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import ordered, runs


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows in one key, bursts and ties in time."""
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        key = 1 if i % 2 else rng.randint(2, 40)
        offset = rng.choice([rng.randint(0, 50), rng.randint(0, 10**6), 777])
        rows.append((i, key, start + timedelta(seconds=offset), float(rng.randint(1, 100)), rng.choice("ab")))
    return spark.createDataFrame(rows, "id long, k int, ts timestamp_ntz, v double, kind string").cache()


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_only_large_keys_are_cut(skewed):
    chunks = ordered.add_chunks(skewed, ["k"], ["ts", "id"], 200)
    per_key = {r["k"]: r["n"] for r in chunks.groupBy("k").agg(F.count_distinct("_chunk").alias("n")).collect()}
    assert per_key[1] > 5 and all(n == 1 for k, n in per_key.items() if k != 1)
    assert chunks.count() == 3000
    assert ordered.add_chunks(skewed, ["k"], ["ts", "id"], 10**6) is None


@pytest.mark.parametrize("order", ["name", "amount", "ts"])
def test_running_sum_with_nulls_equals_the_plain_one(skewed, order):
    df = skewed.select(
        "id", F.lit(1).alias("k"), F.when(F.col("id") % 5 > 0, F.col("ts")).alias("ts"),
        F.when(F.col("id") > 400, F.concat("kind", F.col("v").cast("string"))).alias("name"),
        (F.col("v") * 1000).cast("decimal(30,2)").alias("amount"),
        F.when(F.col("id") % 3 == 0, F.col("v")).alias("v"),
    )
    whole = ordered.running_sum(df, "k", [order, "id"], "v", "s", 10**6)
    cut = ordered.running_sum(df, "k", [order, "id"], "v", "s", 700)
    assert as_set(cut.select("id", "s")) == as_set(whole.select("id", "s"))


@pytest.mark.parametrize("rows", [10**6, 3])
def test_ranks_keep_type_and_put_nulls_last(spark, rows):
    df = spark.createDataFrame([(1, 2**53), (2, 2**53 + 1), (3, None), (4, 5), (5, 5)], "id long, v long").withColumn("k", F.lit(1))
    got = {r["id"]: (r["row_number"], r["rank"], r["dense_rank"]) for r in ordered.ranks(df, "k", "v", "id", rows_per_chunk=rows).collect()}
    assert got == {2: (1, 1, 1), 1: (2, 2, 2), 4: (3, 3, 3), 5: (4, 3, 3), 3: (5, 5, 4)}
    names = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c")], "id long, v string").withColumn("k", F.lit(1))
    assert [r["id"] for r in ordered.ranks(names, "k", "v", "id", rows_per_chunk=rows).orderBy("row_number").collect()] == [4, 1, 2, 3]


@pytest.mark.parametrize("step,fn", [("previous", F.lag), ("next", F.lead)])
def test_neighbour(skewed, step, fn):
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = as_set(skewed.select("id", fn("v").over(w)))
    got = ordered.neighbour(skewed, "k", ["ts", "id"], ["v"], step, "n", rows_per_chunk=300).select("id", "n.v")
    assert as_set(got) == want


def test_running_sum_and_position(skewed):
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = as_set(skewed.select("id", F.sum("v").over(w), F.count(F.lit(1)).over(w)))
    df = ordered.running_sum(skewed, "k", ["ts", "id"], "v", "s", rows_per_chunk=300)
    df = ordered.row_position(df, "k", ["ts", "id"], "p", rows_per_chunk=300)
    assert as_set(df.select("id", "s", "p")) == want


@pytest.mark.parametrize("descending", [True, False])
def test_ranks(skewed, descending):
    o = F.desc("v") if descending else F.asc("v")
    w, t = Window.partitionBy("k").orderBy(o), Window.partitionBy("k").orderBy(o, "id")
    want = as_set(skewed.select(
        "id", F.row_number().over(t), F.rank().over(w), F.dense_rank().over(w), F.round(F.percent_rank().over(w), 9),
        F.ntile(4).over(t),
    ))
    got = ordered.ranks(skewed, "k", "v", "id", descending, 4, rows_per_chunk=400)
    got = got.select("id", "row_number", "rank", "dense_rank", F.round("percent_rank", 9), "ntile")
    assert as_set(got) == want


def test_as_of(skewed):
    left = skewed.filter("kind = 'a'").select("id", "k", "ts")
    right = skewed.filter("kind = 'b'").select(F.col("id").alias("rid"), "k", "ts", "v")
    rows, facts = left.collect(), right.collect()
    want = set()
    for r in rows:
        best = max(((f["ts"], f["rid"]) for f in facts if f["k"] == r["k"] and f["ts"] <= r["ts"]), default=(None, None))
        want.add((r["id"], best[1]))
    for size in (400, 10**6):
        got = ordered.as_of_join(left, right, "ts", "k", ["rid", "v"], "rid", "m", rows_per_chunk=size)
        assert as_set(got.select("id", "m.rid")) == want


def test_quota_and_cache_hits_with_chunks(skewed):
    plain = runs.apply_quota(skewed, "k", "ts", "id").select("id", "is_allowed", "resets_at")
    cut = runs.apply_quota(skewed, "k", "ts", "id", rows_per_chunk=400).select("id", "is_allowed", "resets_at")
    assert as_set(plain) == as_set(cut)
    a = runs.cache_hits(skewed, "k", "ts", "id", "10 SECONDS").select("id", "is_hit")
    b = runs.cache_hits(skewed, "k", "ts", "id", "10 SECONDS", rows_per_chunk=400).select("id", "is_hit")
    assert as_set(a) == as_set(b) and {r[1] for r in as_set(a)} == {True, False}


def test_null_keys_form_a_group(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, 2.0), (3, "x", 5.0), (4, None, 4.0)], "id int, k string, v double")
    got = ordered.running_sum(df, "k", ["id"], "v", "s", rows_per_chunk=1)
    assert as_set(got.select("id", "s")) == {(1, 1.0), (2, 3.0), (3, 5.0), (4, 7.0)}


def test_one_moment_is_cut_by_the_tie_column(spark):
    """A key whose rows share one moment, at two rows a chunk."""
    df = spark.range(40).select("id", F.lit("k").alias("k"), F.timestamp_seconds(F.lit(5)).alias("ts"), (F.col("id") % 7).cast("double").alias("v"))
    chunks = ordered.add_chunks(df, ["k"], ["ts", "id"], 2)
    assert chunks.groupBy("_chunk").count().agg(F.max("count"), F.count("*")).first()[0] <= 8 and chunks.select("_chunk").distinct().count() > 8
    for call in (
        lambda n: ordered.running_sum(df, "k", ["ts", "id"], "v", "s", n).select("id", "s"),
        lambda n: ordered.neighbour(df, "k", ["ts", "id"], ["v"], "next", "n", n).select("id", "n.v"),
        lambda n: ordered.as_of_join(df.filter("id % 2 = 0"), df.select("k", "ts", F.col("id").alias("r")), "ts", "k", ["r"], "r", "m", n).select("id", "m.r"),
    ):
        assert as_set(call(2)) == as_set(call(10**6))


@pytest.mark.parametrize("descending", [False, True])
def test_nan_infinities_and_nulls_keep_their_places(spark, descending):
    nan, inf = float("nan"), float("inf")
    values = [1.0, 2.0, nan, 3.0, 4.0, None, -inf, inf, nan, 0.0, -0.0, None, 2.0, 1e300, -1e-300]
    df = spark.createDataFrame([(i, "k", v) for i, v in enumerate(values)], "id long, k string, v double")
    whole = ordered.running_sum(df, "k", [("v", descending), "id"], "id", "s", 10**6).select("id", "s")
    cut = ordered.running_sum(df, "k", [("v", descending), "id"], "id", "s", 2).select("id", "s")
    assert as_set(cut) == as_set(whole)
    shown = lambda n: {(r["id"], r["row_number"], r["rank"], r["dense_rank"], r["ntile"]) for r in ordered.ranks(df, "k", "v", "id", descending, 4, n).collect()}
    assert shown(2) == shown(10**6)
