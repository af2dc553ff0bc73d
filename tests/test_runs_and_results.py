from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.operators import analyses, quality, questions, results, runs
from plumbline.plans.answer import revenue_trend_answer


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        ("s1", 1, "routing", "a"), ("s1", 2, "cleaning", "b"), ("s1", 3, "failed", "disk full"), ("s1", 4, "odd", "c"),
        ("s2", 1, "initiated", "d"), ("s2", 2, "complete", "e"), ("s3", 9, "odd", "f"),
    ]
    df = spark.createDataFrame(rows, "session string, n int, status string, message string")
    return df.withColumn("ts", F.timestamp_add("MINUTE", F.col("n"), F.lit(datetime(2024, 1, 1))).cast("timestamp_ntz"))


def test_latest_status_keeps_last_known_step(log):
    got = {r["session"]: (r["status"], r["step"], r["error"], r["is_complete"])
           for r in runs.latest_status(log, "session", "status", ["ts", "n"], message="message").collect()}
    assert got == {"s1": ("odd", 2, "disk full", False), "s2": ("complete", 6, None, True), "s3": ("odd", 0, None, False)}


def test_budget(spark):
    usage = spark.createDataFrame([("a", 95.0), ("b", 94.0), ("c", 10.0)], "provider string, used double")
    limits = spark.createDataFrame([("a", 100.0), ("b", 100.0), ("c", None)], "provider string, daily_limit double")
    got = {r["provider"]: (r["is_exhausted"], r["remaining"]) for r in runs.budget_status(usage, limits).collect()}
    assert got == {"a": (True, 5.0), "b": (False, 6.0), "c": (False, None)}


def test_remaining_runs_never_negative(spark):
    usage = spark.createDataFrame([("d", "a", 120.0), ("d", "b", 10.0)], "day string, provider string, used double")
    limits = spark.createDataFrame([("a", 100.0), ("b", 100.0)], "provider string, daily_limit double")
    cost = spark.createDataFrame([("a", 10.0), ("b", 20.0)], "provider string, tokens_per_run double")
    assert runs.remaining_runs(usage, limits, cost).first()["remaining_runs"] == 0


def test_unused_and_unlimited_providers(spark):
    usage = spark.createDataFrame([("d", "a", 100.0)], "day string, provider string, used double")
    limits = spark.createDataFrame([("a", 1000.0), ("b", 100.0), ("c", None)], "provider string, daily_limit double")
    cost = spark.createDataFrame([("a", 10.0), ("b", 20.0), ("c", 1.0)], "provider string, tokens_per_run double")
    assert runs.remaining_runs(usage, limits, cost).first()["remaining_runs"] == 5
    requests = spark.createDataFrame([(1, "t", "d")], "request_id int, task string, day string")
    configs = spark.createDataFrame([("t", "c", 1, None), ("t", "b", 2, 1.0)], "task string, provider string, priority int, daily_limit double")
    assert runs.pick_provider(requests, configs, usage).first()["chosen_provider"] == "c"


def test_provider_choice(spark):
    requests = spark.createDataFrame([(1, "t", "d"), (2, "u", "d")], "request_id int, task string, day string")
    configs = spark.createDataFrame(
        [("t", "a", 1, 100.0), ("t", "b", 2, 100.0), ("u", "a", 1, 100.0)], "task string, provider string, priority int, daily_limit double"
    )
    usage = spark.createDataFrame([("d", "a", 95.0)], "day string, provider string, used double")
    got = {r["request_id"]: r["chosen_provider"] for r in runs.pick_provider(requests, configs, usage).collect()}
    assert got == {1: "b", 2: None}


QUESTIONS = [
    ("Why did sales drop last quarter?", "root_cause", "sales"),
    ("Predict revenue for Q3 2023", "forecasting", "finance"),
    ("Compare North vs South", "comparison", "unknown"),
    ("Top 5 products by shipping cost", "ranking", "ecommerce"),
    ("Show the histogram of patient age", "distribution", "healthcare"),
    ("Is there a relationship with employee tenure", "correlation", "hr"),
    ("How did clicks change", "trend_analysis", "unknown"),
    ("border crossings", "trend_analysis", "ecommerce"),
]


def test_question_classes(spark):
    df = spark.createDataFrame(QUESTIONS, "q string, intent_gold string, domain_gold string")
    for r in questions.classify_questions(df, "q").collect():
        assert (r["intent"], r["domain"]) == (r["intent_gold"], r["domain_gold"]), r["q"]
    whole = {r["q"]: r["domain"] for r in questions.classify_questions(df, "q", whole_word=True).collect()}
    assert whole["border crossings"] == "unknown"


def test_time_phrases(spark):
    df = spark.createDataFrame([(q,) for q, *_ in QUESTIONS] + [("in 2024 and 2023",)], "q string")
    got = [r["time_dimension"] for r in questions.extract_time_phrase(df, "q").collect()]
    assert got == ["last quarter", "Q3 2023", None, None, None, None, None, None, "2024"]


def test_evaluation_passes_missing_expectation(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", None)], "p string, g string")
    got = {r["label"]: (r["n"], r["correct"]) for r in questions.evaluate_labels(df, "p", "g").collect()}
    assert got == {"a": (2, 1), "(none)": (1, 1), "(all)": (3, 2)}


def test_json_answers(spark):
    texts = ['{"a": 1}', '```json\n{"a": 2}\n```', '```\n{"a": 3}\n``` extra', '{"a": ', "no json"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = questions.parse_json_answers(df, "t", "a int").collect()
    assert [r["answer"]["a"] if r["answer"] else None for r in got] == [1, 2, 3, None, None]
    assert [r["error"] is None for r in got] == [True, True, True, False, False]
    assert got[4]["raw_content"] == "no json"


def test_chart_rules(spark):
    rows = [
        ("kpi", 1, 0, 1, "numeric", "", 0, False, "kpi_card"), ("line", 80, 0, 2, "temporal", "numeric", 0, False, "line"),
        ("pie", 5, 5, 2, "category", "numeric", 1, True, "pie"), ("bar", 9, 9, 2, "category", "numeric", 1, True, "bar"),
        ("scatter", 99, 0, 2, "numeric", "numeric", 0, False, "scatter"), ("heat", 20, 4, 3, "category", "category", 2, False, "heatmap"),
    ]
    df = spark.createDataFrame(rows, "query_id string, row_count long, groups long, columns int, x_kind string, y_kind string, "
                                     "categories int, compositional boolean, want string")
    assert all(r["chart_type"] == r["want"] for r in results.suggest_chart(df).collect())


def test_compact_numbers(spark):
    df = spark.createDataFrame([(1234567.0,), (-2500.0,), (12.0,), (3.2e9,), (5e12,), (None,)], "v double")
    got = [r[0] for r in df.select(results.compact_number(F.col("v"))).collect()]
    assert got[:5] == ["1.2M", "-2.5K", "12.0", "3.2B", "5.0T"]


def test_top_with_others_of_few_members(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 2.0)], "k string, v double")
    assert {(r["k"], r["v"]) for r in results.top_with_others(df, "k", "v", 7).collect()} == {("a", 3.0), ("b", 2.0)}


def test_matrix_has_every_category(spark, monkeypatch):
    monkeypatch.setattr(results, "AXIS_BLOCK", 3)
    df = spark.range(10).selectExpr("if(id = 0, null, 'r') AS r", "nullif(id, 9) AS c", "1.0D AS v")
    got = {(x["r"], x["c"]): x["v"] for x in results.matrix(df, "r", "c", "v").collect()}
    assert len(got) == 20 and got["r", None] == 1.0 and got[None, 0] == 1.0 and sum(got.values()) == 10.0


def test_series_of_null_and_quarters(spark):
    df = spark.createDataFrame([(None, datetime(2024, 1, 1), 5.0), ("b", datetime(2024, 9, 4), 2.0)], "k string, t timestamp_ntz, v double")
    got = {(x["k"], x["period"].month): x["v"] for x in results.series(df, "t", "quarter", "k", "v").collect()}
    assert got == {(None, 1): 5.0, (None, 4): 0.0, (None, 7): 0.0, ("b", 1): 0.0, ("b", 4): 0.0, ("b", 7): 2.0}
    with pytest.raises(ValueError, match="unknown grain"):
        analyses.trend(df, "t", "v", "fortnight")


def test_series_fills_gaps(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, 1), 1.0), ("b", datetime(2024, 1, 4), 2.0)], "k string, t timestamp_ntz, v double")
    assert results.series(df, "t", "day", "k", "v").count() == 8


def test_histogram_leaves_out_what_is_no_number(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r["n"] for r in analyses.histogram(df, "v", 2).orderBy("bin").collect()] == [1, 1]


def test_constant_histogram(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    assert [r["n"] for r in analyses.histogram(df, "v", 3).orderBy("bin").collect()] == [2, 0, 0]


def test_forecast_of_a_straight_line(spark):
    rows = [(datetime(2023, m, 1), 10.0 * m) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, v double")
    got = analyses.forecast_linear(df, "t", "v", horizon=2).orderBy("period").collect()
    assert [(r["period"], round(r["predicted"], 6)) for r in got] == [(datetime(2024, 1, 1), 130.0), (datetime(2024, 2, 1), 140.0)]
    score = analyses.forecast_accuracy(analyses.hold_out(df, "t", "v", None, 3), "actual", "predicted").first()
    assert score["rmse"] == pytest.approx(0, abs=1e-6)


def test_accuracy_skips_zero_actuals(spark):
    df = spark.createDataFrame([(0.0, 1.0), (10.0, 11.0)], "a double, p double")
    assert analyses.forecast_accuracy(df, "a", "p").first()["mape"] == pytest.approx(10.0)


@pytest.mark.parametrize("ties,n", [("rank", 3), ("dense_rank", 4), ("row_number", 2)])
def test_top_n_ties(spark, ties, n):
    df = spark.createDataFrame([("a", 5.0), ("b", 4.0), ("c", 4.0), ("d", 3.0)], "k string, v double")
    limit = 3 if ties == "dense_rank" else 2
    assert analyses.top_n(df, "k", "v", limit, ties=ties).count() == n


def test_approval(spark):
    df = spark.createDataFrame([(0.75, 0.4, False), (0.74, 0.4, False), (0.9, 0.39, False), (0.9, 0.9, True)], "c double, q double, i boolean")
    assert [r["approval_status"] for r in quality.approve(df, "c", "q", "i").collect()] == ["approved", "needs_review", "rejected", "rejected"]


def test_answer(spark):
    row = revenue_trend_answer(spark, "/root/testdata/sf0.001").first()
    stored = spark.read.parquet(row["result_path"])
    assert stored.count() == row["row_count"] and row["column_names"] == stored.columns
