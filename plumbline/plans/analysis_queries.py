"""Registered queries for the analyses and the question texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.fixed_values import DEFAULT_DOMAIN, DEFAULT_INTENT, DOMAIN_PHRASES, INTENT_PHRASES
from plumbline.operators import analyses, questions
from plumbline.plans.registry import query, table


def orders_with_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )


JOINED = (
    "(SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey)"
)


def _round(df: DataFrame, places: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


@query(
    "analysis_trend",
    """
    WITH m AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, sum(o_totalprice) AS total
               FROM orders GROUP BY 1)
    SELECT period, round(total, 2) AS total, round(total - lag(total) OVER w, 2) AS change,
      round(100 * (total - lag(total) OVER w) / lag(total) OVER w, 4) AS change_pct
    FROM m WINDOW w AS (ORDER BY period)
    """,
)
def analysis_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = analyses.trend(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "month")
    return _round(_round(t, 2, "total", "change"), 4, "change_pct")


@query(
    "analysis_trend_by_group",
    """
    WITH m AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS period, sum(value) AS total
               FROM events GROUP BY 1, 2)
    SELECT event_type, period, round(total, 2) AS total, round(total - lag(total) OVER w, 2) AS change,
      round(100 * (total - lag(total) OVER w) / lag(total) OVER w, 4) AS change_pct
    FROM m WINDOW w AS (PARTITION BY event_type ORDER BY period)
    """,
)
def analysis_trend_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = analyses.trend(table(spark, sf_dir, "events"), "ts", "value", "day", "event_type")
    return _round(_round(t, 2, "total", "change"), 4, "change_pct")


def _cause(dim: str) -> str:
    return f"""
    SELECT '{dim}' AS dimension, {dim}::VARCHAR AS member, sum(o_totalprice) FILTER (o_orderdate < '1998-01-01') AS a,
      sum(o_totalprice) FILTER (o_orderdate >= '1998-01-01') AS b
    FROM {JOINED} WHERE o_orderdate >= '1997-01-01' AND o_orderdate < '1999-01-01' GROUP BY 2
    """


@query(
    "analysis_root_cause",
    f"""
    WITH c AS ({_cause('c_mktsegment')} UNION ALL {_cause('r_name')} UNION ALL {_cause('n_name')}),
    d AS (SELECT dimension, member, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(b, 0) - coalesce(a, 0) AS ch FROM c)
    SELECT dimension, member, round(a, 2) AS before, round(b, 2) AS after, round(ch, 2) AS change,
      round(ch / nullif(sum(ch) OVER (PARTITION BY dimension), 0), 6) AS share_of_change,
      row_number() OVER (PARTITION BY dimension ORDER BY abs(ch) DESC, member)::INTEGER AS rank
    FROM d
    """,
)
def analysis_root_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    causes = analyses.root_cause(
        orders_with_region(spark, sf_dir), "o_orderdate", "o_totalprice", ["c_mktsegment", "r_name", "n_name"],
        ("1997-01-01", "1998-01-01"), ("1998-01-01", "1999-01-01"),
    )
    return _round(_round(causes, 2, "before", "after", "change"), 6, "share_of_change")


@query(
    "analysis_comparison",
    f"""
    WITH s AS (SELECT n_name, coalesce(sum(o_totalprice) FILTER (c_mktsegment = 'BUILDING'), 0) AS a,
                 coalesce(sum(o_totalprice) FILTER (c_mktsegment = 'MACHINERY'), 0) AS b
               FROM {JOINED} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1)
    SELECT n_name, round(a, 2) AS total_a, round(b, 2) AS total_b, round(a - b, 2) AS difference,
      round(100 * (a - b) / nullif(b, 0), 4) AS difference_pct FROM s
    """,
)
def analysis_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = analyses.compare(
        orders_with_region(spark, sf_dir), "c_mktsegment", "BUILDING", "MACHINERY", "o_totalprice", "n_name"
    )
    return _round(_round(c, 2, "total_a", "total_b", "difference"), 4, "difference_pct")


@query(
    "analysis_histogram",
    """
    WITH e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS w FROM lineitem),
    c AS (SELECT least(floor((l_extendedprice - lo) / w)::BIGINT, 19) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
    SELECT r.bin, round(lo + r.bin * w, 4) AS low, round(lo + (r.bin + 1) * w, 4) AS high, coalesce(n, 0) AS n
    FROM (SELECT unnest(range(20)) AS bin) r CROSS JOIN e LEFT JOIN c ON r.bin = c.bin
    """,
)
def analysis_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(analyses.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20), 4, "low", "high")


@query(
    "analysis_percentiles",
    " UNION ALL ".join(
        f"SELECT l_returnflag, {p}::DOUBLE AS prob, round(quantile_cont(l_extendedprice, {p}), 4) AS value "
        "FROM lineitem GROUP BY 1"
        for p in (0.05, 0.25, 0.5, 0.75, 0.95)
    ),
)
def analysis_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = analyses.percentiles(
        table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.05, 0.25, 0.5, 0.75, 0.95], "l_returnflag"
    )
    return _round(q, 4, "value")


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "analysis_correlation",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM lineitem"
        for a in _MEASURES for b in _MEASURES
    ),
)
def analysis_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(analyses.correlation_matrix(table(spark, sf_dir, "lineitem"), _MEASURES), 6, "correlation")


@query(
    "analysis_ranking",
    f"""
    WITH t AS (SELECT r_name, c_custkey, round(sum(o_totalprice), 2) AS total FROM {JOINED} GROUP BY 1, 2)
    SELECT r_name, c_custkey, total, rank() OVER (PARTITION BY r_name ORDER BY total DESC)::INTEGER AS place FROM t
    QUALIFY rank() OVER (PARTITION BY r_name ORDER BY total DESC) <= 5
    """,
)
def analysis_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = analyses.top_n(orders_with_region(spark, sf_dir), "c_custkey", "o_totalprice", 5, within="r_name")
    return _round(best, 2, "total")


@query(
    "analysis_ranking_bottom",
    """
    WITH t AS (SELECT p_brand, sum(p_size)::BIGINT AS total FROM part GROUP BY 1)
    SELECT p_brand, total, dense_rank() OVER (ORDER BY total)::INTEGER AS place FROM t
    QUALIFY dense_rank() OVER (ORDER BY total) <= 3
    """,
)
def analysis_ranking_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.top_n(table(spark, sf_dir, "part"), "p_brand", "p_size", 3, ties="dense_rank", bottom=True)


_MONTHLY = """
    SELECT o_orderstatus, date_trunc('month', o_orderdate)::TIMESTAMP AS period,
      (year(o_orderdate) * 12 + month(o_orderdate) - 1)::DOUBLE AS x, sum(o_totalprice) AS y
    FROM orders GROUP BY 1, 2, 3
"""


@query(
    "analysis_forecast",
    f"""
    WITH m AS ({_MONTHLY}),
    f AS (SELECT o_orderstatus, regr_slope(y, x) AS s, regr_intercept(y, x) AS i, max(x) AS last, max(period) AS p,
            sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2)) AS sd FROM m GROUP BY 1)
    SELECT o_orderstatus, (p + to_months(h::INTEGER))::TIMESTAMP AS period, round(i + s * (last + h), 1) AS predicted,
      round(i + s * (last + h) - 1.96 * sd, 1) AS lower, round(i + s * (last + h) + 1.96 * sd, 1) AS upper
    FROM f, (SELECT unnest(range(1, 4)) AS h)
    """,
)
def analysis_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    ahead = analyses.forecast_linear(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "o_orderstatus", 3)
    return _round(ahead, 1, "predicted", "lower", "upper")


@query(
    "analysis_forecast_accuracy",
    f"""
    WITH m AS ({_MONTHLY}), l AS (SELECT o_orderstatus, max(x) AS last FROM m GROUP BY 1),
    f AS (SELECT m.o_orderstatus, regr_slope(y, x) AS s, regr_intercept(y, x) AS i
          FROM m JOIN l ON m.o_orderstatus = l.o_orderstatus WHERE x <= last - 6 GROUP BY 1)
    SELECT m.o_orderstatus, round(avg(abs(i + s * x - y)), 1) AS mae, round(sqrt(avg((i + s * x - y) ** 2)), 1) AS rmse,
      round(avg(abs((i + s * x - y) / nullif(y, 0)) * 100), 4) AS mape
    FROM m JOIN l ON m.o_orderstatus = l.o_orderstatus JOIN f ON m.o_orderstatus = f.o_orderstatus
    WHERE x > last - 6 GROUP BY 1
    """,
)
def analysis_forecast_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = analyses.hold_out(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "o_orderstatus", 6)
    scores = analyses.forecast_accuracy(pairs, "actual", "predicted", "o_orderstatus")
    return _round(_round(scores, 1, "mae", "rmse"), 4, "mape")


@query(
    "analysis_kpi",
    """
    SELECT round(sum(o_totalprice), 2) AS revenue, count(*) AS orders, round(avg(o_totalprice), 4) AS mean_order,
      count(DISTINCT o_custkey) AS customers FROM orders
    """,
)
def analysis_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyses.kpi(table(spark, sf_dir, "orders"), {
        "revenue": F.round(F.sum("o_totalprice"), 2), "orders": F.count(F.lit(1)),
        "mean_order": F.round(F.avg("o_totalprice"), 4), "customers": F.count_distinct("o_custkey"),
    })


@query(
    "analysis_breakdown",
    """
    SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total,
      round(sum(l_extendedprice) / (SELECT sum(l_extendedprice) FROM lineitem), 6) AS share
    FROM lineitem GROUP BY 1
    """,
)
def analysis_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = analyses.breakdown(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")
    return _round(_round(b, 2, "total"), 6, "share")


_HOURLY = "SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS period, sum(value) AS total FROM events GROUP BY 1, 2"


def _anomaly_sql(window: str, z: float) -> str:
    return f"""
    WITH h AS ({_HOURLY}),
    s AS (SELECT *, avg(total) OVER w AS mean, stddev_samp(total) OVER w AS std FROM h WINDOW w AS ({window}))
    SELECT event_type, period, round(total, 2) AS total, round(mean, 6) AS mean, round(std, 6) AS std
    FROM s WHERE abs(total - mean) > {z} * std
    """


@query("analysis_anomalies", _anomaly_sql("PARTITION BY event_type", 3.0))
def analysis_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analyses.anomalies(table(spark, sf_dir, "events"), "ts", "value", "event_type", "hour", 3.0)
    return _round(_round(a, 2, "total"), 6, "mean", "std")


@query(
    "analysis_anomalies_trailing",
    _anomaly_sql("PARTITION BY event_type ORDER BY period ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING", 3.0),
)
def analysis_anomalies_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = analyses.anomalies(table(spark, sf_dir, "events"), "ts", "value", "event_type", "hour", 3.0, trailing=48)
    return _round(_round(a, 2, "total"), 6, "mean", "std")


@query(
    "analysis_benchmark",
    """
    WITH o AS (SELECT avg(c_acctbal) AS m FROM customer)
    SELECT c_mktsegment, round(avg(c_acctbal), 4) AS segment_mean, count(*) AS n, round(any_value(m), 4) AS overall_mean,
      round(100 * (avg(c_acctbal) - any_value(m)) / any_value(m), 4) AS difference_pct
    FROM customer, o GROUP BY 1
    """,
)
def analysis_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = analyses.benchmark(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")
    return _round(b, 4, "segment_mean", "overall_mean", "difference_pct")


def _case_sql(text: str, rules, default: str) -> str:
    arms = " ".join(
        f"WHEN {' OR '.join(f'contains({text}, {chr(39)}{p}{chr(39)})' for p in phrases)} THEN '{label}'"
        for label, phrases in rules
    )
    return f"CASE {arms} ELSE '{default}' END"


@query(
    "question_classes",
    f"""
    SELECT conv_id, turn, {_case_sql('lower(text)', INTENT_PHRASES, DEFAULT_INTENT)} AS intent,
      {_case_sql('lower(text)', DOMAIN_PHRASES, DEFAULT_DOMAIN)} AS domain
    FROM conversations WHERE role = 'user'
    """,
)
def question_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return questions.classify_questions(asked, "text").select("conv_id", "turn", "intent", "domain")


@query(
    "question_classes_documents",
    f"""
    SELECT {_case_sql('lower(text)', INTENT_PHRASES, DEFAULT_INTENT)} AS intent,
      {_case_sql('lower(text)', DOMAIN_PHRASES, DEFAULT_DOMAIN)} AS domain, count(*) AS n
    FROM documents GROUP BY 1, 2
    """,
)
def question_classes_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = questions.classify_questions(table(spark, sf_dir, "documents").select("text"), "text")
    return classes.groupBy("intent", "domain").agg(F.count(F.lit(1)).alias("n"))


@query(
    "question_time_phrases",
    r"""
    SELECT doc_id, nullif(regexp_extract(text || CASE lang WHEN 'en' THEN ' sales last quarter' WHEN 'de' THEN ' Q3 2023'
        ELSE ' in 2024' END,
      '(?i)\b(?:last|this|next|previous) (?:day|week|month|quarter|year)\b|\bq[1-4] (?:19|20)[0-9]{2}\b|\b(?:19|20)[0-9]{2}\b',
      0), '') AS time_dimension
    FROM documents
    """,
)
def question_time_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("lang") == "en", " sales last quarter").when(F.col("lang") == "de", " Q3 2023").otherwise(" in 2024")
    docs = table(spark, sf_dir, "documents").withColumn("text", F.concat("text", tail))
    return questions.extract_time_phrase(docs, "text").select("doc_id", "time_dimension")


@query(
    "question_label_evaluation",
    """
    WITH p AS (SELECT d.doc_id, l.quality, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS guess
               FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    s AS (SELECT coalesce(quality::VARCHAR, '(none)') AS label, count(*) AS n,
            sum(CASE WHEN quality IS NULL OR guess = quality THEN 1 ELSE 0 END)::BIGINT AS correct FROM p GROUP BY 1)
    SELECT label, n, correct, round(correct / n, 6) AS accuracy FROM s
    UNION ALL SELECT '(all)', sum(n)::BIGINT, sum(correct)::BIGINT, round(sum(correct) / sum(n), 6) FROM s
    """,
)
def question_label_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("guess")
    )
    pairs = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return _round(questions.evaluate_labels(pairs, "guess", "quality"), 6, "accuracy")


@query(
    "question_json_answers",
    """
    SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END AS k,
      CASE WHEN event_type = 'error' THEN 'Failed to parse JSON response' END AS error,
      CASE WHEN event_type = 'error' THEN 'no json: ' || user_id END AS raw_content
    FROM events
    """,
)
def question_json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("no json: "), "user_id"))
        .when(F.col("event_type") == "view", F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(F.col("event_type") == "click", F.concat(F.lit("  ```\n"), "props", F.lit("\n``` as asked")))
        .otherwise(F.col("props"))
    )
    answers = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    parsed = questions.parse_json_answers(answers, "text", "k bigint")
    return parsed.select("event_id", F.col("answer.k").alias("k"), "error", "raw_content")
