from __future__ import annotations

import numpy as np
import pytest

from plumbline.operators import relational, similarity


def test_guard():
    assert relational.guard_sql("SELECT created_at FROM updates_log") 
    for bad in ("DROP TABLE t", "select 1; delete from t", "exec sp", "SELECT xp_cmdshell", "Create view v as select 1"):
        with pytest.raises(ValueError):
            relational.guard_sql(bad)


def test_validate_reads_nothing(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert relational.validate_sql(spark, "SELECT id FROM three") is None
    assert "nope" in relational.validate_sql(spark, "SELECT nope FROM three")
    assert relational.validate_sql(spark, "SELECT 'update' AS word FROM three;") is None
    for command in ("DROP VIEW three", "SET spark.sql.ansi.enabled=false", "TRUNCATE TABLE three", "ALTER VIEW three AS SELECT 1"):
        assert "PARSE" in relational.validate_sql(spark, command)
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    assert spark.catalog.tableExists("three")


def test_run_query_envelope(spark, tmp_path):
    views = {"nums": spark.range(5)}
    ok = relational.run_query(spark, "SELECT id, id * 2 AS `two times` FROM nums", str(tmp_path), views, "q").first()
    assert ok["success"] and ok["row_count"] == 5 and spark.read.parquet(ok["result_path"]).columns == ["id", "two times"]
    bad = relational.run_query(spark, "SELECT 1 / (id - id) FROM nums", str(tmp_path), views, "z").first()
    assert not bad["success"] and "DIVIDE_BY_ZERO" in bad["error"]


def test_batch_stops_slow_query(spark, tmp_path):
    slow = "SELECT count(*) AS n FROM range(0, 4000000000000) WHERE sqrt(id) % 7 = 3"
    out = relational.run_batch(spark, {"slow": slow, "fast": "SELECT 1 AS one"}, str(tmp_path), timeout_s=8, parallel=1)
    got = {r["query_id"]: r["success"] for r in out.collect()}
    assert got == {"slow": False, "fast": True}


def test_range_join_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    points = [(i, float(v)) for i, v in enumerate(rng.normal(0, 20, 200))]
    spans = [(i, float(a), float(a + w)) for i, (a, w) in enumerate(zip(rng.normal(0, 20, 50), rng.exponential(5, 50)))]
    want = {(p, s) for p, v in points for s, a, b in spans if a <= v < b}
    got = relational.range_join(
        spark.createDataFrame(points, "p int, v double"), spark.createDataFrame(spans, "s int, a double, b double"), "v", "a", "b", 3.0
    )
    assert {(r["p"], r["s"]) for r in got.collect()} == want


def test_range_join_of_a_second_and_a_year(spark):
    rng = np.random.default_rng(3)
    points = [(i, int(v)) for i, v in enumerate(rng.integers(-40_000_000, 40_000_000, 300))]
    spans = [(i, int(a), int(a + w)) for i, (a, w) in enumerate(zip(rng.integers(-40_000_000, 40_000_000, 60), rng.choice([1, 2, 3600, 31_536_000], 60)))]
    spans += [(100 + i, v, v + 1) for i, v in points[:20]] + [(200, 5, 5), (201, 9, 3)]
    want = sorted((p, s) for p, v in points for s, a, b in spans if a <= v < b)
    left, right = spark.createDataFrame(points, "p int, v long"), spark.createDataFrame(spans, "s int, a long, b long")
    assert sorted((r["p"], r["s"]) for r in relational.range_join(left, right, "v", "a", "b", 1.0).collect()) == want
    assert relational.range_join(left, right.limit(0), "v", "a", "b", 1.0).count() == 0


@pytest.mark.parametrize("per_pass, reachable", [(5, True), (1000, True), (5, False)])
def test_knn_with_copies_and_zero_vectors(spark, monkeypatch, per_pass, reachable):
    monkeypatch.setattr(similarity, "reachable", lambda folder: reachable)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 8)).round(3)
    base[60:100] = base[0]  # a third of all rows are copies of one vector
    base[7] = 0
    queries = np.concatenate([base[:12], rng.normal(size=(5, 8))])
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit(queries) @ unit(base).T, 9)
    want = set()
    for q in range(len(queries)):
        if not queries[q].any():
            continue
        order = sorted((i for i in range(len(base)) if base[i].any()), key=lambda i: (-scores[q, i], i))[:6]
        want |= {(q, i, p + 1) for p, i in enumerate(order)}
    qdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "q int, v array<double>")
    bdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "b int, w array<double>").repartition(5)
    got = similarity.knn(qdf, "q", "v", bdf, "b", "w", 6, query_rows=per_pass, base_rows=40)
    assert {(r["query_id"], r["base_id"], r["place"]) for r in got.collect()} == want


def test_find_similar(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0])], "k int, v array<double>")
    assert similarity.find_similar(df, "k", "v", [1.0, 0.05]).first()["k"] == 1
    assert similarity.find_similar(df, "k", "v", [-1.0, 0.0]).count() == 0
    assert similarity.find_similar(df, "k", "v", [0.0, 0.0]).count() == 0
    assert similarity.find_similar(df, "k", "v", []).count() == 0


def test_match_schemas(spark):
    vectors = {"x": [1.0, 0.0], "y": [0.96, 0.28], "z": [0.0, 1.0]}
    new = spark.createDataFrame([("n1", "f1", vectors["x"]), ("n2", "f9", vectors["y"]), ("n3", "f8", [-1.0, 0.0])], "dataset string, fingerprint string, vector array<double>")
    known = spark.createDataFrame([("k1", "f1", vectors["z"]), ("k2", "f2", vectors["x"])], new.schema)
    got = {r["dataset"]: (r["matched"], r["match_kind"]) for r in similarity.match_schemas(new, known).collect()}
    assert got == {"n1": ("k1", "exact"), "n2": ("k2", "similar"), "n3": (None, "none")}
