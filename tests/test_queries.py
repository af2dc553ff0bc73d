"""Every registered query against its SQL, and its plan against forms that do not scale."""

from __future__ import annotations

import contextlib
import io

import oracle
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def assert_no_pairs_of_all_rows(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    assert "CartesianProduct" not in text.getvalue()
    assert "BroadcastNestedLoopJoin" not in text.getvalue()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    notes = oracle.differences(df, con, ORACLES[name])
    assert [n for n in notes if n != "no rows at all"] == []
    assert_no_pairs_of_all_rows(df)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert df.count() > 0
    assert_no_pairs_of_all_rows(df)


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["row_count"] > 0 and row["chart_type"] == "line" and len(row["sample_rows"]) == 5
