"""Every registered query: equal to its SQL at the smallest scale, and planned without the shapes that do not scale."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import entry
from civic_spark.bindings import queries_ops, queries_results  # noqa: F401  (registers the queries)
from civic_spark.bindings.registry import ORACLES, QUERIES

from .compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
SQL = ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for shape in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert shape not in plan, shape
    # Every window has a partition: a window over nothing would gather the data in one task.
    assert "Exchange SinglePartition" not in plan or "Window" not in plan or not re.search(r"windowspecdefinition\((?:specified|\w+#\d+L? (?:ASC|DESC))", plan)
    rows, problems = compare(df, con, SQL[name])
    assert not problems and rows > 0, problems


def test_all_queries_have_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", ["primary_token_precinct_map", "precinct_map_data", "pivot_candidate_slots", "sort_multi", "roster_match_year"])
def test_query_on_more_rows(spark, name):
    """Ties and long ballots that the smallest scale does not hold."""
    folder = "/root/testdata/sf0.01"
    rows, problems = compare(QUERIES[name](spark, folder), duck(folder), SQL[name])
    assert not problems and rows > 0, problems


def test_stored_lookups_follow_the_files(spark, tmp_path):
    from civic_spark.bindings.views import Views

    spark.range(3).write.parquet(str(tmp_path / "region.parquet"))
    first = Views(spark, str(tmp_path))._state()
    assert Views(spark, str(tmp_path))._state() == first
    spark.range(4).write.mode("append").parquet(str(tmp_path / "region.parquet"))
    assert Views(spark, str(tmp_path))._state() != first
