"""Shapes of the final physical plans that matter on large data."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from civic_spark.bindings.views import Views
from civic_spark.operators.ordering import global_rank
from civic_spark.plans import elections, fundraising, primaries
from civic_spark.sources import sinks

FOLDER = "/root/testdata/sf0.001"


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", ["precinct_table", "county_table", "county_map_data", "burn_rate", "district_map_data", "finance_summary"])
def test_facts_are_scanned_once(spark, name):
    plan = final_plan(queries()[name](spark, FOLDER))
    assert len(re.findall(r"FileScan parquet \[l_orderkey", plan)) == 1, plan


def test_votes_are_summed_before_they_move(spark):
    plan = final_plan(elections.precinct_table(elections.contest_rows(Views(spark, FOLDER).election_items)))
    first = max(line.index("Exchange hashpartitioning") for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    below = [line for line in plan.splitlines() if "partial_sum(votes" in line or "HashAggregate(keys" in line]
    assert first and below


def explained(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_columns_and_filters_reach_the_scan(spark, tmp_path):
    view, path = Views(spark, FOLDER), str(tmp_path / "election_data")
    plan = explained(fundraising.out_of_state(view.contrib))
    schema = next(line for line in plan.splitlines() if "ReadSchema" in line and "o_orderkey" in line)
    assert "o_orderpriority" not in schema and "o_orderstatus" not in schema
    sinks.overwrite_table(view.ballots, path)
    one = elections.contest_rows(spark.read.parquet(path), election="Primary", year=2020, counties=["NATION_1"])
    pushed = next(line for line in explained(one).splitlines() if "PushedFilters" in line)
    for part in ("EqualTo(election,primary)", "EqualTo(year,2020)", "nation_1"):
        assert part in pushed, pushed


def test_bucketed_tables_join_without_a_shuffle(spark, frame, tmp_path):
    for name in ("left_t", "right_t"):
        rows = frame("k INT, v STRING", *[(i, name) for i in range(50)])
        sinks.bucketed_table(rows, name, ["k"], 4, str(tmp_path / name))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = spark.table("left_t").join(spark.table("right_t"), "k")
        assert "Exchange" not in final_plan(joined) and joined.count() == 50
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("left_t", "right_t"):
            spark.sql(f"DROP TABLE {name}")


def test_results_hold_when_nothing_is_broadcast_and_a_key_is_hot(spark, frame):
    """Sort-merge joins throughout, with most rows in a single precinct."""
    from .test_elections import SCHEMA, row

    rows = [row("x", "1", f"C{i % 3}", f"P{i % 3}", 1 + i) for i in range(400)] + [row("y", str(i), "C0", "P0", i) for i in range(9)]
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "1")
        got = {r.unit: r for r in elections.precinct_table(elections.contest_rows(frame(SCHEMA, *rows))).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes")
    assert len(got) == 10 and got["X - 1"].total_votes == sum(range(1, 401))
    assert (got["X - 1"].can1, got["X - 1"].winner) == ("C0", "P0")


def test_party_resolution_reads_the_results_once(spark):
    from civic_spark.bindings.queries_results import overrides, race_lookup

    view = Views(spark, FOLDER)
    ballots = view.spark.read.parquet(_kept(view.ballots))
    plan = final_plan(primaries.resolve_parties(ballots, race_lookup(view), overrides(view)))
    assert len(re.findall(r"FileScan parquet \[year", plan)) == 1, plan
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 6, plan


def _kept(df) -> str:
    path = sinks.shared_folder(df.sparkSession)
    sinks.overwrite_table(df, path)
    return path


@pytest.mark.parametrize("name", ["primary_token_precinct_map", "precinct_map_data"])
def test_map_winners_come_from_counted_rows(spark, name):
    """Equal rows are put together by a hash aggregate before any winner is looked for."""
    plan = final_plan(queries()[name](spark, FOLDER))
    winner = plan.index("min(CASE WHEN isnotnull(votes")
    assert "HashAggregate(keys=" in plan[winner:] and "count(1)" in plan[winner:]


def test_global_rank(spark):
    """Places are those of a full sort, equal rows included, and a first column with one value spreads over tasks."""
    rows = spark.range(4000).selectExpr("CASE WHEN id % 3 = 0 THEN DATE'2020-01-01' ELSE date_add(DATE'2020-01-02', CAST(id % 50 AS int)) END AS day", "id % 700 AS v", "CAST(id % 2 AS string) AS w")
    for order, key in (
        ([F.col("day").desc_nulls_last(), F.col("v"), F.col("w")], lambda r: (-r.day.toordinal(), r.v, r.w)),
        ([F.col("day"), F.col("v").desc(), F.col("w").desc()], lambda r: (r.day.toordinal(), -r.v, -int(r.w))),
    ):
        got = global_rank(rows, order).collect()
        assert [r.rank for r in got] == list(range(1, 4001))
        assert [(r.day, r.v, r.w) for r in got] == [(r.day, r.v, r.w) for r in sorted(rows.collect(), key=key)]
    assert global_rank(rows.limit(0), [F.col("day")]).count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        keys = [F.col("day"), F.col("v"), F.col("w"), F.rand(29)]
        parts = rows.repartitionByRange(*keys).groupBy(F.spark_partition_id().alias("p")).agg(F.count_if(F.col("day") == F.lit("2020-01-01").cast("date")).alias("n")).filter("n > 0")
        assert parts.count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
