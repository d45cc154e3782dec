"""The pipeline on rows with planted cases, and the registered queries that have a statement."""

from __future__ import annotations

import pytest

import corpus_pipeline
from __spark_entry__ import queries
from civic_spark.llm.queries import ORACLES, QUERIES

from ..compare import compare, duck


def test_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after <= before
        if k < 4:
            assert docs.columns == columns
        if k == 2:
            assert after == before  # passages go, documents stay
        if k == 4:
            assert after == before
        before = after
    assert corpus_pipeline.ORACLE_SQL is None


GOOD = [" ".join(f"Word{(i * 7 + k) % 90} ending." for k in range(40 + i % 9)) for i in range(60)]
ODD = [(None, None), (None, "no id"), (1, GOOD[1]), (1, GOOD[1]), (1, "another text under the id of one"), (2, ""), (3, " \n "), (4, "long" * 20_000), (5, "w " * 30_000), (6, "?")]


@pytest.mark.parametrize("stage", range(5))
@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_stages_on_odd_rows(spark, tmp_path, stage, kind):
    """Nulls in every column, equal ids with different texts, repeated rows, empty and long texts, clashing columns."""
    rows = ODD + [(100 + i, t) for i, t in enumerate(GOOD)] if kind == "odd" else []
    rows = [(d, t, "en" if k % 3 else None, f"src{k % 2}" if k % 4 else None, len(t or "") if k % 5 else None, "q", 1.0, 7, None) for k, (d, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, place long, kept string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, 0) for i in range(0, 60, 2)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.STAGES[stage][1](spark, docs, str(tmp_path))
    found = out.collect()
    if kind == "empty":
        assert not found
        return
    if stage < 4:
        assert out.columns == docs.columns
    told = sorted((r["doc_id"] or 0, r["text"] or "") for r in found) if stage < 4 else []
    given = sorted((r[0] or 0, r[1] or "") for r in rows)
    if stage == 1:  # repeated rows go, unrelated texts of one id and wordless ones stay
        assert [x for x in told if x[0] < 100] == sorted({x for x in given if x[0] < 100})
    if stage == 2:
        assert len(found) == len(rows)
    if stage == 3:
        assert {x for x in told} <= set(given)
    if stage == 4:
        assert sum(r["start"] == 0 for r in found) == len(rows)


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in QUERIES} and QUERIES.keys() | {"pipeline"} <= queries().keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_statement(spark, name):
    rows, problems = compare(QUERIES[name](spark, "/root/testdata/sf0.001"), duck("/root/testdata/sf0.001"), ORACLES[name])
    assert rows and not problems, problems
