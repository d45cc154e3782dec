"""Manifest and proofs against a plain tree, on the smallest table and on rows with nulls, copies, ties and lone groups."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from civic_spark.llm import merkle
from civic_spark.llm.queries import QUERIES

from . import brute

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
ROWS = (
    [(i, "a", None if i % 7 == 0 else "xx", 3, "Abc") for i in range(140)]
    + [(None, None, None, None, None)] * 3
    + [(5, "a", "xx", 3, "Abc")] * 20
    + [(5, "b", "xx", 3, ""), (99, "q", "lone", None, ""), (6, None, "xx", 0, "É X" * 40_000)]
    + [(1000 + i, "s", f"l{i:02}", 1, "T") for i in range(20)]
)


@pytest.fixture(scope="module")
def docs(spark):
    """With columns that the operator uses names of."""
    extra = ("rank", "digest", "place", "left", "leaf")
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    return spark.createDataFrame(ROWS, schema).select("*", *[F.lit(7).alias(c) for c in extra])


def checked(docs):
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    rows = merkle.verified(merkle.build(docs, changed))
    return rows.withColumn("proof_sha256", merkle.proof_digest(F.col("proof"))).select(*COLUMNS)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(map(str, r)))


def test_plain_tree(docs):
    assert ordered(checked(docs).collect()) == ordered(brute.merkle(ROWS))


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    got = QUERIES["op12_merkle_manifest"](spark, "/root/testdata/sf0.001").select(*COLUMNS).collect()
    assert ordered(got) == ordered(brute.merkle([tuple(r) for r in table.collect()]))


def test_no_rows_and_one_row(docs):
    assert merkle.build(docs.limit(0)).root is None and checked(docs.limit(0)).count() == 0
    (one,) = checked(docs.where("lang = 'lone'")).collect()
    assert one["root"] == one["leaf"] == one["subroot"] and one["verified"] and one["proof_sha256"] == brute.hashlib.sha256(b"").hexdigest()


def test_requests(spark, docs):
    manifest = merkle.build(docs)
    asked = [("xx", 3), ("xx", 3), ("xx", 100), ("lone", 0), (None, 1), ("xx", 4000), ("none", 0)]
    got = merkle.verified(manifest, spark.createDataFrame(asked, "lang string, rank long")).collect()
    assert sorted((str(r["lang"]), r["rank"], r["verified"]) for r in got) == [("None", 1, True), ("lone", 0, True), ("xx", 3, True), ("xx", 100, True)]
    whole = {(r["lang"], r["rank"]): r["proof"] for r in merkle.prove(manifest).collect()}
    assert all(whole[r["lang"], r["rank"]] == r["proof"] for r in got)


def test_records_lead_from_the_root_to_every_leaf(docs):
    manifest = merkle.build(docs)
    children = {r["digest"]: r["children"] for r in manifest.records.collect()}
    assert all(brute.hashlib.sha256("".join(c).encode()).hexdigest() == d and 1 <= len(c) <= 8 for d, c in children.items())
    front, leaves = [manifest.root], []
    while front:
        leaves += [d for d in front if d not in children]
        front = [c for d in front for c in children.get(d, [])]
    assert sorted(leaves) == sorted(r["leaf"] for r in manifest.leaves.collect())
