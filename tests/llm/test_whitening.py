"""Whitening against the covariance written out, and Jacobi-Davidson on operators of every rank."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from civic_spark.llm import whitening
from civic_spark.llm.queries import QUERIES

from . import brute


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids, n, deviation, white, explained = brute.whitening(rows)
    got = QUERIES["op13_jacobi_davidson_whitening"](spark, folder).toPandas()
    assert len(got) == 8 * n and (got.n == n).all() and (got.identity_error <= 1e-12).all()
    assert got.groupby("vec_id").deviation.first().to_dict() == dict(zip(ids, deviation))
    mine = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert np.abs(mine * np.sign((mine * white).sum(0)) - white).max() < 1e-9
    assert np.allclose(got.groupby("component").explained.first(), explained, rtol=1e-12)


def test_odd_rows(spark):
    """Nulls, repeated rows, no vector, vectors of two lengths, names that the operator uses itself."""
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 1.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, []), (8, [0.0, 0.0]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit(3).alias(c) for c in ("id", "vec", "dim", "x", "rows")])
    got = whitening.whiten(df).collect()
    assert sorted(str(r["id"]) for r in got) == ["1"] * 4 + ["8"] * 2 + ["None"] * 2  # a lone vector has no spread
    kept = [r for r in rows if r[1] is not None and len(r[1]) == 2 and None not in r[1] and not np.isnan(r[1]).any()]
    deviation = dict(zip((i for i, _ in kept), brute.whitening(kept, 2)[2]))
    assert all(int(r["deviation"]) == deviation[r["id"]] for r in got)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 8")).count() == 0


def test_large_deviation_is_exact():
    y = np.array([[3_000_000_019, 5], [7, -9]])
    assert whitening._deviation(y) == [3_000_000_019**2 + 25, 130]


def test_large_entry_is_an_error():
    with pytest.raises(ValueError):
        whitening.integers(np.array([[1e30]]))


@pytest.mark.parametrize("kind", ["flat", "spiked", "low", "equal", "small"])
def test_leading_pairs(kind):
    rng = np.random.default_rng(5)
    dim = {"small": 5, "spiked": 200}.get(kind, 64)
    spread = {"flat": np.linspace(1.2, 1, dim), "spiked": np.r_[1e3, 1e3, 30, np.ones(dim - 3)], "low": np.r_[5, 2, 1, np.zeros(dim - 3)], "equal": np.r_[9, 9, 9, 9, np.ones(dim - 4)], "small": np.ones(dim)}[kind]
    turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    a = (turn * spread) @ turn.T
    values, vectors = whitening.leading_pairs(lambda u: a @ u, dim, 8, float(np.trace(a)))
    many = min(8, dim)
    assert values.shape == (many,) and np.allclose(values, np.sort(spread)[::-1][:many], atol=1e-12 * spread.max())
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() <= 2 * dim * whitening.EPS * spread.max()
    assert np.abs(vectors.T @ vectors - np.eye(many)).max() < 1e-13


def test_inner_solver():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(30, 30))
    a, right = a + a.T, rng.normal(size=(30, 3))
    shift = np.array([0.1, 0.2, 0.3])
    got = whitening.minres(lambda v: a @ v, shift, right, lambda i, v: v, 60, 1e-13)
    want = np.stack([np.linalg.solve(a - s * np.eye(30), right[:, i]) for i, s in enumerate(shift)], 1)
    assert np.allclose(got, want, atol=1e-6)
