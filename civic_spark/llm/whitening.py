"""Whitening of embeddings by Jacobi-Davidson on distributed products (operator 13).

Vectors become integers, so sums and deviations are exact. The covariance is never formed: all that is asked of the table is
its product with a few vectors, centred before multiplying, in one pass a time. Around these products the driver keeps a
subspace of at most some dozens of short vectors: Rayleigh-Ritz takes the leading pairs, those whose residual has come down
to rounding are locked, and for the others a correction equation, projected off what is found, is solved by some steps of
MINRES, for all pairs in the same passes. The corrections widen the subspace, and so on until all residuals are at rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

# An entry c becomes floor(STRETCH * c) + SHIFT.
STRETCH, SHIFT = 1024.0, 100_000
#: Vectors in one block of the working table.
BLOCK_ROWS = 2048
#: Largest size of an integer entry: sums over 10^12 rows stay exact.
LARGEST = 1 << 23
EPS = float(np.finfo(np.float64).eps)

Product = Callable[[np.ndarray], np.ndarray]


def usable(table: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has entries, all of them finite numbers."""
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return table.where(v.isNotNull() & (F.size(v) > 0) & finite)


def _entries(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def integers(x: np.ndarray) -> np.ndarray:
    y = np.floor(x * STRETCH)
    if y.size and np.abs(y).max() > LARGEST - SHIFT:
        raise ValueError("an entry is too large to be whitened exactly")
    return y.astype(np.int64) + SHIFT


@dataclass
class Fit:
    """What a fit list says: number of rows, exact sums a dimension, trace of the covariance, and its leading pairs."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _blocks(vectors: DataFrame) -> DataFrame:
    """The integer vectors, packed by the thousand, as a written table ``(rows, x)``: every pass reads it as plain bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(_entries(batch.column(0)))
            cut = [x[i : i + BLOCK_ROWS] for i in range(0, len(x), BLOCK_ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array([len(c) for c in cut], pa.int64()), pa.array([c.astype("<i4").tobytes() for c in cut], pa.binary())], names=["rows", "x"])

    return written(vectors.mapInArrow(pack, "rows long, x binary"), "vectors")


def _summed(blocks: DataFrame, width: int, run: Callable[[np.ndarray], np.ndarray], dim: int) -> np.ndarray:
    """Sum over all blocks of ``run(block)``, a matrix with ``width`` columns: added up in each task, then by row in Spark."""
    names = [f"c{i}" for i in range(width)]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                got = run(np.frombuffer(raw, "<i4").reshape(-1, dim))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), *[pa.array(c) for c in total.T]], names=["j", *names])

    kind = "long" if run is _plain else "double"
    parts = blocks.select("x").mapInArrow(part, ", ".join(["j long", *[f"{c} {kind}" for c in names]]))
    rows = parts.groupBy("j").agg(*[F.sum(c).alias(c) for c in names]).collect()  # one row a dimension
    return np.array([r[1:] for r in sorted(rows)])


def _plain(x: np.ndarray) -> np.ndarray:
    return x.sum(axis=0, dtype=np.int64)[:, None]


def minres(product: Product, shift: np.ndarray, right: np.ndarray, off: Callable[[int, np.ndarray], np.ndarray], steps: int, least: float) -> np.ndarray:
    """Approximate solutions of ``P_i (A - shift_i) P_i t_i = right_i`` for the columns of ``right``, all in the same products.

    ``off(i, v)`` is the projection P_i. Lanczos vectors of each column are orthogonal by the three-term rule, and a Givens
    rotation a step keeps the least residual over the Krylov space. A column stops at ``least`` times its right side.
    """
    dim, many = right.shape
    v = np.stack([off(i, right[:, i]) for i in range(many)], 1)
    beta = np.linalg.norm(v, axis=0)
    start = np.maximum(beta, 1e-300)
    v = v / start
    v_old, out = np.zeros_like(v), np.zeros_like(v)
    w, w_old = np.zeros_like(v), np.zeros_like(v)
    c, c_old, s, s_old = np.ones(many), np.ones(many), np.zeros(many), np.zeros(many)
    eta, beta_old, live = beta.copy(), np.zeros(many), beta > 0
    for _ in range(steps):
        if not live.any():
            break
        at = np.flatnonzero(live)
        u = np.zeros_like(v)
        u[:, at] = product(v[:, at]) - v[:, at] * shift[at]
        u = np.stack([off(i, u[:, i]) for i in range(many)], 1)
        alpha = (v * u).sum(0)
        u = u - alpha * v - beta_old * v_old
        beta_new = np.linalg.norm(u, axis=0)
        r3, r2 = s_old * beta_old, c_old * c * beta_old
        r2 = s * alpha + c * c_old * beta_old
        r1_bar = c * alpha - s * c_old * beta_old
        r1 = np.maximum(np.hypot(r1_bar, beta_new), 1e-300)
        w_new = (v - r2 * w - r3 * w_old) / r1
        c_old, s_old, c, s = c, s, r1_bar / r1, beta_new / r1
        out = np.where(live, out + c * eta * w_new, out)
        eta = -s * eta
        w_old, w, v_old = w, w_new, v
        v, beta_old = u / np.maximum(beta_new, 1e-300), beta_new
        live = live & (np.abs(eta) > least * start) & (beta_new > 1e-14 * start)
    return out


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Columns of ``new`` made orthogonal to the bases and each other; those that add nothing are left out."""
    kept: list[np.ndarray] = []
    base = np.concatenate([b for b in bases if b.shape[1]] or [np.zeros((new.shape[0], 0))], axis=1)
    for column in new.T:
        length = np.linalg.norm(column)
        if not length > 0:
            continue
        column = column / length
        for _ in range(3):
            column = column - base @ (base.T @ column)
            for k in kept:
                column = column - k * (k @ column)
        length = np.linalg.norm(column)
        if length > 1e-10:
            column = column / length
            column = column - base @ (base.T @ column)
            kept.append(column / np.linalg.norm(column))
    return np.stack(kept, 1) if kept else np.zeros((new.shape[0], 0))


def leading_pairs(product: Product, dim: int, wanted: int, size: float, inner: int = 4, widest: int = 48, seed: int = 13, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues and their vectors of the symmetric operator ``product``, by Jacobi-Davidson.

    ``size`` is a bound of its norm (its trace). A pair is locked when its residual is at most ``dim`` roundings of the
    largest eigenvalue. The subspace starts from seeded random vectors and is cut back to its best half when it is ``widest``.
    """
    wanted, rng = min(wanted, dim), np.random.default_rng(seed)
    locked, values = np.zeros((dim, 0)), []
    space, image = np.zeros((dim, 0)), np.zeros((dim, 0))
    fresh, worst = rng.normal(size=(dim, min(dim, wanted + 4))), []
    top = 0.0
    for _ in range(rounds):
        fresh = _orthonormal(fresh, locked, space)
        if fresh.shape[1]:
            space, image = np.concatenate([space, fresh], 1), np.concatenate([image, product(fresh)], 1)
        small = space.T @ image
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        top = max(top, float(ritz[0]) if len(ritz) else 0.0)
        left = wanted - len(values)
        residual = image[:, :left] - space[:, :left] * ritz[:left]
        residual = residual - locked @ (locked.T @ residual)
        norms = np.linalg.norm(residual, axis=0)
        done = 0
        while done < left and norms[done] <= dim * EPS * max(top, EPS * size):
            done += 1
        if done:  # in falling order only, so that no larger pair is found after a smaller one
            locked = np.concatenate([locked, space[:, :done]], 1)
            values += ritz[:done].tolist()
            space, image, ritz, residual, norms = space[:, done:], image[:, done:], ritz[done:], residual[:, done:], norms[done:]
            left -= done
        if not left:
            break
        if space.shape[1] + left > widest:
            space, image = space[:, : widest // 2], image[:, : widest // 2]
        # pairs whose residual is large yet get few steps: their shift is still moving
        fixed = np.concatenate([locked, space[:, :left]], 1)
        off = lambda i, x: x - fixed @ (fixed.T @ x)
        open_ = np.flatnonzero(norms > dim * EPS * top)
        fresh = np.zeros((dim, 0))
        if len(open_):
            fresh = minres(product, ritz[open_], -residual[:, open_], lambda i, x: off(i, off(i, x)), inner, 1e-3)
        if not np.any(fresh):
            fresh = rng.normal(size=(dim, 1))
        worst.append(float(norms.max()))
        if locked.shape[1] + space.shape[1] >= dim and not _orthonormal(fresh, locked, space).shape[1]:
            # the subspace is everything: nothing can be added, what is left is rounding
            locked, values = np.concatenate([locked, space[:, :left]], 1), values + ritz[:left].tolist()
            break
    else:
        raise ArithmeticError(f"residuals did not come down to rounding: {worst[-3:]}")
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], locked[:, order]


def fit(blocks: DataFrame, dim: int, components: int = 8) -> Fit | None:
    """Sums, trace and leading pairs of the covariance of all rows in ``blocks``; None for no rows."""
    n = blocks.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    if not n:
        return None
    sums = [int(s) for s in _summed(blocks, 1, _plain, dim)[:, 0]]
    mean = np.array([s / n for s in sums])
    passes = [2]

    def product(u: np.ndarray) -> np.ndarray:
        def run(x: np.ndarray) -> np.ndarray:
            y = x - mean
            return y.T @ (y @ u)

        passes[0] += 1
        return _summed(blocks, u.shape[1], run, dim) / n

    trace = float(_summed(blocks, 1, lambda x: np.square(x - mean).sum(0)[:, None], dim).sum() / n)
    if trace == 0:
        return Fit(n, sums, 0.0, np.zeros(0), np.zeros((dim, 0)), passes[0])
    values, vectors = leading_pairs(product, dim, components, trace)
    real = values > 64 * dim * EPS * values[0]  # a direction without spread cannot be scaled to one
    return Fit(n, sums, trace, values[real], vectors[:, real], passes[0])


def identity_error(blocks: DataFrame, dim: int, found: Fit) -> float:
    """Largest absolute entry of the whitened vectors' covariance, centred on their own mean, less the identity."""
    mean, turn = found.mean, found.vectors / np.sqrt(found.values)
    k = turn.shape[1]
    middle = _summed(blocks, k, lambda x: ((x - mean) @ turn).sum(0)[None], dim)[0] / found.n

    def run(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ turn - middle
        return w.T @ w

    return float(np.abs(_summed(blocks, k, run, dim) / found.n - np.eye(k)).max())


def _deviation(y: np.ndarray) -> list[int]:
    """Exact sums of squares of the rows, whatever their size."""
    if y.size and int(np.abs(y).max()) ** 2 * y.shape[1] >= 1 << 63:
        return [sum(v * v for v in row) for row in y.tolist()]
    return (y * y).sum(1).tolist()


def whiten(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """A row per usable vector and component: ``id, component, n, deviation, whitened, explained, identity_error``.

    Vectors that are NULL, empty, or hold NULL or non-finite entries are left out. Repeated rows and NULL ids count as rows of their
    own. Vectors of each length are a fit list of their own. Directions without spread (constant columns, a single vector,
    fewer different vectors than dimensions) give no component, so there may be fewer than ``components``. ``deviation`` is
    exact, as a decimal of no fraction. A table without usable rows gives none.
    """
    rows = usable(table, vector).select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vec"))
    rows = written(rows.withColumn("dim", F.size("vec")), "vectors")
    schema = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    out = table.sparkSession.createDataFrame([], schema)
    for (dim,) in sorted(rows.select("dim").distinct().collect()):  # one or a few lengths
        own = rows.where(F.col("dim") == dim)
        blocks = _blocks(own.select("vec"))
        found = fit(blocks, dim, components)
        if found is None or not len(found.values):
            continue
        out = out.unionByName(_projected(own, dim, found, identity_error(blocks, dim, found), schema))
    return out


def _projected(rows: DataFrame, dim: int, found: Fit, error: float, schema: str) -> DataFrame:
    n, sums, mean = found.n, np.array(found.sums, dtype=np.int64), found.mean
    turn, k = found.vectors / np.sqrt(found.values), len(found.values)
    explained = found.values / found.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = integers(_entries(part.column(1)))
                m = len(x)
                told = _deviation(n * x - sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n, np.int64)),
                        pa.array([d for d in told for _ in range(k)], pa.decimal128(38, 0)),
                        pa.array(((x - mean) @ turn).ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("id", "vec").mapInArrow(run, schema)
