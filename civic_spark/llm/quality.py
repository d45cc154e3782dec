"""Quality classifier by positive-unlabelled learning (operator 5).

Trusted positives are texts labelled good; the unlabelled set is web text drawn whatever its label. A logistic model over
features of the whole text minimises the non-negative unbiased risk: the risk of the unlabelled texts as negatives, less what
the positives hidden among them contribute at the estimated class prior, never lets the negative part fall below zero.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

_KIND = np.zeros(256, np.int64)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[48:58] = 2
_KIND[65:91] = 3
_KIND[97:123] = 4
_KIND[128:] = 5
#: Byte values that count one by one: signs of ASCII.
_SIGNS = np.array([b for b in range(33, 127) if not chr(b).isalnum()])

N_FEATURES = 6 + len(_SIGNS) + 14


def features(raw: bytes) -> np.ndarray:
    """Shares, ratios and logs that describe a text of any length; all zero but a few for an empty one."""
    out = np.zeros(N_FEATURES, np.float32)
    words = raw.split()
    n, m = len(raw), len(words)
    if m == 0:
        out[-1] = 1.0
        return out
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=count, minlength=6)
    out[:6] = kinds / n
    out[6 : 6 + len(_SIGNS)] = np.sqrt(count[_SIGNS] / m)
    sizes = np.fromiter(map(len, words), np.int32, m)
    different = len(set(words))
    pairs = len(set(zip(words, words[1:]))) if m > 1 else 1
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper = sum(map(bytes.isupper, words))
    title = sum(map(bytes.istitle, words))
    ends = sum(x.rstrip()[-1:] in b".!?:;" for x in lines)
    out[6 + len(_SIGNS) :] = (
        np.log1p(n) / 10,
        np.log1p(m) / 10,
        sizes.mean() / 10,
        sizes.std() / 10,
        np.log1p(sizes.max()) / 5,
        different / m,
        np.log(m / different),
        pairs / max(1, m - 1),
        same / m,
        len(set(lines)) / len(lines),
        np.log1p(m / len(lines)) / 5,
        upper / m,
        title / m,
        ends / len(lines),
    )
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _expand(x: np.ndarray) -> np.ndarray:
    """Standardised features, and how far each lies from the usual: a text can be odd on either side."""
    x = np.clip(x, -6, 6)
    return np.concatenate([x, np.abs(x), np.minimum(x * x, 9) / 3, np.ones((len(x), 1), x.dtype)], axis=1)


@dataclass
class Model:
    """Weights over standardised features; ``score`` is the probability of a good text."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = _expand((x - self.mean) / self.scale) @ self.weights
        return _sigmoid(z)


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 1e-4, seed: int = 3) -> Model:
    """Minimises the non-negative risk ``prior R_p+ + max(0, R_u- - prior R_p-)`` of the logistic loss by Adam on all rows.

    Where the bracket is below zero, the step goes against it instead, as the method has it. With no rows of either kind
    every score is the prior.
    """
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    if not len(positive) or not len(unlabelled):
        width = positive.shape[1]
        flat = np.zeros(3 * width + 1)
        flat[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        return Model(np.zeros(width), np.ones(width), flat, prior)
    mean, scale = unlabelled.mean(0), np.maximum(both.std(0), 1e-3)
    p, u = (_expand((x - mean) / scale).astype(np.float64) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / max(1 - prior, 1e-6))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        zp, zu = p @ w, u @ w
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_pos = p.T @ (_sigmoid(zp) - 1) / len(p) * prior
        g_neg = u.T @ _sigmoid(zu) / len(u) - prior * (p.T @ _sigmoid(zp)) / len(p)
        g = g_pos + g_neg if negative >= 0 else -g_neg
        g += decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w, prior)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 200, rate: float = 0.05, risk: float = 0.1) -> float:
    """Share of positives among the unlabelled, from the two sets alone, without any negative label.

    A logistic model learns on every second row to tell positives from unlabelled ones. Among the other rows, the share of
    unlabelled ones that score at least t, divided by the same share of positives, is no smaller than the prior at any t, and comes down
    to it where hardly any negative scores so high. The t taken has the smallest such ratio with its sampling error added.
    """
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    mean, scale = unlabelled.mean(0, dtype=np.float64), np.maximum(np.concatenate([positive, unlabelled]).std(0, dtype=np.float64), 1e-3)
    (p, p_rest), (u, u_rest) = ([_expand((x[k::2] - mean) / scale) for k in (0, 1)] for x in (positive, unlabelled))
    w, m, v = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    for step in range(1, rounds + 1):
        g = p.T @ (_sigmoid(p @ w) - 1) / len(p) + u.T @ _sigmoid(u @ w) / len(u) + 1e-3 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    zp, zu = np.sort(p_rest @ w), np.sort(u_rest @ w)
    cuts = np.unique(zp)
    share_p, share_u = (1 - np.searchsorted(z, cuts, side="left") / len(z) for z in (zp, zu))
    # both shares are within these bounds of the true ones, at every t at once, with probability 1 - risk (Dvoretzky-Kiefer-Wolfowitz)
    error = sum(np.sqrt(np.log(4 / risk) / (2 * len(z))) for z in (zu, zp))
    best = np.argmin((share_u + error) / share_p)
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def _featured(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or b"").tobytes() for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], names=["kind", "draw", "x"])

    return texts.select("kind", "draw", F.col("text").cast("string")).mapInArrow(run, "kind int, draw long, x binary")


def samples(docs: DataFrame, labels: DataFrame, learn: Column, rows_kept: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of at most ``rows_kept`` positives and as many unlabelled rows, drawn by seeded hashes."""
    known = labels.where(learn & (F.col("quality") == 1) & F.col("doc_id").isNotNull())
    draw = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"))
    positive = known.select("doc_id").distinct().orderBy(draw, "doc_id").limit(rows_kept).select("doc_id", F.lit(1).alias("kind"))
    others = docs.where(learn & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    unlabelled = others.orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id").cast("long")), "doc_id").limit(rows_kept).select("doc_id", F.lit(0).alias("kind"))
    ids = positive.union(unlabelled)  # at most 2 x rows_kept ids
    drawn = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("kind", F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"), "text")
    rows = written(_featured(drawn), "features")
    out = []
    for kind in (1, 0):  # an id may stand in many rows, so the rows are limited too; sorted, so that training is repeatable
        found = rows.where(F.col("kind") == kind).orderBy("draw", "x").limit(rows_kept).collect()
        out.append(np.array([np.frombuffer(bytes(r["x"]), np.float32) for r in found], np.float32).reshape(-1, N_FEATURES))
    return out[0], out[1]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows_kept: int = 10_000, seed: int = 3) -> Model:
    """A model from documents ``(doc_id, text)`` and ``labels (doc_id, quality)``, of which only rows with ``learn`` true count.

    ``rows_kept`` bounds what training reads: that many positive rows, and that many unlabelled rows, drawn by a seeded hash
    from those that ``learn`` allows. Of the labels only the positives are used: the class prior is estimated from positives
    and unlabelled texts. Labels other than 1 and NULL ids are left out; an id that stands in several rows brings them all,
    within the bound.
    """
    positive, unlabelled = samples(docs, labels, learn, rows_kept, seed)
    return train(positive, unlabelled, estimated_prior(positive, unlabelled))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` with ``score``, from 0 to 1, of its whole text. A NULL text scores as an empty one.

    All columns of the input stay; one called ``score`` is replaced.
    """

    @F.pandas_udf("double")
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            x = [features(t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"") for t in part]
            yield pd.Series(model.score(np.stack(x)) if x else [], dtype="float64")

    return docs.withColumn("score", rate(F.col("text").cast("string")))


def held_out(column: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text leaves no remainder by 5. NULL ids are held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(True))
