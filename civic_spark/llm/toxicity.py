"""Toxicity classifier over subword bags (operator 11).

Every character n-gram of a word has a vector, found by its hash. A word is the mean of its n-grams' vectors, a text the mean
of its different words, and a linear softmax over that mean gives the classes. Vectors and softmax are trained together in
numpy on the driver, from a bounded sample of labelled texts. As a misspelt or unseen word shares n-grams with known ones, it
is near them. Once trained, the mean and the softmax are both linear, so a word counts by one number, which a worker keeps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .subwords import different_words, grams

#: Words kept per worker; the table is emptied when it is full. Longer words are worked out each time they occur.
CACHE_WORDS, CACHE_CHARS = 400_000, 64


@dataclass
class Model:
    """``vectors`` of the n-gram buckets and the softmax over two classes, kept as the difference of its weight vectors.

    ``blanks`` neutral words (zero vectors) stand in every text, so that one odd word does not decide a text of three words.
    """

    vectors: np.ndarray
    softmax: np.ndarray
    bias: float
    blanks: int
    scale: float

    def bucket_scores(self) -> np.ndarray:
        return self.scale * (self.vectors @ self.softmax)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Scorer:
    """Scores of texts by a model, with a table of the words met so far."""

    def __init__(self, scores: np.ndarray, bias: float, blanks: int):
        self.scores, self.bias, self.blanks, self.known = scores, bias, blanks, {}

    def score(self, texts: list[str | None]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        bags = [different_words(t) for t in texts]
        new = list(set().union(*bags).difference(self.known)) if bags else []
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            found, counts = grams(part, len(self.scores))
            means = np.add.reduceat(self.scores[found], np.cumsum(counts) - counts) / counts
            self.known.update(zip(part, means.tolist()))
        number = self.known.__getitem__
        # sorted: a sum that does not depend on the order of a set
        z = [sum(sorted(map(number, bag))) / (len(bag) + self.blanks) + self.bias for bag in bags]
        for w in new:
            if len(w) > CACHE_CHARS:
                del self.known[w]
        return sigmoid(np.array(z))


def train(
    texts: list[str | None], toxic: np.ndarray, prior: float, buckets: int = 1 << 17, dim: int = 8, rounds: int = 60, rate: float = 0.1,
    shrink: float = 0.15, least_texts: int = 3, blanks: int = 10, scale: float = 30.0, lean: float = 0.5, seed: int = 11,
) -> Model:
    """Vectors and softmax that minimise the class-balanced log loss, by proximal steps over all texts at once.

    Steps are scaled by each n-gram's own past gradients, damped so that rare n-grams do not move as far as common ones. After
    each step vectors shrink by ``shrink`` (a share of the largest first gradients), which leaves most of them zero; n-grams of
    fewer than ``least_texts`` texts stay zero. The bias then moves by ``lean`` of the way from equal classes (a missed toxic
    text weighs as much as all its share) to ``prior``, the share of toxic texts (every mistake weighs alike). Without texts of both classes every text scores the prior.
    """
    y = np.asarray(toxic, dtype=np.float64)
    logit = float(np.log(prior / (1 - prior)))
    rng = np.random.default_rng(seed)
    vectors, w, bias = np.zeros((buckets, dim), np.float32), rng.normal(size=dim).astype(np.float32), 0.0
    if not 0 < y.sum() < len(y):
        return Model(vectors, w, logit, blanks, scale)
    order: dict[str, int] = {}
    bags = [np.array([order.setdefault(x, len(order)) for x in sorted(different_words(t))], np.int32) for t in texts]
    if not order:
        return Model(vectors, w, logit, blanks, scale)
    lengths = np.array([len(b) for b in bags])
    doc, word = np.repeat(np.arange(len(bags), dtype=np.int32), lengths), np.concatenate(bags)
    share = (scale / (lengths + blanks))[doc]
    words = list(order)
    blocks = [grams(words[i : i + 20_000], buckets) for i in range(0, len(words), 20_000)]  # a block's work arrays are large
    found, counts = (np.concatenate(c) for c in zip(*blocks))
    del blocks, bags
    owner = np.repeat(np.arange(len(order), dtype=np.int32), counts)
    uses = np.bincount(found, weights=np.bincount(word, minlength=len(order))[owner], minlength=buckets)
    kept = uses[found] >= least_texts
    found, owner = found[kept], owner[kept]
    size = counts.astype(np.float64)  # n-grams that are left out count as zero vectors
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    slope, power = [np.zeros_like(vectors), np.zeros(dim), 0.0], [np.zeros(buckets), np.zeros(dim), 0.0]
    mark = None
    for step in range(1, rounds + 1):
        scores = np.bincount(owner, weights=(vectors @ w)[found], minlength=len(order)) / size
        q = sigmoid(np.bincount(doc, weights=share * scores[word], minlength=len(y)) + bias)
        error = weight * (q - y)
        back = np.bincount(word, weights=share * error[doc], minlength=len(order)) / size
        pull = np.bincount(found, weights=back[owner], minlength=buckets)
        steps = [np.outer(pull, w).astype(np.float32), pull @ vectors + 1e-4 * w, float(error.sum())]
        length = np.abs(pull) * np.linalg.norm(w)
        if mark is None:
            mark = max(float(np.partition(length, -20)[-20]), 1e-12)
        now = rate * min(1.0, 2 * (1 - step / (rounds + 1)))
        for k, squared in enumerate((length**2, steps[1] ** 2, steps[2] ** 2)):
            slope[k] = 0.9 * slope[k] + 0.1 * steps[k]
            power[k] = 0.99 * power[k] + 0.01 * squared
        rms = [np.sqrt(p / (1 - 0.99**step)) for p in power]
        by, ease = rms[0] + 0.05 * mark, 1 - 0.9**step
        vectors -= (now / ease / by)[:, None].astype(np.float32) * slope[0]
        w = (w - now * slope[1] / ease / (rms[1] + 1e-6)).astype(np.float32)
        bias -= now * slope[2] / ease / (rms[2] + 1e-6)
        norm = np.linalg.norm(vectors, axis=1)
        vectors *= np.maximum(0, 1 - now * shrink * mark / by / np.maximum(norm, 1e-12))[:, None].astype(np.float32)
    return Model(vectors, w, float(bias) + lean * logit, blanks, scale)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows_kept: int = 6_000, bytes_kept: int = 16_000_000, text_bytes: int = 200_000) -> Model:
    """A model from documents ``(doc_id, text)`` and ``labels (doc_id, toxic)``, of which only rows with ``learn`` true count.

    Training reads at most ``rows_kept`` texts, half of each class, drawn by a hash of id and text, and of these as many as
    fit in ``bytes_kept``; texts over ``text_bytes`` are not drawn. The share of toxic texts comes from all labels that may
    be learned from. Labels other than 0 and 1, NULL ids and NULL texts are left out; an id labelled both ways counts as
    both. Repeated rows are drawn once.
    """
    known = labels.where(learn & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    toxic, all_ = known.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    prior = float(np.clip((toxic + 1) / (all_ + 2), 0.001, 0.999))
    size = F.octet_length("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where(F.col("id").isNotNull() & (size <= text_bytes))
    # hashes first: only drawn rows bring their text
    drawn = rows.select("id", F.xxhash64(F.lit(11), "id", "text").alias("draw"), size.alias("size")).join(known, "id").distinct()
    half = rows_kept // 2
    chosen = []
    for kind in (1, 0):
        left = bytes_kept // 2
        for r in drawn.where(F.col("toxic") == kind).orderBy("draw", "id").limit(half).collect():  # at most half of rows_kept
            left -= r["size"]
            if left >= 0:
                chosen.append((r["id"], r["draw"], kind))
    if not chosen:
        return train([], np.zeros(0), prior)
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(chosen, "id long, draw long, toxic int"))  # at most rows_kept rows
    picked = rows.withColumn("draw", F.xxhash64(F.lit(11), "id", "text")).join(wanted, ["id", "draw"]).dropDuplicates(["id", "draw", "toxic"])
    found = sorted((r["draw"], r["id"], r["toxic"], r["text"]) for r in picked.collect())
    return train([r[3] for r in found], np.array([r[2] for r in found]), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` with ``score``, from 0 to 1 (higher: toxic likelier), of its whole text.

    An empty or NULL text scores by the bias alone. Repeated rows score alike; all columns of the input stay, and one called
    ``score`` is replaced.
    """
    given = docs.sparkSession.sparkContext.broadcast((model.bucket_scores(), model.bias, model.blanks))  # one number a bucket

    @F.pandas_udf("double")
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*given.value)
        for part in parts:
            yield pd.Series(scorer.score([t if isinstance(t, str) else None for t in part]), dtype="float64")

    return docs.withColumn("score", rate(F.col("text").cast("string")))
