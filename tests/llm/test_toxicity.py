"""Subword classifier: held-out accuracy, unseen misspellings, and rows of every odd kind."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from civic_spark.llm import toxicity
from civic_spark.llm.queries import QUERIES
from civic_spark.llm.subwords import different_words, grams


def test_held_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op11_subword_toxicity"](spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    bad, good = ([s for s, y in held if y == k] for k in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in bad for b in good]) >= 0.9
    assert np.mean([(s >= 0.5) == y for s, y in held]) >= 0.9


def sentences(rng, n, odd):
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("n", "nt", "ra", "lo", "ster")]
    return [" ".join([*rng.choice(words, 40), *([odd[rng.integers(len(odd))]] if odd else [])]) for _ in range(n)]


def test_unseen_misspellings_count():
    rng = np.random.default_rng(4)
    texts = sentences(rng, 150, ["wretchkin", "wretchkins", "awretchkin"]) + sentences(rng, 300, [])
    model = toxicity.train(texts, np.r_[np.ones(150), np.zeros(300)], 1 / 3)
    scorer = toxicity.Scorer(model.bucket_scores(), model.bias, model.blanks)
    unseen = sentences(rng, 20, ["wretchk1n", "wrretchkin", "wretchkinz"])
    assert (scorer.score(unseen) >= 0.5).all() and (scorer.score(sentences(rng, 50, [])) < 0.5).all()
    # a text's score is the softmax of the mean of its words' means, vector by vector
    text = unseen[0]
    mean = np.zeros(model.vectors.shape[1])
    for word in different_words(text):
        mean += model.vectors[grams([word], len(model.vectors))[0]].mean(0)
    z = model.scale * (mean / (len(different_words(text)) + model.blanks)) @ model.softmax + model.bias
    assert np.isclose(scorer.score([text])[0], 1 / (1 + np.exp(-z)))


def test_grams_of_words():
    found, counts = grams(["ab", "abab", "é"], 1 << 30)
    assert counts.tolist() == [3 + 1, 4 + 3 + 2 + 1 + 1, 1 + 1] and len(found) == counts.sum()
    again, _ = grams(["abab"], 1 << 30)
    assert again.tolist() == found[4:15].tolist() and len(set(found[:4]) & set(again)) >= 1
    assert grams([], 8)[0].size == 0 and different_words(None) == different_words(" !! \n") == set()
    assert different_words("Ab ab, (AB) c--") == {"ab", "c"}


def test_odd_rows(spark):
    rows = [(1, "x y"), (1, "x y"), (2, None), (3, ""), (4, " \n"), (None, "z"), (5, "long" * 60_000), (6, "w " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("q").alias("id"), F.lit(1).alias("toxic"), F.lit(1.0).alias("score"), F.lit(0).alias("draw"))
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (4, None), (None, 1), (5, 0), (6, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    got = toxicity.score(docs, model)
    assert got.columns == docs.columns
    told = [(r["text"], r["score"]) for r in got.collect()]
    assert len(told) == len(rows) and all(0 <= s <= 1 for _, s in told)
    assert len({s for t, s in told if not (t or "").strip()}) == 1 and len({s for t, s in told if t == "x y"}) == 1
    empty = toxicity.fit(docs.limit(0), labels.limit(0), F.lit(True))
    assert toxicity.score(docs.limit(0), empty).count() == 0


def test_training_reads_a_bounded_sample(spark, monkeypatch):
    read = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic, prior: read.append((len(texts), int(np.sum(toxic)), round(prior, 2))))
    docs = spark.range(400).selectExpr("id % 200 AS doc_id", "concat('text ', id) AS text")  # each id has two texts
    labels = spark.range(200).selectExpr("id AS doc_id", "CAST(id % 4 = 0 AS int) AS toxic")
    toxicity.fit(docs, labels, F.lit(True), rows_kept=20)
    toxicity.fit(docs, labels, F.lit(True), bytes_kept=160)
    toxicity.fit(docs, labels, F.lit(True), text_bytes=3)
    (rows, toxic, prior), (few, _, _), none = read
    # 'text 7' to 'text 399' hold 6 to 8 bytes, so half of 160 bytes is 10 to 13 texts of each class
    assert (rows, toxic, prior) == (20, 10, 0.25) and 20 <= few <= 26 and none == (0, 0, 0.25)
