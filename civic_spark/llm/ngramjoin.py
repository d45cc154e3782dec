"""Jaccard similarity join on word n-grams by MinHash banding (operator 7).

Each text gives a signature of bands; texts that agree in a band meet in its bucket, and every pair that meets is decided
on the full sets of n-grams. A pair that agrees in several bands is decided in the first of them only. Large buckets are
cut into blocks of bounded size that meet pairwise, so no task holds a whole bucket, and what leaves a task is one row per text, not per pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import run_bounds, smallest_labels, whole_runs, written
from .covertree import star_edges
from .shingles import mixed, numbers, runs, word_hashes


def bands_for(least: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` hashes so that a pair of similarity ``least`` meets with probability ``recall`` or more."""
    meet = least**rows
    return 1 if meet >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def ngram_hashes(words: list[bytes], n: int) -> np.ndarray:
    """Hashes of the n-grams in order; a text of fewer words than ``n`` has one n-gram of them all."""
    h = word_hashes(words)
    return runs(h, min(n, len(h)), 7 + min(n, len(h))) if len(h) else h


def _signatures(batch: list[bytes], n: int, bands: int, rows: int) -> tuple[np.ndarray, list[int]]:
    """Band hashes of each text with words, and the places of those texts in the batch."""
    grams = [ngram_hashes(t.split(), n) for t in batch]
    at = [i for i, g in enumerate(grams) if len(g)]
    multiply, add = numbers(bands * rows, 101), mixed(numbers(bands * rows, 202))
    out = np.empty((len(at), bands), np.uint64)
    tags = numbers(rows, 303)
    group: list[int] = []
    size = 0

    def close(first: int) -> None:
        x = np.concatenate([grams[at[i]] for i in group])
        starts = np.cumsum([0] + [len(grams[at[i]]) for i in group[:-1]])
        for b in range(bands):
            total = np.full(len(group), b + 1, np.uint64)
            for r in range(rows):
                k = b * rows + r
                total += mixed(np.minimum.reduceat(x * multiply[k] + add[k], starts)) * tags[r]
            out[first : first + len(group), b] = mixed(total)

    for i in range(len(at)):
        group.append(i)
        size += len(grams[at[i]])
        if size >= 16_384 or i == len(at) - 1:
            close(group[0])
            group, size = [], 0
    return out, at


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, cls, words, bands`` of every text with words; ``cls`` is equal for equal texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for s in range(0, len(texts), 500):
                part = texts[s : s + 500]
                found, at = _signatures(part, n, bands, rows)
                if at:
                    flat = pa.array(found.view(np.int64).ravel(), pa.int64())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands), pa.int32()), flat)
                    cls = pa.array([hashlib.blake2b(part[i], digest_size=16).digest() for i in at], pa.binary())
                    size = pa.array([len(part[i]) for i in at], pa.int64())
                    yield pa.RecordBatch.from_arrays([ids.slice(s, 500).take(pa.array(at, pa.int64())), cls, size, lists], names=["doc_id", "cls", "bytes", "bands"])

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows_.mapInArrow(run, "doc_id long, cls binary, bytes long, bands array<long>")


def _first_meetings(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Pairs of rows that agree in ``band`` and in none before."""
    ok = a[:, None, band] == b[None, :, band]
    for s in range(band):
        ok &= a[:, None, s] != b[None, :, s]
    return ok


def similar(sets: list[np.ndarray], ok: np.ndarray, first: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs ``(i, first + j)`` marked in ``ok``, those whose sets have a Jaccard similarity of ``least`` or more."""
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(codes.max()) + 1, np.uint8)
    left, right = [], []
    for i in np.flatnonzero(ok.any(1)):
        j = np.flatnonzero(ok[i]) + first
        j = j[np.minimum(sizes[i], sizes[j]) >= least * np.maximum(sizes[i], sizes[j]) - 1e-9]
        if not len(j):
            continue
        own = codes[cuts[i] : cuts[i + 1]]
        mark[own] = 1
        spread = np.repeat(cuts[j] - np.concatenate([[0], np.cumsum(sizes[j])[:-1]]), sizes[j]) + np.arange(sizes[j].sum())
        common = np.add.reduceat(mark[codes[spread]], np.concatenate([[0], np.cumsum(sizes[j])[:-1]]), dtype=np.int64)
        mark[own] = 0
        # common / (a + b - common) >= least, without dividing
        good = common >= least * (sizes[i] + sizes[j] - common) - 1e-9
        left.append(np.full(int(good.sum()), i))
        right.append(j[good])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def join(docs: DataFrame, n: int = 5, least: float = 0.8, recall: float = 0.9999, rows: int = 4, block_rows: int = 4096, block_bytes: int = 16 << 20) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: ``doc_id, class_id, n_links, component_id``.

    Words are runs of characters other than white space, unchanged. Two documents are linked if their sets of ``n``-word
    runs have a Jaccard similarity of at least ``least``; a text of fewer words has one run of them all. ``class_id`` is the
    smallest doc_id with the same text, ``n_links`` counts the other rows linked directly, copies included, and
    ``component_id`` is the smallest doc_id reachable by links. Texts without words (NULL, empty, white space) link with
    nothing and are classes of their own. A doc_id of several rows has a result for each of them. Rows with a NULL doc_id take no part and come back with NULL classes. Every pair found is exact; a pair of
    similarity ``least`` is found with probability ``recall`` or more, a closer one more likely.
    """
    settings = dict(n=n, least=least, recall=recall, rows=rows, block_rows=block_rows, block_bytes=block_bytes)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    if not _ids_repeat(ids):
        return _join(ids, **settings)
    numbered = written(ids.withColumn("place", F.monotonically_increasing_id()), "rows")
    found = written(_join(numbered.where("doc_id is not null").select(F.col("place").alias("doc_id"), "text"), **settings).withColumnRenamed("doc_id", "place"), "found")
    told = numbered.select("place", "doc_id").join(found, "place", "left")
    first = [told.groupBy(c).agg(F.min("doc_id").alias(f"first_{c}")) for c in ("class_id", "component_id")]
    named = told.join(first[0], "class_id", "left").join(first[1], "component_id", "left")
    return named.select("doc_id", F.col("first_class_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("first_component_id").alias("component_id"))


def _ids_repeat(rows: DataFrame) -> bool:
    """Whether some doc_id stands in several rows: then rows are told apart by their place in a written copy."""
    ids = rows.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    return bool(ids.groupBy("doc_id").count().where("count > 1").limit(1).count())


def _join(ids: DataFrame, n: int, least: float, recall: float, rows: int, block_rows: int, block_bytes: int) -> DataFrame:
    """The join of rows ``(doc_id, text)`` in which no doc_id occurs twice."""
    bands = bands_for(least, recall, rows)
    sig = written(signatures(ids.where("doc_id is not null"), n, bands, rows), "signatures")
    classes = written(sig.groupBy("cls", "bands", "bytes").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    needed = _candidates(classes, bands, block_rows, block_bytes)
    found = written(_verified(ids, needed, n, least), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = smallest_labels(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    answers = written(
        classes.select("cls", "rep", "copies").join(links, "rep", "left").join(roots, "rep", "left").select(
            "cls", F.col("rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
        ),
        "answers",
    )
    known = sig.select("doc_id", "cls").join(answers, "cls").select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    wordless = ids.where(F.col("doc_id").isNull() | ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return known.union(wordless.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id")))


def _candidates(classes: DataFrame, bands: int, block_rows: int, block_bytes: int) -> DataFrame:
    """``rep, copies, bands, band, block``: each text once for every block in which it meets another for the first time."""
    members = classes.select("rep", "bytes", F.posexplode("bands").alias("band", "bucket"))
    sizes = members.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).where("n > 1")
    cuts = F.greatest(F.ceil(F.col("n") / F.lit(block_rows)), F.least(F.col("n"), F.ceil(F.col("b") / F.lit(block_bytes)))).cast("long")
    buckets = written(sizes.select("band", "bucket", cuts.alias("cuts")), "buckets")
    # a merge join at every size: the rows exchanged stay in proportion to the input
    shared = members.drop("bytes").join(buckets.hint("merge"), ["band", "bucket"]).withColumn("own", F.pmod(F.xxhash64("rep", "band"), F.col("cuts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    met = shared.withColumn("other", other).select(
        "rep", "band", F.xxhash64("band", "bucket", low, high).alias("block"), (F.col("own") == low).alias("left"), (F.col("own") == F.col("other")).alias("same")
    )
    meetings = met.join(classes.select("rep", "copies", "bands").hint("merge"), "rep").select("rep", "copies", "bands", "band", "block", "left", "same")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "block"):
            table = table.combine_chunks()
            blocks, band = table["block"].to_numpy(), table["band"].to_numpy()
            sides = table["bands"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(blocks), -1)
            left, same = table["left"].to_numpy(), table["same"].to_numpy()
            stay = np.zeros(len(blocks), bool)
            for a, b in run_bounds(blocks):
                if b - a > 1:
                    i, j, ok = _meetings(sides[a:b], left[a:b], bool(same[a]), int(band[a]))
                    stay[a:b][i[ok.any(1)]] = True
                    stay[a:b][j[ok.any(0)]] = True
            yield from table.filter(pa.array(stay)).to_batches()

    dealt = meetings.repartition("block").sortWithinPartitions("block", "rep")
    return dealt.mapInArrow(keep, meetings.schema)


def _meetings(bands: np.ndarray, left: np.ndarray, same: bool, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the two sides of a block, and which pairs of them first meet in ``band``."""
    if same:
        at = np.arange(len(bands))
        return at, at, np.triu(_first_meetings(bands, bands, band), 1)
    i, j = np.flatnonzero(left), np.flatnonzero(~left)
    return i, j, _first_meetings(bands[i], bands[j], band)


def _verified(ids: DataFrame, needed: DataFrame, n: int, least: float) -> DataFrame:
    """``rep, links, root``: what each block adds to a text's links, and the smallest text it reaches there."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "block"):
            table = table.combine_chunks()
            blocks, rep, copies = (table[c].to_numpy() for c in ("block", "rep", "copies"))
            sides = table["bands"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(blocks), -1)
            left, same, band = (table[c].to_numpy() for c in ("left", "same", "band"))
            texts = table["text"]
            out: list[tuple[np.ndarray, ...]] = []
            for a, b in run_bounds(blocks):
                at = a + np.unique(rep[a:b], return_index=True)[1]  # a row that is repeated in the input comes once
                if len(at) < 2:
                    continue
                sets = [np.unique(ngram_hashes(texts[int(k)].as_py().encode("utf-8", "surrogatepass").split(), n)) for k in at]
                i, j, ok = _meetings(sides[at], left[at], bool(same[a]), int(band[a]))
                both = np.concatenate([i, j]) if not same[a] else i
                p, q = similar([sets[k] for k in both], ok, 0 if same[a] else len(i), least)
                if not len(p):
                    continue
                p, q = both[p], both[q]
                links = np.zeros(len(at), np.int64)
                np.add.at(links, p, copies[at][q])
                np.add.at(links, q, copies[at][p])
                some = np.flatnonzero(links)
                out.append((rep[at][some], links[some], rep[at][star_edges(len(at), p, q)[some]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], names=["rep", "links", "root"])

    texts = ids.where("doc_id is not null").select(F.col("doc_id").alias("rep"), F.col("text").cast("string").alias("text"))
    with_text = needed.join(texts, "rep").select("block", "rep", "copies", "bands", "band", "left", "same", "text")
    return with_text.repartition("block").sortWithinPartitions("block", "rep").mapInArrow(decide, "rep long, links long, root long")


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that stay: of every group of linked rows the one with the smallest doc_id.

    Of linked rows with that doc_id, that with the smallest hash of its text stays, of equal rows any one. Rows that are linked with
    nothing stay, whatever their doc_id: documents without words, rows without a doc_id, rows of one doc_id with unrelated
    texts. All columns are kept; an empty table stays empty.
    """
    if not _ids_repeat(docs):
        found = join(docs, **settings)
        gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
        return docs.join(written(gone, "gone"), F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("place"))
    rows = written(rows, "rows")
    texts = rows.select("place", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text")).where("doc_id is not null")
    found = join(texts.select(F.col("place").alias("doc_id"), "text"), **settings).select(F.col("doc_id").alias("place"), "component_id")
    ranked = texts.select("place", "doc_id", F.xxhash64("text").alias("draw")).join(found, "place")
    first = ranked.groupBy("component_id").agg(F.min(F.struct("doc_id", "draw", "place")).alias("first"))
    gone = ranked.join(first, "component_id").where("place <> first.place").select("place")
    return rows.join(written(gone, "gone"), "place", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
