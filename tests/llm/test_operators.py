"""Every operator on its whole table at the smallest scale, and on rows with nulls, empty and long texts, ties and copies."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from civic_spark.llm import covertree, hnsw, mixing, ngramjoin, packing, quality, sharding, substrings, tokenfile, warc
from civic_spark.llm.queries import QUERIES, word_tokenizer

from . import brute

FOLDER = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"p{i}" for i in range(60))
TEXTS = [
    (1, PASSAGE),
    (2, PASSAGE),
    (3, "start " + PASSAGE + " end"),
    (4, None),
    (5, ""),
    (6, " \n\t "),
    (7, "one two"),
    (8, "one two"),
    (9, "x " * 3000),
    (10, " ".join(f"q{i}" for i in range(34))),
    (11, " ".join(f"q{i}" for i in range(34))),
    (12, "nb sp naïve ÑANDÚ <|endoftext|> it's 42!! " * 9),
    (13, "long" * 5000),
    (14, " ".join(f"w{i % 7}" for i in range(200))),
]


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Read from files, with columns that results use too."""
    path = str(tmp_path_factory.mktemp("texts") / "docs")
    rows = [(d, t, "abc"[d % 3] if d % 5 else None, 0, 1.5, "k") for d, t in TEXTS]
    spark.createDataFrame(rows, "doc_id long, text string, source string, size int, score double, kept string").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "docs")
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(path)
    return spark.read.parquet(path)


def given(spark, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(*columns).collect()]


def keyed(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


def test_warc(spark):
    rows = [(1, "http://a", "x"), (2, "http://b", "x"), (9, None, "x"), (3, "u\r\nv", None), (4, "http://c", ""), (5, "http://d", "é" * 400_000)]
    index, folder = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = keyed(warc.read_records(index, folder), "page_id", "payload_bytes", "payload_digest", "kind", "refers_to")
    assert got == brute.warc([(p, h) for p, _, h in rows])
    assert keyed(QUERIES["op1_warc_normalise"](spark, FOLDER), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == brute.warc(given(spark, "pages", "page_id", "html"))


def test_warc_cut_off_is_an_error():
    import gzip
    import io

    raw = gzip.compress(warc.record("response", 1, "u", b"abc", warc.digest(b"abc")))
    assert len(list(warc.split_records(warc.inflated(io.BytesIO(b""))))) == 0
    with pytest.raises(ValueError):
        for _, pieces in warc.split_records(warc.inflated(io.BytesIO(raw[:-30]))):
            list(pieces)


def test_nearest(spark):
    got = defaultdict(list)
    for r in QUERIES["op2_hnsw_search"](spark, FOLDER).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = brute.nearest(given(spark, "embeddings", "vec_id", "embedding"), lambda q: q % 100 == 0, 10)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert got.keys() == want.keys() and hits >= 0.9 * sum(map(len, want.values()))


VECTORS = [(i, [1.0, 0.0]) for i in range(0, 30)] + [(100, [0.0, 1.0]), (101, [0.0, 0.0]), (102, None), (103, [1.0, None]), (104, [float("nan"), 1.0]), (105, [0.1, 1.0]), (106, [1.0, 2.0, 3.0]), (107, [2.0, 0.0])]


@pytest.mark.parametrize("n", [1, 2, 11, 33, 90])
def test_small_shards_are_searched_alike(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit(1).alias(c) for c in ("id", "vec", "dim", "score")])
    got = defaultdict(list)
    for r in hnsw.nearest(df, F.lit(True), k=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"]))
    want = brute.nearest(rows, lambda q: True, 10)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= (1 if n <= 33 else 0.95) * sum(map(len, want.values()))


def test_nearest_of_copies(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in hnsw.nearest(df, F.col("id") % 20 == 0, k=3).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"]))
    assert got == brute.nearest([v for v in VECTORS if v[0] != 106], lambda q: q % 20 == 0, 3)
    assert hnsw.nearest(df.where("vec_id < 0"), F.lit(True)).count() == 0


def test_graph_recall():
    x = np.random.default_rng(0).normal(size=(3000, 32))
    nodes, links = hnsw.build(x, 16, 48, 1)
    found = hnsw.search(x, nodes, links, x[:100], 64)[1]
    want = np.argsort(((x[:100, None] - x[None]) ** 2).sum(2), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(found, want)]) >= 9


def test_linked_vectors(spark):
    want = brute.linked_vectors(given(spark, "embeddings", "vec_id", "embedding"), 0.95)
    assert keyed(QUERIES["op3_cover_tree_dedup"](spark, FOLDER), "vec_id", "n_links", "component_id") == want
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>")
    plain = [v for v in VECTORS if v[0] != 106]
    got = keyed(covertree.near_duplicates(df, unit_rows=2), "id", "n_links", "component_id")
    assert got.pop(106) == (0, 106) and got == brute.linked_vectors(plain, 0.95)
    assert covertree.near_duplicates(df.where("vec_id < 0")).count() == 0


def disk_of_exchanges(spark):
    """Bytes of the session's shuffle files."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(f.stat().st_size for d in folders for f in Path(d.getPath()).rglob("*") if f.is_file())


def test_units_that_meet_are_not_copied(spark):
    """Vectors spread evenly: some 60 units meet pairwise, and exchanges stay a small multiple of the vectors."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))
    x[2000:2600] = x[:600] + rng.normal(size=(600, 64)) * 0.1  # near copies
    x[2600:2900] = x[0] + rng.normal(size=(300, 64)) * 0.15  # many of one vector
    x[2900:] = x[1]
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32).astype(float))]
    df = spark.createDataFrame(rows, "id long, vec array<float>")
    before = disk_of_exchanges(spark)
    got = covertree.near_duplicates(df, id_column="id", vector="vec", unit_rows=64)
    assert disk_of_exchanges(spark) - before < 16e6
    assert keyed(got, "id", "n_links", "component_id") == brute.linked_vectors(rows, 0.95)


def test_vectors_that_differ_in_the_sign_of_zero_are_copies(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [-0.0, 1.0]), (3, [-0.0, 1.0]), (3, [-0.0, 1.0]), (4, [1e-300, 1.0]), (5, [1.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in covertree.near_duplicates(df, least=1.0).collect())
    assert got == [(1, 4, 1), (2, 4, 1), (3, 4, 1), (3, 4, 1), (4, 4, 1), (5, 0, 5)]


@pytest.mark.parametrize("spread", [0.02, 0.1, 0.4])
def test_dual_traversal_on_groups(spread):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(12, 1, 24)) + rng.normal(size=(12, 40, 24)) * spread).reshape(-1, 24)
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b = x[::2], x[1::2]
    trees = [covertree.levels_of(y, covertree.nested_levels(y, 3)) for y in (a, b)]
    near = {tuple(p) for p in np.argwhere(np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)) <= 0.3).tolist()}
    for step in (7, 1 << 20):
        found = [(i, j) for i, j in covertree.descend(*trees, 0.3, step)]
        pairs = [p for i, j in found for p in zip(i.tolist(), j.tolist())]
        assert near <= set(pairs) and len(set(pairs)) == len(pairs) < len(a) * len(b) and all(len(i) <= step for i, _ in found)


def test_cover_tree_prunes_nothing_near():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    up = covertree.nested_levels(x, 3)
    i, j = covertree.near_pairs(x, x, up, up, 0.3)
    near = np.argwhere(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= 0.3)
    assert {tuple(p) for p in near.tolist()} <= set(zip(i.tolist(), j.tolist())) and len(i) < 400 * 400


@pytest.mark.parametrize("settings", [{}, {"group_contents": 1, "bucket_contents": 2, "block_rows": 2}, {"group_contents": 3, "bucket_contents": 4, "block_rows": 1}])
def test_substrings(spark, texts, none, settings):
    got = keyed(substrings.without_repeats(texts, **settings), "doc_id", "n_words", "n_removed", "kept")
    assert got == brute.without_repeats(TEXTS, 35)
    assert substrings.without_repeats(none, **settings).count() == 0


def test_substrings_whole_table(spark):
    want = {d: (n, m, hashlib.sha256(k.encode()).hexdigest()) for d, (n, m, k) in brute.without_repeats(given(spark, "documents", "doc_id", "text"), 35).items()}
    assert keyed(QUERIES["op4_substring_dedup"](spark, FOLDER), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_substrings_lengthened_prefixes(spark):
    """Very many surroundings of one prefix: its windows are told apart by longer and longer prefixes."""
    rng = np.random.default_rng(12)
    stem = [f"a{i}" for i in range(8)]
    rows = []
    for d in range(160):
        before, after = ([f"{w}{rng.integers(0, 2)}" for w in "bcdefghijk" for _ in range(4)] for _ in range(2))
        rows.append((d, " ".join([*before, *stem, *after])))
    rows += [(200 + d, rows[d][1]) for d in range(0, 160, 9)] + [(600 + d, rows[d][1] + " tail") for d in range(0, 160, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = keyed(substrings.without_repeats(docs, group_contents=3, bucket_contents=20, block_rows=16), "doc_id", "n_words", "n_removed", "kept")
    assert got == brute.without_repeats(rows, 35)


def test_substrings_one_file_has_many_lists(spark, tmp_path):
    """A file of many rows: its lists are kept in blocks, each written by a task of its own."""
    rows = [(d, " ".join(f"v{(d % 50) * 100 + i}" for i in range(40))) for d in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/one")
    docs = spark.read.parquet(f"{tmp_path}/one")
    located = substrings._located(docs, 64)
    assert located.select("loc").distinct().count() == 1 and located.select("block").distinct().count() == 10
    folder = substrings.repeats(located)
    kept = spark.read.parquet(folder)
    assert kept.select("block").distinct().count() == 10
    files = [f for f in kept.inputFiles()]
    assert len(files) >= 10 and all("/block=" in f for f in files)
    lists = substrings.Lists(folder, ["at", "mask"])
    loc = located.first()["loc"]
    assert all(set(lists.of(loc, b)) <= set(range(64 * b, 64 * b + 64)) and lists.of(loc, b) for b in range(10))
    got = keyed(substrings.without_repeats(docs, block_rows=64), "doc_id", "n_words", "n_removed", "kept")
    assert got == brute.without_repeats(rows, 35)


def test_substrings_rows_without_files(spark):
    rows = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (None, "a b")], "doc_id long, text string")
    got = sorted((r["n_words"], r["n_removed"]) for r in substrings.without_repeats(rows).collect())
    assert got == [(2, 0), (60, 60), (60, 60)]  # a repeated row is another place


def test_quality(spark, texts, none):
    rows = QUERIES["op5_pu_quality"](spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) == 1000 and np.mean([p == y for p, y in held]) >= 0.9
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    labels = spark.createDataFrame([(1, 1), (7, 0), (9, None), (None, 1)], "doc_id long, quality int")
    scored = quality.score(texts, quality.fit(texts, labels, F.lit(True))).collect()
    assert len(scored) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.score(none, quality.fit(none, labels.limit(0), F.lit(True))).count() == 0


def test_quality_risk_is_the_formula():
    """The trained weights do not raise the non-negative risk, written out row by row."""
    rng = np.random.default_rng(8)
    good, bad = rng.normal(1, 1, (300, quality.N_FEATURES)), rng.normal(-1, 1, (100, quality.N_FEATURES))
    positive, unlabelled = good[:120].astype(np.float32), np.concatenate([good[120:], bad]).astype(np.float32)
    prior = len(good[120:]) / len(unlabelled)

    def risk(model):
        loss = lambda s, y: -np.log(max(s if y else 1 - s, 1e-12))
        as_good = np.mean([loss(s, 1) for s in model.score(positive)])
        as_bad = np.mean([loss(s, 0) for s in model.score(positive)])
        return prior * as_good + max(0.0, np.mean([loss(s, 0) for s in model.score(unlabelled)]) - prior * as_bad)

    short, long = quality.train(positive, unlabelled, prior, rounds=2), quality.train(positive, unlabelled, prior)
    assert risk(long) < risk(short)
    assert (long.score(good) > 0.5).mean() > 0.95 and (long.score(bad) < 0.5).mean() > 0.95


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_prior_from_positives_and_unlabelled(share):
    rng = np.random.default_rng(9)
    make = lambda middle, n: rng.normal(middle, 1, (n, quality.N_FEATURES)).astype(np.float32)
    n = 3000
    found = quality.estimated_prior(make(0.4, 1500), np.concatenate([make(0.4, int(n * share)), make(-0.4, n - int(n * share))]))
    assert abs(found - share) < 0.08  # 1500 and 3000 rows, half of them to estimate from
    assert quality.estimated_prior(make(0, 0), make(0, 9)) == 0.5


def test_quality_reads_a_bounded_sample(spark):
    docs = spark.range(3000).selectExpr("id % 3 AS doc_id", "concat('text ', id) AS text")  # an id of very many rows
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    positive, unlabelled = quality.samples(docs, labels, F.lit(True), 50, 3)
    assert len(positive) == len(unlabelled) == 50
    again = quality.samples(docs.repartition(7), labels, F.lit(True), 50, 3)
    assert (positive == again[0]).all() and (unlabelled == again[1]).all()


def test_mix(spark, texts, none):
    docs = [(d, t, "abc"[d % 3] if d % 5 else None) for d, t in TEXTS]
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(brute.words(t))
    want = brute.targets(dict(sizes), (5, 2, 1), 1.5, 2)
    rows = mixing.mix(texts).collect()
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r["copies"] <= 2 and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["size"] * r["copies"]
    assert len(rows) == len(docs) and all(0 <= want[s] - taken[s] <= 3000 for s in sizes)
    assert mixing.mixed(texts).columns == texts.columns and mixing.mixed(texts).count() == sum(r["copies"] for r in rows)
    assert mixing.mix(none).count() == 0
    shuffled = mixing.mix(texts.repartition(5)).collect()  # no row changes its place between two reads
    assert len(shuffled) == len(docs) and all(0 <= want[s] - sum(r["size"] * r["copies"] for r in shuffled if r["source"] == s) <= 3000 for s in sizes)
    run = lambda: keyed(QUERIES["op6_source_mix"](spark, FOLDER), "doc_id", "size", "source_size", "target", "taken")
    assert run() == run()


def test_fit_meets_the_budget():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 90, 12))
        counts = rng.integers(1, 9, len(lengths))
        budget = int(rng.integers(0, int((lengths * counts).sum()) + 20))
        take = mixing.fit(lengths, counts, budget)
        sums = {0}
        for size, n in zip(lengths.tolist(), counts.tolist()):
            sums = {s + size * k for s in sums for k in range(n + 1) if s + size * k <= budget}
        assert (take >= 0).all() and (take <= counts).all()
        assert max(sums) - 2 <= int((lengths * take).sum()) <= max(sums)


def test_ngram_join(spark, texts, none):
    got = keyed(ngramjoin.join(texts), "doc_id", "class_id", "n_links", "component_id")
    assert got == brute.linked_texts(TEXTS, 5, 0.8)
    assert keyed(ngramjoin.join(texts, block_rows=1), "doc_id", "class_id", "n_links", "component_id") == got
    want = brute.linked_texts(given(spark, "documents", "doc_id", "text"), 5, 0.8)
    assert keyed(QUERIES["op7_ngram_join"](spark, FOLDER), "doc_id", "class_id", "n_links", "component_id") == want
    assert ngramjoin.join(none).count() == 0
    kept = ngramjoin.deduplicated(texts)
    assert kept.columns == texts.columns and {r["doc_id"] for r in kept.collect()} == {d for d, v in got.items() if v[2] == d}


SAME = " ".join(f"s{i}" for i in range(50))
REPEATED = [(1, PASSAGE), (1, "quite another text of a few words"), (1, PASSAGE), (2, PASSAGE + " more"), (3, SAME), (3, SAME + " x"), (None, SAME), (None, None), (4, ""), (4, ""), (5, "alone")]


def test_ngram_join_of_repeated_ids(spark):
    """Rows of one doc_id are rows of their own: linked or not by their texts."""
    rows = spark.createDataFrame(REPEATED, "doc_id long, text string").select("*", F.lit("k").alias("place"), F.lit(1).alias("row"))
    got = sorted((r["doc_id"] or -1, r["class_id"], r["n_links"], r["component_id"]) for r in ngramjoin.join(rows).collect() if r["doc_id"])
    # the two rows of equal text, and that with one word more, are linked; the unrelated one is not
    assert got == [(1, 1, 0, 1), (1, 1, 2, 1), (1, 1, 2, 1), (2, 2, 2, 1), (3, 3, 1, 3), (3, 3, 1, 3), (4, 4, 0, 4), (4, 4, 0, 4), (5, 5, 0, 5)]
    kept = ngramjoin.deduplicated(rows)
    assert kept.columns == rows.columns
    found = sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    threes = [t for d, t in found if d == 3]
    assert len(threes) == 1 and [x for x in found if x[0] != 3] == [(0, ""), (0, SAME), (1, PASSAGE), (1, "quite another text of a few words"), (4, ""), (4, ""), (5, "alone")]
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in ngramjoin.deduplicated(rows.repartition(5)).collect()) == found


def test_bands_meet_the_recall():
    for rows in (3, 4, 5):
        bands = ngramjoin.bands_for(0.8, 0.9999, rows)
        assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 > 1 - (1 - 0.8**rows) ** (bands - 1)


def test_shards(spark, texts, none):
    rows = sharding.shard(texts.select("doc_id", "text"), shards=3).collect()
    size = {d: len((t or "").encode()) + 16 for d, t in TEXTS}
    assert {r["doc_id"]: r["size"] for r in rows} == size
    rows = QUERIES["op8_histogram_shards"](spark, "/root/testdata/sf0.01").collect()
    text = dict(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    slots, total = defaultdict(list), defaultdict(int)
    for r in rows:
        assert r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
        slots[r["shard"]].append(r["slot"])
        total[r["shard"]] += r["size"]
    assert sorted(slots) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(total.values()) - min(total.values()) <= max(len(t.encode()) + 16 for t in text.values())
    assert sharding.shard(none).count() == 0


@pytest.mark.parametrize("run_rows", [3, 40, 200_000])
def test_shards_against_a_full_sort(spark, run_rows):
    """Shards and slots are those of all rows in the order of (text hash, doc_id), cut where the bytes say."""
    rng = np.random.default_rng(14)
    rows = [(int(i) if i % 17 else None, "x" * int(n)) for i, n in enumerate(rng.integers(0, 400, 300))]
    rows += [(1000 + i, "hot text") for i in range(250)] + [(7, "hot text")] * 3 + [(None, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(5).alias("key"), F.lit(1).alias("unit"), F.lit(2).alias("size"))
    hashes = dict(docs.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit("")))).distinct().collect())
    got = sharding.shard(docs, shards=6, run_rows=run_rows).collect()
    crc = {zlib.crc32(t.encode()): t for t in hashes}
    placed = sorted((r["shard"], r["slot"], hashes[crc[r["text_crc32"]]], -1 << 63 if r["doc_id"] is None else r["doc_id"], r["size"]) for r in got)
    assert [p[2:] for p in placed] == sorted(p[2:] for p in placed) and len(placed) == len(rows)
    total, at, most = sum(p[4] for p in placed), 0, max(p[4] for p in placed)
    for shard in range(6):
        own = [p for p in placed if p[0] == shard]
        assert [p[1] for p in own] == list(range(len(own)))
        at += sum(p[4] for p in own)
        assert abs(at - total * (shard + 1) / 6) <= max(most, 0.01 * total / 6)


def test_shards_cut_one_large_group(spark):
    rows = spark.createDataFrame([(i, "same text") for i in range(400)] + [(i, f"t{i}") for i in range(400, 420)], "doc_id long, text string")
    total = defaultdict(int)
    for r in sharding.shard(rows, shards=8).collect():
        total[r["shard"]] += r["size"]
    assert len(total) == 8 and max(total.values()) - min(total.values()) <= 100


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_tokenizer())
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_is_the_library(encode):
    """Words, signs, marks and special strings in any mixture, against the plain tokenizer."""
    rng = np.random.default_rng(7)
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "it's", "DON'T", "'re", "x'LL", "naïve,", "ÑANDÚ!!", " ", "\n", "\x1c", "\x85", "\u00a0", "ß", "İ", "ſ", "ﬁ", "é", "e\u0301", "中文", "٣", "🙂", "Σς", "a", "b'", "9", "...", "µ", "×"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 12))) for _ in range(3000)] + ["long" * 5000, "é" * 3000]
    from civic_spark.llm.tokens import Encoder

    got = Encoder(word_tokenizer()).encode([t.encode() for t in texts] + [None])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [*map(encode, texts), []]
    assert encode("a <|endoftext|> b") == [320, 49407, 321]


def test_encoder_lowers_texts_only_where_case_cannot_count(encode):
    """One entry for a word however it is written; marks that join small letters only, and special strings, keep their case."""
    from civic_spark.llm.tokens import Encoder

    encoder = Encoder(word_tokenizer())
    texts = ["The THE the", "tHe. THE.", "H\u0331 h\u0331", "T\u0344 t\u0344", "J\u030cX J\u030c.", "I\u0307 A\u030a", "<|EndOfText|> <|endoftext|>", "İX ÀB K"]
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in texts])]
    assert got == [*map(encode, texts)]
    encoder = Encoder(word_tokenizer())
    list(encoder.encode([t.encode() for t in texts[:2]]))
    assert set(encoder.words) == {b"the", b"the.", b"."}


def test_read_ids_go_through_python_once(spark, texts):
    folder = tokenfile.write_token_files(texts, word_tokenizer(), 1)
    plan = tokenfile.token_digest(tokenfile.read_token_files(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_packing(spark, texts, none, encode):
    rows = packing.pack_documents(texts, word_tokenizer(), 2, 512, 3).collect()
    parts, bins = defaultdict(list), defaultdict(list)
    ids = {d: np.array([*encode(t or ""), 2], "<u4") for d, t in TEXTS}
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        parts[r["doc_id"]].append((r["start"], r["length"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for found, whole in [(parts[d], len(ids[d])) for d in ids] + [(b, 512) for b in bins.values()]:
        end = 0
        for start, length in sorted(found):
            assert start == end
            end += length
        assert end <= whole and len(found) <= (3 if whole == 512 else len(found))
    assert all(sum(n for _, n in parts[d]) == len(ids[d]) for d in ids)
    assert packing.pack_documents(none, word_tokenizer()).count() == 0


def test_packing_limits():
    rng = np.random.default_rng(3)
    tokens, loss = rng.integers(1, 900, 500), rng.integers(0, 300, 500)
    bins, offsets = packing.fill(tokens, np.ones(500, int), loss, (1024, 6, 400))
    for b in np.unique(bins):
        at = bins == b
        assert tokens[at].sum() <= 1024 and at.sum() <= 6 and loss[at].sum() <= 400
        assert sorted(offsets[at]) == sorted(np.concatenate([[0], np.cumsum(tokens[at][np.argsort(offsets[at])])[:-1]]))
    with pytest.raises(ValueError):
        packing.fill(np.array([5000]), np.array([1]), np.array([0]), (4096, 6, 400))


def test_token_files(spark, texts, none, encode):
    folder = tokenfile.write_token_files(texts, word_tokenizer(), 1, frame_bytes=256)
    got = keyed(tokenfile.token_digest(tokenfile.read_token_files(spark, folder)), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == brute.token_rows(TEXTS, encode, 1)
    some = keyed(tokenfile.token_digest(tokenfile.read_token_files(spark, folder, [3, 12])), "doc_id", "start", "n_tokens", "ids_crc32")
    assert some == {d: got[d] for d in (3, 12)}
    empty = tokenfile.write_token_files(none, word_tokenizer())
    assert tokenfile.read_token_files(spark, empty).count() == 0
    want = brute.token_rows(given(spark, "documents", "doc_id", "text"), encode, 1)
    assert keyed(QUERIES["op10_token_frames"](spark, FOLDER), "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_token_file_damage_is_noticed(tmp_path):
    path = f"file://{tmp_path}/a.zst"
    writer = tokenfile.Writer(path, 64, 1)
    for d in range(5):
        writer.add(d, np.arange(30, dtype="<u4").tobytes())
    writer.close()
    raw = bytearray((tmp_path / "a.zst").read_bytes())
    assert len(list(tokenfile.Reader(path).documents())) == 5
    raw[len(raw) - 9 - 3] ^= 255  # in the last frame's checksum
    (tmp_path / "a.zst").write_bytes(raw)
    with pytest.raises(ValueError):
        list(tokenfile.Reader(path).documents())
