"""The thirteen operators as registered queries, with production parameters, over their whole tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import covertree, hnsw, merkle, mixing, ngramjoin, packing, quality, sharding, substrings, tokenfile, toxicity, warc, whitening

#: Decisions at these scores and above are for the good class and for the toxic one.
GOOD, TOXIC = 0.3, 0.5


def word_tokenizer() -> str:
    """Place of the public vocabulary file; the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc_normalise(spark: SparkSession, folder: str) -> DataFrame:
    index, place = warc.archive(_table(spark, folder, "pages"))
    read = warc.read_records(index, place)
    return read.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def op2_hnsw_search(spark: SparkSession, folder: str) -> DataFrame:
    found = hnsw.nearest(_table(spark, folder, "embeddings"), F.col("id") % 100 == 0, k=10)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op3_cover_tree_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = covertree.near_duplicates(_table(spark, folder, "embeddings"), least=0.95)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.without_repeats(_table(spark, folder, "documents"), size=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_pu_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, folder, "labels"), ~quality.held_out())
    return quality.score(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )


def op6_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mix(_table(spark, folder, "documents"), keep=["doc_id"])
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngramjoin.join(_table(spark, folder, "documents"), n=5, least=0.8)


def op8_histogram_shards(spark: SparkSession, folder: str) -> DataFrame:
    found = sharding.shard(_table(spark, folder, "documents"), shards=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_vector_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), word_tokenizer(), end_id=2, max_tokens=4096)


def op10_token_frames(spark: SparkSession, folder: str) -> DataFrame:
    place = tokenfile.write_token_files(_table(spark, folder, "documents"), word_tokenizer(), end_id=1)
    return tokenfile.token_digest(tokenfile.read_token_files(spark, place))


def op11_subword_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, folder, "labels"), ~quality.held_out())
    return toxicity.score(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted")
    )


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    now = F.when(tampered, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    checked = merkle.verified(merkle.build(_table(spark, folder, "documents"), now, fan=8))
    return checked.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op13_jacobi_davidson_whitening(spark: SparkSession, folder: str) -> DataFrame:
    found = whitening.whiten(_table(spark, folder, "embeddings"), components=8)
    return found.select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_normalise, op2_hnsw_search, op3_cover_tree_dedup, op4_substring_dedup, op5_pu_quality,
        op6_source_mix, op7_ngram_join, op8_histogram_shards, op9_vector_packing, op10_token_frames,
        op11_subword_toxicity, op12_merkle_manifest, op13_jacobi_davidson_whitening,
    )
}

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: DuckDB statements, where SQL can say what a query returns. The others are tested against brute force.
ORACLES: dict[str, str] = {
    "op1_warc_normalise": f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
        m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
        SELECT page_id, n AS payload_bytes,
          array_to_string(list_transform(range(32), lambda i: substr('{_LETTERS}', 1 + (
            (('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31)::INTEGER, 1)), '') AS payload_digest,
          CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id <> top THEN top END AS refers_to
        FROM p JOIN m USING (h)""",
    "op3_cover_tree_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id
              WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
        r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
        k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(k.n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM v JOIN c ON c.a = vec_id LEFT JOIN k ON k.a = vec_id""",
    "op4_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
        k AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS t FROM s),
        g AS (SELECT t FROM k GROUP BY t HAVING count(*) > 1),
        x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM k JOIN g USING (t)),
        gone AS (SELECT doc_id, list(j) AS js FROM x GROUP BY doc_id),
        kept AS (SELECT doc_id, len(w) AS n, CASE WHEN js IS NULL THEN w ELSE list_transform(
                 list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: NOT list_contains(js, p[2])), lambda p: p[1]) END AS ws
                 FROM d LEFT JOIN gone USING (doc_id))
        SELECT doc_id, n AS n_words, n - len(ws) AS n_removed, sha256(array_to_string(ws, ' ')) AS kept_sha256 FROM kept""",
    "op7_ngram_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i : i + 4], ' '))) AS g
              FROM d WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
        r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
        k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
        t AS (SELECT text, min(doc_id) AS class_id FROM d WHERE len(w) > 0 GROUP BY text)
        SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links, component_id
        FROM d JOIN c ON c.a = doc_id LEFT JOIN k ON k.a = doc_id LEFT JOIN t USING (text)""",
    "op12_merkle_manifest": """
        WITH RECURSIVE h AS (
          SELECT doc_id, lang, concat_ws('', ITEM(doc_id), ITEM(source), ITEM(lang), ITEM(n_chars)) AS head, text,
            4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
              lambda a, b: list_reduce(list_prepend(xor(a, b), range(0, 8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
          FROM documents),
        e AS (SELECT doc_id, lang, sha256(concat(head, ITEM(text))) AS leaf, sha256(concat(head, ITEM(text_now))) AS changed
              FROM (SELECT *, CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS text_now FROM h)),
        r AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS place,
                row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS rank, count(*) OVER (PARTITION BY lang) AS n FROM e),
        t AS (SELECT place, 0 AS lv, rank, leaf AS d, n FROM r UNION ALL
              SELECT place, lv + 1, rank // 8, sha256(string_agg(d, '' ORDER BY rank)), (n + 7) // 8 FROM t WHERE n > 1 GROUP BY place, lv, rank // 8, n),
        s AS (SELECT place, lv AS height, d AS subroot FROM t WHERE n = 1),
        u AS (SELECT 0 AS lv, place AS rank, subroot AS d, (SELECT count(*) FROM s) AS n FROM s UNION ALL
              SELECT lv + 1, rank // 8, sha256(string_agg(d, '' ORDER BY rank)), (n + 7) // 8 FROM u WHERE n > 1 GROUP BY lv, rank // 8, n),
        top AS (SELECT lv AS height, d AS root FROM u WHERE n = 1),
        way AS (SELECT place, rank, lv, rank // (8 ** lv)::BIGINT AS here FROM (SELECT r.place, rank, unnest(range(0, height)) AS lv FROM r JOIN s USING (place))),
        steps AS (
          SELECT w.place, w.rank, w.lv, coalesce(string_agg(t.d, '' ORDER BY t.rank) FILTER (t.rank < here), '') AS l, coalesce(string_agg(t.d, '' ORDER BY t.rank) FILTER (t.rank > here), '') AS r
          FROM way w JOIN t ON t.place = w.place AND t.lv = w.lv AND t.rank // 8 = here // 8 GROUP BY ALL),
        ups AS (SELECT place, unnest(range(0, (SELECT height FROM top))) AS lv FROM s),
        upsteps AS (
          SELECT w.place, w.lv, coalesce(string_agg(u.d, '' ORDER BY u.rank) FILTER (u.rank < place // (8 ** w.lv)::BIGINT), '') AS l,
            coalesce(string_agg(u.d, '' ORDER BY u.rank) FILTER (u.rank > place // (8 ** w.lv)::BIGINT), '') AS r
          FROM ups w JOIN u ON u.lv = w.lv AND u.rank // 8 = place // (8 ** (w.lv + 1))::BIGINT GROUP BY ALL),
        proof AS (SELECT place, rank, lv, l, r FROM steps UNION ALL
                  SELECT r.place, r.rank, s.height + x.lv, x.l, x.r FROM r JOIN s USING (place) JOIN upsteps x ON x.place = r.place),
        folded AS (SELECT place, rank, 0 AS lv, changed AS d FROM r UNION ALL
                   SELECT p.place, p.rank, p.lv + 1, sha256(concat(p.l, f.d, p.r)) FROM folded f JOIN proof p ON p.place = f.place AND p.rank = f.rank AND p.lv = f.lv),
        ends AS (SELECT place, rank, arg_max(d, lv) AS folded_root FROM folded GROUP BY ALL),
        told AS (SELECT place, rank, sha256(string_agg(concat(l, r), '' ORDER BY lv)) AS proof_sha256 FROM proof GROUP BY ALL)
        SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM r JOIN s USING (place) JOIN top ON true JOIN ends USING (place, rank) LEFT JOIN told USING (place, rank)""",
}


def _items(sql: str) -> str:
    """``ITEM(x)`` written out: ``-`` for NULL, else UTF-8 byte count, colon, value."""
    return re.sub(r"ITEM\((\w+)\)", r"coalesce(strlen(\1::VARCHAR) || ':' || \1::VARCHAR, '-')", sql)


ORACLES = {name: _items(sql) for name, sql in ORACLES.items()}
