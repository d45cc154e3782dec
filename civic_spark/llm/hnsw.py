"""Approximate nearest neighbours by a hierarchical navigable small-world graph per shard (operator 2).

Different vectors are dealt by hash into shards of bounded size. Each shard becomes one row: its vectors and, for every
level, flat neighbour arrays. As a shard fits in memory, the candidates for a node's links come from exact distances in
blocks, not from searches in an unfinished graph; links are then chosen by the usual diversity rule, mirrored, and cut to
the degree limit. A query descends greedily through the upper levels and runs a beam search on level 0 of every shard; the
nearest of all shards are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .vectors import distinct_vectors, matrix, usable

GRAPH = "dim int, shard long, n long, vectors binary, ids array<array<long>>, nodes array<binary>, links array<binary>"


def _choose(x: np.ndarray, dist: np.ndarray, ids: np.ndarray, degree: int) -> np.ndarray:
    """Diverse neighbours: ``dist, ids`` (rows x candidates, ascending; -1 pads). A candidate is kept unless one kept before is
    nearer to it than the node is; free places go to the nearest of those passed over."""
    rows, width = ids.shape
    near = x[np.maximum(ids, 0)]
    square = (near * near).sum(2)
    between = square[:, :, None] + square[:, None, :] - 2 * near @ near.transpose(0, 2, 1)
    kept, count = np.zeros((rows, width), bool), np.zeros(rows, np.int64)
    for j in range(width):
        clash = (kept[:, :j] & (between[:, :j, j] < dist[:, j, None])).any(1)
        kept[:, j] = ~clash & (ids[:, j] >= 0) & (count < degree)
        count += kept[:, j]
    order = np.argsort(np.where(ids < 0, 2, ~kept), axis=1, kind="stable")[:, :degree]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, max(0, degree - out.shape[1]))), constant_values=-1).astype(np.int32)


def _level(x: np.ndarray, degree: int, candidates: int, block: int = 512) -> np.ndarray:
    """Links among the rows of ``x``: an array of n x degree positions, padded with -1."""
    n = len(x)
    if n < 2:
        return np.full((n, degree), -1, np.int32)
    width, square = min(candidates, n - 1), (x * x).sum(1)
    out, far = np.empty((n, degree), np.int32), np.empty((n, degree), np.float32)
    for a in range(0, n, block):
        b = min(n, a + block)
        d = np.maximum(square[a:b, None] + square[None] - 2 * x[a:b] @ x.T, 0)
        d[np.arange(b - a), np.arange(a, b)] = np.inf
        ids = np.argpartition(d, width - 1, axis=1)[:, :width]
        ids = np.take_along_axis(ids, np.argsort(np.take_along_axis(d, ids, 1), axis=1, kind="stable"), 1)
        out[a:b] = -1
        out[a:b, : degree // 2] = _choose(x, np.take_along_axis(d, ids, 1), ids, degree // 2)
        far[a:b] = np.where(out[a:b] >= 0, np.take_along_axis(d, np.maximum(out[a:b], 0), 1), np.inf)
    # mirror the links, then cut each node's list by the same rule
    src, col = np.nonzero(out >= 0)
    dst, dist = out[src, col], far[src, col]
    pairs = np.unique(np.concatenate([src * n + dst, dst * n + src]))
    a, b = pairs // n, pairs % n
    dist = np.maximum(square[a] + square[b] - 2 * np.einsum("ij,ij->i", x[a], x[b]), 0)
    order = np.lexsort((dist, a))
    a, b, dist = a[order], b[order], dist[order]
    place = np.arange(len(a)) - np.searchsorted(a, a, side="left")
    width = min(int(place.max()) + 1, 2 * degree)
    fits = place < width
    ids, near = np.full((n, width), -1, np.int64), np.full((n, width), np.inf, np.float32)
    ids[a[fits], place[fits]], near[a[fits], place[fits]] = b[fits], dist[fits]
    for s in range(0, n, block):
        out[s : s + block] = _choose(x, near[s : s + block], ids[s : s + block], degree)
    return out


def build(x: np.ndarray, degree: int, candidates: int, seed: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Levels from 0 up: which rows stand on each, and their neighbours as row numbers. Level 0 has twice the degree."""
    x = x.astype(np.float32)
    height = np.floor(-np.log(np.maximum(np.random.default_rng(seed).random(len(x)), 1e-12)) / np.log(degree)).astype(int)
    nodes, links = [], []
    for level in range(int(height.max(initial=0)) + 1):
        at = np.flatnonzero(height >= level).astype(np.int32)
        own = _level(x[at], 2 * degree if level == 0 else degree, candidates)
        nodes.append(at)
        links.append(np.where(own >= 0, at[np.maximum(own, 0)], -1).astype(np.int32))
    return nodes, links


def search(x: np.ndarray, nodes: list[np.ndarray], links: list[np.ndarray], queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and row numbers of up to ``beam`` rows found for each query, unordered; -1 pads."""
    x, q = x.astype(np.float32), queries.astype(np.float32)
    square, n, rows = (x * x).sum(1), len(x), np.arange(len(q))
    away = lambda ids: square[ids] - 2 * (x[ids] @ q[:, :, None])[:, :, 0]  # noqa: E731  less the query's own square
    at = np.full(len(q), nodes[-1][0], np.int64)
    best = away(at[:, None])[:, 0]
    for level in range(len(nodes) - 1, 0, -1):
        where = np.full(n, -1, np.int64)
        where[nodes[level]] = np.arange(len(nodes[level]))
        while True:
            ids = links[level][where[at]]
            d = np.where(ids >= 0, away(np.maximum(ids, 0)), np.inf)
            i = d.argmin(1)
            better = d[rows, i] < best
            if not better.any():
                break
            at, best = np.where(better, ids[rows, i], at), np.where(better, d[rows, i], best)
    found, dist = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), np.inf, np.float32)
    found[:, 0], dist[:, 0] = at, best
    open_, seen = np.zeros((len(q), beam), bool), np.zeros((len(q), n), bool)
    open_[:, 0], seen[rows, at] = True, True
    while open_.any():
        live = np.flatnonzero(open_.any(1))
        i = np.where(open_[live], dist[live], np.inf).argmin(1)
        open_[live, i] = False
        ids = links[0][found[live, i]].astype(np.int64)
        fresh = (ids >= 0) & ~seen[live[:, None], np.maximum(ids, 0)]
        seen[np.broadcast_to(live[:, None], ids.shape)[fresh], ids[fresh]] = True
        safe = np.maximum(ids, 0)
        d = np.where(fresh, square[safe] - 2 * (x[safe] @ q[live][:, :, None])[:, :, 0], np.inf)
        all_d, all_i = np.concatenate([dist[live], d], 1), np.concatenate([found[live], np.where(fresh, ids, -1)], 1)
        all_o = np.concatenate([open_[live], fresh], 1)
        keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        dist[live], found[live], open_[live] = (np.take_along_axis(v, keep, 1) for v in (all_d, all_i, all_o))
    return dist, found


def build_index(rows: DataFrame, ids_kept: int, shard_rows: int = 4096, degree: int = 16, candidates: int = 48, seed: int = 5) -> DataFrame:
    """One row per shard (``GRAPH``) over all usable vectors ``id, vec, dim``; vectors of different length never share a shard."""
    table = written(distinct_vectors(rows, ids_kept), "vectors")
    sizes = {r["dim"]: -(-r["n"] // shard_rows) for r in table.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row per length
    shards = F.coalesce(*[F.when(F.col("dim") == d, F.lit(s)) for d, s in sizes.items()], F.lit(1))
    dealt = table.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "rep"), shards))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        x = matrix(pdf["vec"])
        nodes, links = build(x, degree, candidates, seed)
        row = (int(pdf["dim"].iloc[0]), int(pdf["shard"].iloc[0]), len(x), x.tobytes(), [list(map(int, v)) for v in pdf["ids"]], [v.tobytes() for v in nodes], [v.tobytes() for v in links])
        return pd.DataFrame([row], columns=["dim", "shard", "n", "vectors", "ids", "nodes", "links"])

    return written(dealt.select("dim", "shard", "vec", "rep", "ids").groupBy("dim", "shard").applyInPandas(make, GRAPH), "graphs")


def nearest(table: DataFrame, is_query, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", beam: int = 96, block_rows: int = 4096, **index) -> DataFrame:
    """The ``k`` nearest rows found for every query row: ``query_id, rank, id, score``.

    ``is_query`` is a condition over ``id``; every usable row but the query's own is a candidate, nearness is Euclidean
    distance in double precision on the original vectors, and ties go to the smaller id. Copies of a vector are found
    together: the index keeps their ``k + 1`` smallest ids, which is all that a result can hold. A query whose vector is
    unusable gets no rows; fewer candidates than ``k`` are all returned, of the query's own length. An id on
    several rows never answers itself. An empty table gives no rows.

    Queries go through the shards in blocks of ``block_rows``, so a task holds one graph and one block, whatever the sizes.
    """
    rows = usable(table, id_column, vector)
    graphs = build_index(rows, k + 1, **index)
    asked = written(rows.where(is_query).select("dim", "id", "vec"), "queries")
    blocks = {r["dim"]: -(-r["n"] // block_rows) for r in asked.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row per length
    of_dim = F.coalesce(*[F.when(F.col("dim") == d, F.lit(s)) for d, s in blocks.items()], F.lit(0)).cast("long")
    left = graphs.withColumn("blocks", of_dim).where("blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    shards = graphs.select("dim", "shard")
    right = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(3), "id"), of_dim)).join(shards, "dim")

    def look(pdf: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "id", "score"]
        if pdf.empty or ask.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        g = pdf.iloc[0]
        x = np.frombuffer(g["vectors"]).reshape(int(g["n"]), -1)
        nodes = [np.frombuffer(v, np.int32) for v in g["nodes"]]
        links = [np.frombuffer(v, np.int32).reshape(len(a), -1) for v, a in zip(g["links"], nodes)]
        out, step = [], max(1, min(1024, (1 << 25) // len(x)))
        for s in range(0, len(ask), step):
            part = ask.iloc[s : s + step]
            q = matrix(part["vec"])
            found = search(x, nodes, links, q, max(beam, k + 1))[1]
            for query, v, ids in zip(part["id"], q, found):
                ids = ids[ids >= 0]
                exact = np.sqrt(((x[ids] - v) ** 2).sum(1))
                order = np.argsort(exact, kind="stable")
                if len(order) > k + 1:  # ties with the last stay in
                    order = order[exact[order] <= exact[order[k]]]
                for i in order:
                    out += [(query, m, exact[i]) for m in g["ids"][ids[i]] if m != query]
        return pd.DataFrame(out, columns=columns)

    key = ["dim", "shard", "block"]
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own: both sides come from the graphs
    hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(look, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return hits.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
