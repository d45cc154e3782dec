"""Exact near-duplicate vectors by a cover tree and its dual traversal (operator 3).

Vectors are scaled to length 1, where cosine >= t is a distance of at most sqrt(2 - 2 t). The tree's top is a bounded
set of centres to which every vector goes by distance; a node that holds many vectors is cut into units of bounded size.
Below, each unit has nested levels whose radii halve: every level's centres are centres of the next, and each vector
hangs under a centre within the level's radius. Pairs of nodes are followed downwards together, and left as soon as their
centres are further apart than both covering radii and the threshold distance: no pair below can be near enough. What is left
is decided by the cosine in double precision on the original vectors.

A unit is stored once, a few units to a file. Pairs of files are dealt over tasks, which open them where they stand: however
many units meet, no vector is copied for it, on disk or in an exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, smallest_labels, written
from .files import read_from
from .vectors import usable

#: Room for rounding in bounds; decisions are made without it.
SLACK = 1e-5
#: Bytes of vectors in a file of units, at most (one unit at least), and units in it.
BLOCK_BYTES, BLOCK_UNITS = 1 << 24, 16
#: Files that a task meets with one other file.
MEETINGS = 4


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)
    y = x / big
    return y / np.sqrt((y * y).sum(1, keepdims=True))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of vectors of length 1."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def nested_levels(x: np.ndarray, levels: int) -> np.ndarray:
    """For each level the centre (a row number) that each row hangs under; radii are 1, 1/2, 1/4 ..."""
    n = len(x)
    d = _distances(x.astype(np.float32), x.astype(np.float32))
    out, centres = np.empty((levels, n), np.int64), []
    above = np.zeros(n, np.int64)
    for level in range(levels):
        near, under = np.full(n, np.inf, np.float32), np.full(n, -1)

        def hang(c: int) -> None:
            closer = (d[c] < near) & (above == above[c])  # below the same node, so that the levels form a tree
            near[closer], under[closer] = d[c][closer], c
            near[c], under[c] = -1, c

        for c in centres:
            hang(c)
        loose = near > 0.5**level
        while loose.any():
            c = int(loose.argmax())
            centres.append(c)
            hang(c)
            loose &= near > 0.5**level
        out[level] = above = under
    return out


class Level(NamedTuple):
    """A level of a unit's tree: its centres, the centre (by place) that each row hangs under, and the covering radii."""

    centres: np.ndarray
    under: np.ndarray
    radii: np.ndarray
    vectors: np.ndarray
    heads: np.ndarray


def levels_of(x: np.ndarray, ups: np.ndarray) -> list[Level]:
    """``ups``: the centre of each row of ``x`` on each level, coarse to fine."""
    out = []
    for up in ups:
        centres, under = np.unique(up, return_inverse=True)
        radii = np.zeros(len(centres))
        np.maximum.at(radii, under, np.sqrt(((x - x[up]) ** 2).sum(1)))
        at = x[centres]
        cut = -(-x.shape[1] // 3)
        rest = np.sqrt((at[:, cut:] ** 2).sum(1, keepdims=True))
        out.append(Level(centres, under, radii, at.astype(np.float32), np.hstack([at[:, :cut], rest]).astype(np.float32)))
    return out


def _close(a: Level, b: Level, rows: np.ndarray, columns: np.ndarray, reach: float, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Centre pairs of ``rows`` x ``columns`` whose distance is within both radii and ``reach``, with room for rounding.

    Distance <= bound as 2 - 2 cos <= bound squared. The first third of the axes and the length of the rest bound a cosine
    from above (Cauchy-Schwarz), which rules most pairs out for a third of the work; where it does not, all axes are used.
    """
    full, heads = (b.vectors, b.heads) if len(columns) == len(b.centres) else (b.vectors[columns], b.heads[columns])
    wide = reach + SLACK + b.radii[columns].max()
    left, right = [], []
    for s in range(0, len(rows), step):
        some = rows[s : s + step]
        least = (1 - (a.radii[some] + wide) ** 2 / 2 - SLACK).astype(np.float32)[:, None]
        hit = a.heads[some] @ heads.T >= least
        if np.count_nonzero(hit) * 50 > hit.size:
            hit = a.vectors[some] @ full.T >= least
        at = np.flatnonzero(hit)
        for t in range(0, len(at), 1 << 16):
            i, j = np.divmod(at[t : t + (1 << 16)], len(columns))
            i, j = some[i], columns[j]
            ok = np.einsum("ij,ij->i", a.vectors[i], b.vectors[j]) >= 1 - (a.radii[i] + b.radii[j] + reach + SLACK) ** 2 / 2 - SLACK
            left.append(i[ok])
            right.append(j[ok])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _below(level: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of their centres, with the first place and the number of rows of each centre."""
    counts = np.bincount(level.under, minlength=len(level.centres))
    return np.argsort(level.under, kind="stable"), np.cumsum(counts) - counts, counts


def descend(a: list[Level], b: list[Level], reach: float, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs that the dual traversal of two trees cannot rule out, at most ``step`` at once."""
    alive, above, below = None, None, None
    for level, (la, lb) in enumerate(zip(a, b)):
        last = level == len(a) - 1
        if not last and len(la.centres) + len(lb.centres) > 0.6 * (len(a[level + 1].centres) + len(b[level + 1].centres)):
            continue  # the next level is hardly finer: its own test is as cheap and rules out more
        rows, columns = np.arange(len(la.centres)), np.arange(len(lb.centres))
        if alive is not None:  # under a pair that is left
            pa_, pb_ = above.under[la.centres], below.under[lb.centres]
            rows, columns = np.flatnonzero(alive.any(1)[pa_]), np.flatnonzero(alive.any(0)[pb_])
        i, j = _close(la, lb, rows, columns, reach)
        if alive is not None:
            kept = alive[pa_[i], pb_[j]]
            i, j = i[kept], j[kept]
        if not len(i):
            return
        if not last:
            alive, above, below = np.zeros((len(la.centres), len(lb.centres)), bool), la, lb
            alive[i, j] = True
    (order_a, start_a, n_a), (order_b, start_b, n_b) = _below(la), _below(lb)
    per = n_a[i] * n_b[j]
    ends = np.cumsum(per)
    for t in range(0, int(ends[-1]), step):
        nth = np.arange(t, min(t + step, int(ends[-1])))
        pair = np.searchsorted(ends, nth, side="right")
        p, q = np.divmod(nth - (ends - per)[pair], n_b[j][pair])
        yield order_a[start_a[i][pair] + p], order_b[start_b[j][pair] + q]


def near_pairs(a: np.ndarray, b: np.ndarray, up_a: np.ndarray, up_b: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that the dual traversal cannot rule out. ``up``: the centre of each row on each level, coarse to fine."""
    none = np.empty(0, np.int64)
    found = list(descend(levels_of(a, up_a), levels_of(b, up_b), reach))
    return np.concatenate([none, *[i for i, _ in found]]), np.concatenate([none, *[j for _, j in found]])


def linked(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, least: float, step: int = 1 << 16) -> np.ndarray:
    """Whether the cosine of rows ``a[i], b[j]`` is at least ``least``, in double precision."""
    out = np.empty(len(i), bool)
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    for s in range(0, len(i), step):
        p, q = i[s : s + step], j[s : s + step]
        out[s : s + step] = np.einsum("ij,ij->i", a[p], b[q]) / (na[p] * nb[q]) >= least
    return out


def star_edges(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each of ``n`` rows over the links ``i, j``."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label


def near_duplicates(
    table: DataFrame, least: float = 0.95, id_column: str = "vec_id", vector: str = "embedding", unit_rows: int = 2048, most_centres: int = 4096, levels: int = 3, seed: int = 11
) -> DataFrame:
    """One row per row of ``table``: ``id, n_links, component_id``. Two rows are linked if their cosine is at least ``least``.

    ``n_links`` counts other rows linked directly, copies included; ``component_id`` is the smallest id reachable by links.
    Rows with a NULL, zero or unusable vector link with nothing and are their own component, as are vectors of a length that no other has. Ids
    are taken as unique: rows of equal id and equal vector count as copies. NULL ids stay NULL. ``least`` lies above 0.

    Vectors are known by a digest of 128 bits outside their units, so that each is exchanged twice and stored once. Sent to every task
    are ``most_centres`` vectors at most, and the places of the files of units; a task holds two files.
    """
    if not 0 < least <= 1:
        raise ValueError("least lies above 0 and is 1 at most")
    rows = usable(table, id_column, vector)
    narrow = table.select(F.col(f"`{vector}`")).dtypes[0][1] == "array<float>"  # four bytes hold each component as given
    reach = float(np.sqrt(2 - 2 * least))
    keys = written(rows.mapInArrow(_digests, f"id long, {KEY}"), "keys")
    tops = _tops(rows, keys, unit_rows, most_centres, seed)
    classes, cover = _classes(rows, tops, unit_rows, seed)
    blocks = _blocks(rows, classes, narrow, unit_rows, levels, max((d for d, _ in cover), default=1))
    found = written(_meet(blocks, narrow, levels, tops, cover, least, reach, rows.sparkSession), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = smallest_labels(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    answers = classes.select("dim", "k1", "k2", "rep", "copies").join(links, "rep", "left").join(roots, "rep", "left")
    known = keys.join(answers, ["dim", "k1", "k2"]).select(
        "id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    every = table.select(F.col(f"`{id_column}`").cast("long").alias("id"))
    return every.join(known.distinct(), "id", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


#: What tells vectors apart: their length and a digest of their components.
KEY = "dim int, k1 long, k2 long"


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """For each length of vector in a batch of ``id, vec, dim``: the length, the vectors, their digests, and the ids."""
    lists, ids = batch.column("vec"), batch.column("id")
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values, starts = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        x = np.ascontiguousarray(values[starts[at][:, None] + np.arange(dim)]) + 0.0  # minus zero equals zero
        digests = b"".join(hashlib.blake2b(v, digest_size=16).digest() for v in x)
        yield dim, x, np.frombuffer(digests, np.int64).reshape(-1, 2), ids.take(pa.array(at))


def _keyed(dim: int, key: np.ndarray, **more) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({**more, "dim": pa.array(np.full(len(key), dim, np.int32)), "k1": pa.array(key[:, 0]), "k2": pa.array(key[:, 1])})


def _digests(batches):
    for batch in batches:
        for dim, _, key, ids in _parts(batch):
            yield _keyed(dim, key, id=ids)


def _tops(rows: DataFrame, keys: DataFrame, unit_rows: int, most_centres: int, seed: int) -> dict[int, np.ndarray]:
    """A bounded sample of different vectors of each length, as the tree's top."""
    different = keys.groupBy("dim", "k1", "k2").agg(F.min("id").alias("rep"))
    counts = {r["dim"]: r["n"] for r in different.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row per length
    tops = {}
    for dim, n in counts.items():
        want = max(1, min(most_centres, -(-n // unit_rows)))
        drawn = different.where(F.col("dim") == dim).orderBy(F.xxhash64(F.lit(seed), "k1", "k2"), "k1", "k2").limit(want)
        vectors = rows.where((F.col("dim") == dim) & F.col("id").isin([r["rep"] for r in drawn.select("rep").collect()]))
        tops[dim] = _unit(np.array(sorted({tuple(r["vec"]) for r in vectors.select("vec").collect()})[:most_centres], dtype=np.float64))
    return tops


def _classes(rows: DataFrame, tops: dict, unit_rows: int, seed: int) -> tuple[DataFrame, dict]:
    """Each different vector with its smallest id, its copies, its node and chunk; the covering radius of each node."""

    def route(batches):
        for batch in batches:
            for dim, x, key, ids in _parts(batch):
                d = _distances(_unit(x), tops[dim])
                yield _keyed(dim, key, id=ids, node=pa.array(d.argmin(1)), away=pa.array(d.min(1)))

    routed = rows.mapInArrow(route, f"id long, node long, away double, {KEY}")
    # copies may be as near to two nodes: all go where the smallest id goes
    first = F.min(F.struct("id", "node", "away")).alias("first")
    classes = routed.groupBy("dim", "k1", "k2").agg(first, F.count("*").alias("copies"))
    classes = written(classes.select("dim", "k1", "k2", F.col("first.id").alias("rep"), "copies", F.col("first.node").alias("node"), F.col("first.away").alias("away")), "classes")
    sizes = written(classes.groupBy("dim", "node").agg(F.count("*").alias("n"), F.max("away").alias("radius")), "nodes")
    chunk = F.pmod(F.xxhash64(F.lit(seed + 1), "rep"), F.ceil(F.col("n") / F.lit(unit_rows)))
    cover = {(r["dim"], r["node"]): r["radius"] for r in sizes.collect()}  # a row per centre
    return classes.join(sizes, ["dim", "node"]).withColumn("chunk", chunk).select("dim", "k1", "k2", "rep", "copies", "node", "chunk"), cover


def _blocks(rows: DataFrame, classes: DataFrame, narrow: bool, unit_rows: int, levels: int, widest: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Files of a few units each, a unit a row, and which ``(dim, node, chunk)`` stand in each."""
    kind = np.float32 if narrow else np.float64

    def pack(batches):
        for batch in batches:
            for dim, x, key, ids in _parts(batch):
                yield _keyed(dim, key, id=ids, vec=pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()))

    packed = rows.mapInArrow(pack, f"id long, vec binary, {KEY}").withColumnRenamed("id", "rep")
    one = packed.join(classes, ["dim", "k1", "k2", "rep"]).dropDuplicates(["dim", "k1", "k2", "rep"])  # a row of each class

    def hang(unit: pa.Table) -> pa.Table:
        unit = unit.sort_by([("rep", "ascending"), ("k1", "ascending"), ("k2", "ascending")])
        x = np.frombuffer(b"".join(unit["vec"].to_pylist()), kind).reshape(unit.num_rows, -1)
        ups = nested_levels(_unit(x.astype(np.float64)), levels)
        blobs = {"vec": x, "reps": unit["rep"].to_numpy(), "copies": unit["copies"].to_numpy(), "ups": ups}
        place = {c: unit[c][:1] for c in ("dim", "node", "chunk")}
        return pa.table({**place, **{c: pa.array([v.tobytes()], pa.binary()) for c, v in blobs.items()}})

    shape = "dim int, node long, chunk long, vec binary, reps binary, copies binary, ups binary"
    units = one.groupBy("dim", "node", "chunk").applyInArrow(hang, shape)
    path, spark = shared_folder(rows.sparkSession, "units"), rows.sparkSession
    most = max(1, min(BLOCK_UNITS, BLOCK_BYTES // (unit_rows * widest * 8)))
    units.write.option("compression", "zstd").option("maxRecordsPerFile", most).parquet(path)
    listed = spark.read.schema(shape).parquet(path).groupBy(F.input_file_name().alias("file"))
    return sorted((r["file"], [tuple(u) for u in r["units"]]) for r in listed.agg(F.sort_array(F.collect_list(F.struct("dim", "node", "chunk"))).alias("units")).collect())


class Unit(NamedTuple):
    vectors: np.ndarray
    reps: np.ndarray
    copies: np.ndarray
    tree: list[Level]


def _read(path: str, narrow: bool, levels: int) -> dict[tuple[int, int, int], Unit]:
    out = {}
    with read_from(path) as file:
        rows = pq.read_table(file).to_pylist()
    for r in rows:
        x = np.frombuffer(r["vec"], np.float32 if narrow else np.float64).reshape(-1, r["dim"]).astype(np.float64)
        ups = np.frombuffer(r["ups"], np.int64).reshape(levels, -1)
        out[r["dim"], r["node"], r["chunk"]] = Unit(x, np.frombuffer(r["reps"], np.int64), np.frombuffer(r["copies"], np.int64), levels_of(_unit(x), ups))
    return out


def _within(rows: int, reps: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``rows`` rows the one with the smallest id that it reaches over the links ``i, j``."""
    order = np.argsort(reps, kind="stable")
    turn = np.empty(rows, np.int64)
    turn[order] = np.arange(rows)
    return order[star_edges(rows, turn[i], turn[j])[turn]]


def _meet(blocks: list, narrow: bool, levels: int, tops: dict, cover: dict, least: float, reach: float, spark) -> DataFrame:
    """``rep, links, root``: what each pair of files adds to a vector's links, and the smallest vector it reaches there."""

    def near(dim: int, nodes: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Whether anything below two nodes can be near enough."""
        radii = np.array([cover[dim, n] for n in nodes])[:, None] + np.array([cover[dim, n] for n in others])
        return _distances(tops[dim][nodes], tops[dim][others]) <= radii + reach + SLACK

    def partners(batches):
        stands = {}  # files and nodes of each length
        for f, (_, units) in enumerate(blocks):
            for dim, node, _ in units:
                stands.setdefault(dim, set()).add((f, node))
        stands = {dim: np.array(sorted(s), np.int64) for dim, s in stands.items()}
        for pdf in batches:
            for f in pdf["f"].tolist():
                met = set()
                for dim in {u[0] for u in blocks[f][1]}:
                    others = stands[dim][stands[dim][:, 0] >= f]
                    own = np.unique(others[others[:, 0] == f, 1])
                    known, at = np.unique(others[:, 1], return_inverse=True)
                    met |= set(others[near(dim, own, known).any(0)[at], 0].tolist())
                met = sorted(met)
                yield pd.DataFrame([(f, met[s : s + MEETINGS]) for s in range(0, len(met), MEETINGS)], columns=["f", "gs"])

    def meet(batches):
        held, at = None, None
        for pdf in batches:
            for f, gs in zip(pdf["f"].tolist(), pdf["gs"]):
                if at != f:
                    held, at = _read(blocks[f][0], narrow, levels), f
                for g in gs:
                    yield _meeting(held, held if g == f else _read(blocks[g][0], narrow, levels), near, least, reach)

    files = spark.createDataFrame([(f,) for f in range(len(blocks))], "f long").repartition(max(1, min(len(blocks), 200)), "f")
    tasks = max(1, min(10_000, len(blocks) * (len(blocks) + 1) // (2 * MEETINGS)))
    dealt = written(files.mapInPandas(partners, "f long, gs array<long>"), "meetings").repartition(tasks)
    return dealt.mapInPandas(meet, "rep long, links long, root long")


def _meeting(a: dict, b: dict, near, least: float, reach: float) -> pd.DataFrame:
    """The pairs of units of two files; each pair of units meets once."""
    same = a is b
    units = list(a.items()) if same else [*a.items(), *b.items()]
    reps, copies = (np.concatenate([getattr(u, c) for _, u in units]) for c in ("reps", "copies"))
    start = dict(zip([(k, n >= len(a)) for n, (k, _) in enumerate(units)], np.cumsum([0, *[len(u.reps) for _, u in units]]).tolist()))
    links, down, up = np.zeros(len(reps), np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for (u, x) in a.items():
        for (v, y) in b.items():
            if u[0] != v[0] or (same and u > v) or not near(u[0], np.array([u[1]]), np.array([v[1]]))[0, 0]:
                continue
            for i, j in descend(x.tree, y.tree, reach):
                if u == v:
                    i, j = i[i < j], j[i < j]
                ok = linked(x.vectors, y.vectors, i, j, least)
                i, j = i[ok] + start[u, False], j[ok] + start[v, not same]
                if not len(i):
                    continue
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                spot = np.zeros(len(reps), np.int64)
                spot[i] = spot[j] = 1
                ends = np.flatnonzero(spot)
                spot[ends] = np.arange(len(ends))
                down.append(ends)  # a link a row is enough to go on with
                up.append(ends[_within(len(ends), reps[ends], spot[i], spot[j])])
    at = np.flatnonzero(links)
    root = _within(len(reps), reps, np.concatenate(down), np.concatenate(up)) if len(at) else np.empty(0, np.int64)
    return pd.DataFrame({"rep": reps[at], "links": links[at], "root": reps[root[at]] if len(at) else root})
