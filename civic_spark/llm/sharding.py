"""Sharding by histogram sort (operator 8).

Documents are ordered by a 64-bit hash of their text, then by doc_id. Splitters between shards are found by counting the
exact bytes below candidate keys over all partitions, round after round with narrower candidates, until each splitter
is within tolerance of its share or cannot move; then the rows are exchanged once.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _below(rows: DataFrame, key: str, probes: list[int]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) with a key below each of the ascending probes; one partial sum per task and gap between probes."""
    edges = np.array(probes, dtype=np.int64)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, len(edges) + 1), np.int64)
        for pdf in batches:
            gap = np.searchsorted(edges, pdf[key].to_numpy(), side="right")
            np.add.at(total[0], gap, pdf["size"].to_numpy())
            total[1] += np.bincount(gap, minlength=len(edges) + 1)
        at = np.flatnonzero(total[1])
        yield pd.DataFrame({"at": at, "bytes": total[0][at], "n": total[1][at]})

    sums = rows.select(key, "size").mapInPandas(count, "at long, bytes long, n long").groupBy("at").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    gaps = np.zeros((2, len(edges) + 1), dtype=object)
    for r in sums.collect():  # a row per gap at most
        gaps[0][r["at"]], gaps[1][r["at"]] = r["bytes"], r["n"]
    return list(zip(np.cumsum(gaps[0]).tolist(), np.cumsum(gaps[1]).tolist()))[:-1]


def splitters(rows: DataFrame, key: str, targets: list[int], tolerances: list[int], candidates: int = 32_768) -> list[tuple[int, int, int, int, int]]:
    """For each target the nearest keys ``(low, high)`` found, with the bytes below them, and the rows between.

    One histogram job a round over about ``candidates`` keys, shared by the open intervals (32 to 4096 each); the driver sees
    a sum per candidate. An interval closes when an end is within its tolerance of its target, or when at most one
    row or one key lies in it.
    """
    first, last, whole, n = rows.agg(F.min(key), F.max(key), F.sum("size"), F.count("*")).first()
    if not n:
        return [(LOW, LOW, 0, 0, 0) for _ in targets]
    spans = [(first, last + 1 if last < HIGH else HIGH, 0, whole, 0, n) for _ in targets]
    while True:
        open_ = [
            i
            for i, (a, b, x, y, m, k) in enumerate(spans)
            if b - a > 1 and k - m > 1 and min(targets[i] - x, y - targets[i]) > tolerances[i]
        ]
        if not open_:
            return [(a, b, x, y, k - m) for a, b, x, y, m, k in spans]
        different = {spans[i][:2] for i in open_}
        probes = min(4096, max(32, candidates // len(different)))
        wanted = {a + (b - a) * k // (probes + 1) for a, b in different for k in range(1, probes + 1)}
        keys = sorted(k for k in wanted | {a + 1 for a, b in different if b - a < probes})
        counted = _below(rows, key, keys)
        for i in open_:
            a, b, x, y, m, k = spans[i]
            j = bisect_right(keys, a)
            end = bisect_left(keys, b)
            # the first probe with more below it than the target closes the interval, the one before it opens it
            low, high = j, end
            while low < high:
                mid = (low + high) // 2
                low, high = (low, mid) if counted[mid][0] > targets[i] else (mid + 1, high)
            if low < end:
                b, y, k = keys[low], *counted[low]
            if low > j:
                a, x, m = keys[low - 1], *counted[low - 1]
            spans[i] = (a, b, x, y, m, k)


def _unit_of(cuts: list[tuple[int, int]]):
    """Number of ascending cuts ``(key, tie)`` at or below each row's, for whole columns."""
    cut_keys, cut_ties = (np.array(c, dtype=np.int64) for c in zip(*cuts)) if cuts else (np.zeros(0, np.int64),) * 2
    shared = np.unique(cut_keys)

    def number(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for key, tie in pairs:
            k, t = key.to_numpy(), tie.to_numpy()
            unit = np.searchsorted(cut_keys, k, side="left")
            for same in np.intersect1d(shared, k):  # rows at a cut go by their tie
                at = np.flatnonzero(k == same)
                first, last = np.searchsorted(cut_keys, same, side="left"), np.searchsorted(cut_keys, same, side="right")
                unit[at] = first + np.searchsorted(cut_ties[first:last], t[at], side="right")
            yield pd.Series(unit.astype(np.int32))

    return F.pandas_udf(number, "int")


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16, tolerance: float = 0.002, keep_together: float = 0.01, run_rows: int = 200_000) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of documents ``(doc_id, text)``: shards of nearly equal bytes in the order
    of (text hash, doc_id).

    Size is the UTF-8 bytes of the text (NULL: none) plus ``overhead``. A cut lies within ``tolerance`` of a shard of its
    place, or at the row nearest to it. Copies of one text stand next to each other and share a shard, unless keeping them
    whole would move a cut by more than ``keep_together`` of a shard; then they are cut between doc_ids. Slots count from 0
    within a shard, in order. NULL doc_ids come first; rows that agree in text and doc_id stay together. Fewer rows than shards leave
    shards empty, and no rows give no rows.

    Every shard is cut by the same histogram into runs of about ``run_rows`` rows, less exactly, so that no task orders more
    than a run, however many rows there are or one text has.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.xxhash64(body).alias("key"),
        ).withColumn("tie", F.coalesce("doc_id", F.lit(LOW))),
        "shard-keys",
    )
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    runs = max(4, -(-n // (shards * run_rows)))
    mean, units = total / shards, shards * runs
    targets = [total * i // units for i in range(1, units)]
    # cuts between runs of one shard may lie a quarter of a run off
    near = [int(mean * tolerance) if i % runs == 0 else int(mean / runs / 4) for i in range(1, units)]
    far = [mean * max(keep_together, tolerance) if i % runs == 0 else mean / runs / 4 for i in range(1, units)]
    cuts: list[tuple[int, int]] = []
    inside: dict[tuple[int, int, int], list[int]] = {}
    for i, (a, b, x, y, many) in enumerate(splitters(rows, "key", targets, near)):
        t = targets[i]
        key, off = (a, t - x) if t - x <= y - t else (b, y - t)
        cuts.append((key, LOW))
        if many > 1 and off > far[i]:  # within the copies of one text: the one key of the interval
            inside.setdefault((a, b, x), []).append(i)
    for (a, b, x), open_ in inside.items():
        group = rows.where((F.col("key") >= a) & (F.col("key") < b))
        key = group.agg(F.min("key")).first()[0]
        within = [0 if (i + 1) % runs == 0 else near[i] for i in open_]
        for i, (low, high, u, v, _) in zip(open_, splitters(group, "tie", [targets[i] - x for i in open_], within)):
            t = targets[i] - x
            cuts[i] = (key, low if t - u <= v - t else high)
    cuts.sort()
    placed = rows.withColumn("unit", _unit_of(cuts)("key", "tie"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1))
    counts = placed.groupBy("unit").agg(F.count("*").alias("n")).withColumn("shard", F.expr(f"unit div {runs}").cast("int"))
    starts = counts.select("unit", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("unit").orderBy("key", "tie", "size"))
    return (
        placed.withColumn("rank", rank)
        .join(starts, "unit")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"))
    )
