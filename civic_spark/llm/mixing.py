"""Mixing sources to target weights by subset-sum budget fitting (operator 6).

Per source the documents are counted by exact length. Whole passes over the source are taken while they fit its target;
the rest of the budget is spread over the lengths in proportion to their counts, and what rounding leaves open is filled
by a bounded-knapsack dynamic program over the lengths, so the words taken meet the target exactly where any choice
can. Which documents of a length are taken follows a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rank, words_count, written


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], share: float, most: float) -> dict[str | None, float]:
    """Target of each source: ``share`` of all sizes by weight, at most ``most`` times the source's size.

    Weights repeat over the sources in code-point order, NULL last. What the cap cuts off is shared anew among the others by
    weight until none is above its cap; if all are at their cap, the targets sum to less.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode("utf-32-be", "surrogatepass")))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    cap = {s: most * n for s, n in order}
    budget, open_, found = share * sum(n for _, n in order), [s for s, _ in order], {}
    while open_:
        scale = budget / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * scale > cap[s]]
        if not over:
            return found | {s: weight[s] * scale for s in open_}
        for s in over:
            found[s] = cap[s]
            budget -= cap[s]
        open_ = [s for s in open_ if s not in found]
    return found


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many items of each length to take so that the lengths taken sum to ``budget`` or as near below as found.

    Counts go first in proportion, rounded down. The rest, less than the sum of the lengths, is filled from the longest
    length down until less than two of the longest remain open; a dynamic program over all sums up to there, which may also hand back
    what the filling took last, ends at the largest sum that the remaining counts can reach.
    """
    take = np.zeros(len(lengths), np.int64)
    whole = int((lengths * counts).sum())
    if budget <= 0 or whole == 0:
        return take
    if budget >= whole:
        return counts.copy()
    # in proportion, exact in integers of any size
    take = np.array([int(c) * budget // whole for c in counts], dtype=np.int64)
    gap = budget - int((lengths * take).sum())
    longest = int(lengths.max())
    for i in np.argsort(-lengths, kind="stable"):
        room = gap - 2 * longest
        if room <= 0:
            break
        more = min(int(counts[i] - take[i]), room // int(lengths[i]) if lengths[i] else 0)
        take[i] += more
        gap -= more * int(lengths[i])
    # bounded knapsack: sums[s] is the length by which s was first reached; used[s] how many of it stand in a row there
    reached = np.zeros(gap + 1, bool)
    reached[0] = True
    via = np.full(gap + 1, -1, np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        step, left = int(lengths[i]), int(counts[i] - take[i])
        if step <= 0 or step > gap or left <= 0:
            continue
        k = 1
        while left > 0:  # counts in powers of two: every number up to the count is a sum of some
            part = min(k, left)
            jump = part * step
            if jump > gap:
                break
            fresh = np.zeros(gap + 1, bool)
            fresh[jump:] = reached[:-jump] & ~reached[jump:]
            at = np.flatnonzero(fresh)
            via[at] = i * (1 << 32) + part
            reached[at] = True
            left -= part
            k *= 2
        if reached[gap]:
            break
    s = int(np.flatnonzero(reached).max())
    while s:
        i, part = divmod(int(via[s]), 1 << 32)
        take[i] += part
        s -= part * int(lengths[i])
    return take


NEW = ("size", "source_size", "target", "copies")


def _counted(docs: DataFrame, keep: list[str], weights, share, most, seed) -> DataFrame:
    """``row`` (the columns ``keep``) and ``NEW`` of every row."""
    if docs.where(F.input_file_name() == "").limit(1).count():  # rows that do not come straight from files have no lasting place
        docs = written(docs, "mix-rows")
    spot = F.monotonically_increasing_id().alias("pos")
    light = docs.select("doc_id", F.col("source").cast("string").alias("source"), words_count(F.col("text")).alias("size"), spot)
    light = written(light, "mix-sizes")
    by_length = light.groupBy("source", "size").agg(F.count("*").alias("n"))
    by_source = by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    copies = _copies(light, by_length, by_source, weights, share, most, seed)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), spot)
    return rows.join(copies, "pos").select("row", *NEW)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """Adds ``size, source_size, target, copies`` to documents ``(doc_id, text, source)``: how often the mix takes each row.

    ``size`` counts words (NULL text: 0), ``copies`` is from 0 to ``most``. Documents without words are taken as often as
    the whole passes over their source. A source's words taken stay at or below its target. Equal rows are told apart by
    their position in the table; rows that do not come straight from files are written first, so that positions hold. All
    orders are seeded, and a rerun over the same files takes the same. ``keep`` names the input's columns to return (all, if None); one called like a new column is
    replaced. No rows give no rows.
    """
    kept = [c for c in (keep or docs.columns) if c.lower() not in NEW]
    return _counted(docs, kept, weights, share, most, seed).select(*[F.col("row")[c].alias(c) for c in kept], *NEW)


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the input's columns, whatever their names."""
    counted = _counted(docs, docs.columns, weights, share, most, seed).where("copies > 0")
    repeated = counted.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth"))
    return repeated.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def _copies(light: DataFrame, by_length: DataFrame, by_source: DataFrame, weights, share, most, seed) -> DataFrame:
    """``pos, size, source_size, target, copies`` of every row of ``light``."""
    spark = light.sparkSession
    sizes = [(r["source"], r["source_size"]) for r in by_source.collect()]  # a row per source
    goals = targets(sizes, weights, share, most)
    plan = spark.createDataFrame([(s, n, float(goals[s])) for s, n in sizes], "source string, source_size long, target double")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        whole, goal = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        passes = min(most, int(goal // whole)) if whole else 0
        take = fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), int(goal) - passes * whole if passes < most else 0)
        return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "n": pdf["n"], "source_size": whole, "target": goal, "passes": passes, "extra": take})

    chosen = (
        by_length.join(plan, by_length["source"].eqNullSafe(plan["source"]))
        .select(by_length["source"], "size", "n", "source_size", "target")
        .groupBy("source")
        .applyInPandas(choose, "source string, size long, n long, source_size long, target double, passes int, extra long")
    )
    chosen = written(chosen, "mix-plan")
    # where all or none of a length are taken, no order is needed
    same = [light["source"].eqNullSafe(chosen["source"]), light["size"] == chosen["size"]]
    marked = light.join(chosen, same).select(light["pos"], light["doc_id"], light["source"], light["size"], "n", "source_size", "target", "passes", "extra")
    split = marked.where((F.col("extra") > 0) & (F.col("extra") < F.col("n")))
    rest = marked.where((F.col("extra") == 0) | (F.col("extra") >= F.col("n"))).select("pos", "size", "source_size", "target", (F.col("passes") + (F.col("extra") > 0).cast("int")).alias("copies"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "pos"), 11) / F.lit(float(1 << 53))
    drawn = split.withColumn("draw", draw)
    ranked = bounded_rank(drawn, ["source", "size"], ["draw", "pos"], "rank", F.col("draw"))
    return rest.union(ranked.select("pos", "size", "source_size", "target", (F.col("passes") + (F.col("rank") <= F.col("extra")).cast("int")).alias("copies")))
