"""Exact quantiles per group that never bring a whole group into one task.

``percentile`` keeps every distinct value of a group in one buffer. Here the values are counted once, and large groups are
narrowed in rounds: an approximate sketch, which is mergeable and of fixed size, only proposes cuts; exact counts
between them tell which slices hold a wanted rank, and only those go on, until they are small enough to be ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import shared_folder

#: Most different values that one task ranks, and slices that a larger interval is cut into.
RANK_ROWS, SLICES = 50_000, 64


def linear_rank(p: float, n: Column) -> Column:
    """0-based fractional rank that interpolates between the smallest and the largest value."""
    return (n - 1) * F.lit(float(p))


def midpoint_rank(p: float, n: Column) -> Column:
    """0-based fractional rank of a box-plot hinge (value i stands at (i + 0.5) / n)."""
    return F.least(F.greatest(n * F.lit(float(p)) - 0.5, F.lit(0.0)), (n - 1).cast("double"))


def grouped_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], rank=linear_rank, rank_rows: int = RANK_ROWS, slices: int = SLICES
) -> DataFrame:
    """One row per group with a DOUBLE column per named probability; NULL keys and values are left out.

    The facts are read once: equal values of a group are counted and the counts written. A group of at most ``rank_rows``
    different values is ranked as it is. A larger one is selected in rounds: a sketch cuts every open interval of
    values into ``slices``, the slices are counted exactly, and only those that hold a wanted rank stay, until each has at
    most ``rank_rows`` values. So no task ever ranks more than that many rows, and a round reads only the counts.
    """
    data = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    for key in keys:
        data = data.filter(F.col(key).isNotNull())
    counted = _stored(data.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank(p, F.col("_size")).alias("at")) for name, p in probs.items()])
    ends = F.transform(wanted, lambda w: F.struct(w["name"], F.floor(w["at"]).alias("lo"), F.ceil(w["at"]).alias("hi"), w["at"]))
    # an interval: values above _above (NULL: all) up to _upto (NULL: all), _start rows of the group before it
    whole = counted.groupBy(*keys).agg(F.sum("_n").alias("_size"), F.count(F.lit(1)).alias("_values"))
    unbounded = F.lit(None).cast("double")
    whole = whole.select(*keys, unbounded.alias("_above"), unbounded.alias("_upto"), F.lit(0).cast("bigint").alias("_start"), "_values", ends.alias("_wanted"))
    open_ = _stored(whole)
    done = open_.filter(F.col("_values") <= rank_rows)
    while True:
        large = open_.filter(F.col("_values") > rank_rows)
        if large.isEmpty():
            break
        open_ = _stored(_narrowed(counted, large, keys, slices))
        done = done.unionByName(open_.filter(F.col("_values") <= rank_rows))
    inside = _members(counted, done, keys)
    running = Window.partitionBy(*keys, "_start").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = inside.withColumn("_last", F.col("_start") + F.sum("_n").over(running) - 1)
    ranked = ranked.withColumn("_first", F.col("_last") - F.col("_n") + 1)
    picks = ranked.select(*keys, "_v", "_first", "_last", F.explode("_wanted").alias("w"))
    weight = F.col("w.at") - F.col("w.lo")
    covers_lo = F.col("w.lo").between(F.col("_first"), F.col("_last"))
    covers_hi = F.col("w.hi").between(F.col("_first"), F.col("_last"))
    picks = picks.filter(covers_lo | covers_hi)
    columns = []
    for name in probs:
        mine = F.col("w.name") == name
        low = F.max(F.when(mine & covers_lo, F.col("_v")))
        high = F.max(F.when(mine & covers_hi, F.col("_v")))
        share = F.max(F.when(mine, weight))
        columns.append((low + (high - low) * share).alias(name))
    return picks.groupBy(*keys).agg(*columns)


def _stored(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _members(counted: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """The counted values of each interval, with the interval's columns."""
    rows = counted.join(intervals, keys)
    above = F.col("_above").isNull() | (F.col("_v") > F.col("_above"))
    return rows.filter(above & (F.col("_upto").isNull() | (F.col("_v") <= F.col("_upto"))))


def _narrowed(counted: DataFrame, large: DataFrame, keys: list[str], slices: int) -> DataFrame:
    """The slices of large intervals that hold a wanted rank, each with the ranks that it holds an end of."""
    one = [*keys, "_start"]  # an interval is told by its group and start
    cuts = F.percentile_approx("_v", [i / slices for i in range(1, slices)], 10 * slices)
    members = _members(counted, large, keys)
    edges = members.groupBy(*one).agg(F.array_sort(F.array_distinct(cuts)).alias("_cuts"))
    placed = members.join(edges, one).withColumn("_slice", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))))
    sums = placed.groupBy(*one, "_slice").agg(
        F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_values"), F.first("_cuts").alias("_cuts"),
        F.first("_above").alias("_above"), F.first("_upto").alias("_upto"), F.first("_wanted").alias("_wanted"),
    )
    before = Window.partitionBy(*one).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
    start = F.col("_start") + F.coalesce(F.sum("_rows").over(before), F.lit(0))
    found = sums.withColumn("_begin", start).withColumn("_end", F.col("_begin") + F.col("_rows"))
    holds = F.filter(
        "_wanted",
        lambda w: ((w["lo"] >= F.col("_begin")) & (w["lo"] < F.col("_end"))) | ((w["hi"] >= F.col("_begin")) & (w["hi"] < F.col("_end"))),
    )
    found = found.withColumn("_wanted", holds).filter(F.size("_wanted") > 0)
    lower = F.when(F.col("_slice") > 0, F.get("_cuts", F.col("_slice") - 1)).otherwise(F.col("_above"))
    upper = F.when(F.col("_slice") < F.size("_cuts"), F.get("_cuts", F.col("_slice"))).otherwise(F.col("_upto"))
    return found.select(*keys, lower.alias("_above"), upper.alias("_upto"), F.col("_begin").alias("_start"), "_values", "_wanted")


def bin_of(value: Column, breaks: Column) -> Column:
    """1-based bin of a value: bins are closed on the left, the last one on both sides; repeated breaks merge."""
    distinct = F.array_sort(F.array_distinct(breaks))
    return F.when(
        value.isNotNull() & breaks.isNotNull(),
        F.greatest(
            F.lit(1), F.least(F.size(F.filter(distinct, lambda b: b <= value)), F.greatest(F.size(distinct) - 1, F.lit(1)))
        ),
    )
