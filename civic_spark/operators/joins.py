"""Joins with statistical-frame key rules, and joins that stay cheap when one side is a small dimension.

No broadcast hints anywhere: Spark broadcasts a side only after checking its size against
``spark.sql.autoBroadcastJoinThreshold`` (from statistics, and again from real shuffle sizes under
AQE), and otherwise falls back to a sort-merge join whose hot partitions AQE splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import shared_folder

#: A product join meets at most about this many rows of one side with as many of the other in one block.
BLOCK_ROWS = 1024
#: Rows and pairs that a task of a product join handles, on average.
TASK_PAIRS = 2_000_000


def nullsafe_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", never_null: tuple[str, ...] | list[str] = ()
) -> DataFrame:
    """Equi join where NULL keys match each other; keeps one copy of the keys.

    ``eqNullSafe`` is still planned as a hash or sort-merge join, but on two derived expressions per key, which
    hides an existing partitioning. Keys listed in ``never_null`` are compared with plain equality instead.
    """
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in on})
    pairs = [(k, F.col(k), F.col(f"__right_{k}")) for k in on]
    matches = reduce(Column.__and__, [a == b if k in never_null else a.eqNullSafe(b) for k, a, b in pairs])
    joined = left.join(renamed, matches, how)
    return joined.drop(*[f"__right_{k}" for k in on])


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every column name the two sides share."""
    shared = [c for c in left.columns if c in right.columns]
    return nullsafe_join(left, right, shared, "left")


def lookup_missing_as_null(df: DataFrame, dim: DataFrame, key: str, dim_key: str) -> DataFrame:
    """Left lookup under SQL key rules (a NULL key finds nothing); repeated dimension keys fan out."""
    return df.join(dim, df[key] == dim[dim_key], "left").drop(dim[dim_key])


def layer_for_year(year: Column, versions: list[tuple[str, int | None, int | None]]) -> Column:
    """Which dated layer serves a year, so that the range join becomes an equi join on the layer name."""
    layer = F.lit(None).cast("string")
    for name, first, last in versions:
        inside = F.lit(True)
        if first is not None:
            inside = inside & (year >= first)
        if last is not None:
            inside = inside & (year <= last)
        layer = F.when(inside, name).otherwise(layer)
    return layer


def product_join(left: DataFrame, right: DataFrame, keys: list[str], block_rows: int = BLOCK_ROWS, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """Inner join of two tables that both hold many rows of a key, so that the result far outgrows them.

    Left to itself, all pairs of a key come out of one task: AQE splits by bytes read, and these are few. Here each side
    of a key is cut at random into slices of about ``block_rows`` rows, and a pair of slices is a block; blocks are dealt
    over as many tasks as there are pairs to make, whatever the keys. A slice of the left, meant to be the narrow side, is one row
    with a list, which each row of the right unfolds: that costs less a pair than matching rows. Draws are written before they are
    used, so that a task that runs again sees the same ones. Every pair of rows meets in exactly one block; NULL keys find nothing.
    """
    spark, sides, sizes = left.sparkSession, [], []
    for side, n in ((left, "_n"), (right, "_m")):
        path = shared_folder(spark)
        side.dropna(subset=keys).withColumn("_draw", F.rand(29)).write.parquet(path)
        sides.append(spark.read.parquet(path))
        sizes.append(sides[-1].groupBy(*keys).agg(F.count(F.lit(1)).alias(n)))
    path = shared_folder(spark)
    sizes[0].join(sizes[1], keys).write.parquet(path)
    groups = spark.read.parquet(path)  # a row per key
    made = groups.agg(F.sum(F.col("_n") * F.col("_m") + F.col("_n") + F.col("_m"))).first()[0] or 0
    tasks = max(1, -(-made // task_pairs))

    slices = {n: F.ceil(F.col(n) / block_rows) for n in ("_n", "_m")}
    cut = groups.select(*keys, *[at.cast("int").alias(n) for n, at in slices.items()])
    own, others = ([c for c in side.columns if c not in keys] for side in (left, right))
    placed = [side.join(cut, keys).withColumn(at, F.floor(F.col("_draw") * F.col(n)).cast("int")) for side, at, n in zip(sides, ("_i", "_j"), ("_n", "_m"))]
    lists = placed[0].groupBy(*keys, "_i", "_m").agg(F.collect_list(F.struct(F.lit(0).alias("_one"), *own)).alias("_rows"))
    blocks = []
    for side, other, n in ((lists, "_j", "_m"), (placed[1].select(*keys, *others, "_j", "_n"), "_i", "_n")):
        dealt = side.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n) - 1))).drop(n)
        blocks.append(dealt.repartition(tasks, *keys, "_i", "_j"))
    pairs = blocks[1].join(blocks[0], [*keys, "_i", "_j"]).select(*keys, *others, F.inline("_rows"))
    return pairs.select(*keys, *own, *others)
