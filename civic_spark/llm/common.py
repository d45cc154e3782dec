"""What the operators share: the shared folder, written stages, connected components, and word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word: the longest run of bytes that are neither space nor tab to carriage return (fixed by the contract).
#: ``bytes.split()`` breaks at exactly these characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session names none (tests on one machine) a temporary folder is set for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = f"file://{tempfile.mkdtemp(prefix='civic-llm-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: what follows does not recompute them, and an
    executor lost later costs only a read."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal ``key`` from sorted batches: a run never spans two tables, small runs share one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(keys != keys[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if held and (cut or held[-1].column(key)[-1].as_py() != keys[0]):
            if not cut:
                yield pa.Table.from_batches(held)
                held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def run_bounds(keys: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal keys."""
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    ends = [0, *cuts.tolist(), len(keys)]
    return list(zip(ends[:-1], ends[1:]))


def words_count(text) -> F.Column:
    """Number of words of a text; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def smallest_labels(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges (a, b)``: one row ``(id, component)`` for every end, where
    ``component`` is the smallest id reachable.

    Large-star and small-star steps in turn: every step joins nodes to the smallest neighbour seen, so the longest
    distance to the root about halves each round. All steps are aggregations and equi-joins on written tables, so
    that Spark can split the join of a root with very many nodes; the driver sees two counts per round. Self edges and repeated edges are allowed. No rows give no rows.
    """
    links = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links"
    )
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    while True:
        # large star: each larger neighbour of a node is linked to the node's smallest neighbour (itself included)
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and the node itself are linked to the smallest neighbour
        large = written(large, "links")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        after = written(small.where("u <> v").distinct(), "links")
        # done when every node has one parent and no parent has a parent
        parents = after.select(F.col("v").alias("u")).distinct()
        unsettled = after.join(parents, "u", "left_semi").limit(1).count()
        several = after.groupBy("u").count().where("count > 1").limit(1).count()
        links = after
        if not unsettled and not several:
            break
    return nodes.join(links.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select(
        "id", F.coalesce("root", "id").alias("component")
    )


def bounded_rank(df: DataFrame, keys: list[str], order: list, name: str, salt: F.Column, slices: int = 64) -> DataFrame:
    """Position from 1 of each row within its group, for groups of any size.

    ``salt`` is a number in [0, 1) that grows with ``order``. Groups are cut into ``slices`` by it; rows are ranked
    within a slice and moved up by the count of the slices before, so no task holds a whole group.
    """
    cut = df.withColumn("_slice", F.floor(salt * slices).cast("int"))
    counts = cut.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = counts.withColumn(
        "_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    ).drop("_n")
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order)))
    same = [ranked[k].eqNullSafe(before[k]) for k in keys] + [ranked["_slice"] == before["_slice"]]
    joined = ranked.join(before, same, "left")
    return joined.select(*[ranked[c] for c in df.columns], (ranked["_rank"] + F.coalesce(before["_before"], F.lit(0))).cast("long").alias(name))
