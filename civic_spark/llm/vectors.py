"""Vectors of a table: which take part, copies of one vector, and blocks of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable(table: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``id, vec, dim`` of the rows that take part: an id, and a vector without NULL or non-finite components that is not zero."""
    rows = table.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    return rows.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0)).withColumn("dim", F.size("vec"))


def distinct_vectors(rows: DataFrame, ids_kept: int) -> DataFrame:
    """One row per different vector: ``dim, vec, rep`` (smallest id), ``copies`` and its ``ids_kept`` smallest ids.

    The rank filter is applied before and after the shuffle, so a vector with very many copies moves few rows.
    """
    counts = rows.groupBy("dim", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    if ids_kept <= 1:
        return counts.withColumn("ids", F.array("rep"))
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("dim", "vec").orderBy("id"))).where(F.col("nth") <= ids_kept)
    lists = first.groupBy("dim", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return counts.join(lists, ["dim", "vec"])


def matrix(column) -> np.ndarray:
    """Rows of equal length as one matrix of doubles."""
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)
