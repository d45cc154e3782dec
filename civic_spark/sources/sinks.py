"""Sinks: table overwrite and append, CSV worksheets, and dry-run jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the one the cluster names in ``spark.checkpoint.dir``.

    Where none is named, only a session on one machine gets a temporary folder; on a cluster that is an error, as executors
    would not see the driver's folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = tempfile.mkdtemp(prefix="civic-spark-")
    return f"{base.rstrip('/')}/run-{uuid.uuid4().hex}"


def overwrite_table(df: DataFrame, path: str, sort_by: list[str] | None = None) -> None:
    """Replace a table. Sorting inside the files lets readers skip row groups on the key, as an index would."""
    (df.sortWithinPartitions(*sort_by) if sort_by else df).write.mode("overwrite").parquet(path)


def bucketed_table(df: DataFrame, table: str, keys: list[str], buckets: int, path: str) -> None:
    """Replace a catalog table bucketed on its key, so later joins on the key need no shuffle of it."""
    writer = df.repartition(buckets, *keys).write.mode("overwrite").option("path", path)
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True, quote='"', escape='"')


def seed_csv(df: DataFrame, path: str) -> None:
    """Write a worksheet only where there is none yet, so that hand edits survive."""
    write_csv(df, path, mode="ignore")


def run_job(df: DataFrame, path: str, write: bool = False, sort_by: list[str] | None = None) -> DataFrame:
    """Return the job's result; it reaches the table only when asked to."""
    if not write:
        return df
    overwrite_table(df, path, sort_by)
    return df.sparkSession.read.parquet(path)
