"""Page extraction that picks up only pages added since the last run and appends their rows.

The checkpoint remembers which files were read, so a lost executor or a restarted job neither loses nor
repeats a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.pages import roster_items


def extract_new_pages(
    spark: SparkSession, path: str, schema: StructType | str, out: str, checkpoint: str, prepare=lambda pages: pages
) -> DataFrame:
    """Append roster items of unread page files to ``out`` and return the distinct rows saved so far.

    ``path`` is a folder or a glob of Parquet files.
    """
    pages = spark.readStream.schema(schema).parquet(path)

    def save(batch: DataFrame, batch_id: int) -> None:
        # A batch writes its own folder, so repeating it after a failure replaces rather than duplicates.
        roster_items(prepare(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        pages.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch").distinct()
