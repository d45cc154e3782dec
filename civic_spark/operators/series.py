"""Daily series: running totals over days, with the days between observations filled in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_totals(daily: DataFrame, keys: list[str], day: str, sums: dict[str, str]) -> DataFrame:
    """Cumulative sum of columns over days. Input has one row per day, so a partition is a calendar."""
    so_far = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.withColumns({out: F.sum(col).over(so_far) for col, out in sums.items()})


def fill_days(daily: DataFrame, keys: list[str], day: str, zero: list[str]) -> DataFrame:
    """Repeat each row up to the day before the next one, with the ``zero`` columns 0 on the added days.

    Expanding in place needs neither a separate calendar nor a join with it.
    """
    order = Window.partitionBy(*keys).orderBy(day)
    until = F.coalesce(F.date_sub(F.lead(day).over(order), 1), F.col(day))
    spread = daily.withColumn("_until", until).select(
        "*", F.posexplode(F.sequence(F.col(day), F.col("_until"), F.expr("interval 1 day"))).alias("_step", "_day")
    )
    filled = {c: F.when(F.col("_step") == 0, F.col(c)).otherwise(F.lit(0)) for c in zero}
    return spread.withColumns({**filled, day: F.col("_day")}).drop("_until", "_step", "_day")
