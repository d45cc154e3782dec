"""Wide and long forms with column lists known up front, so no extra job discovers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by_value(column: str, values: dict[str, str | None], weight: Column | None = None) -> list[Column]:
    """Aggregates that count rows per listed value (NULL counts the missing ones), 0 when there are none."""
    one = F.lit(1) if weight is None else weight
    return [
        F.coalesce(F.sum(F.when(F.col(column).eqNullSafe(F.lit(value)), one)), F.lit(0)).alias(name)
        for name, value in values.items()
    ]


def counts_by_value(df: DataFrame, keys: list[str], column: str, missing: str = "NA") -> DataFrame:
    """One row per key with ``counts``, a map from every value that occurs to its number of rows.

    Rows are counted per key and value first, so no job has to discover the values, and a key's map is as large as the
    number of different values it has. NULL is counted as ``missing``.
    """
    value = F.coalesce(F.col(column).cast("string"), F.lit(missing))
    pairs = df.groupBy(*keys, value.alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    entries = F.sort_array(F.collect_list(F.struct("_value", "_n")))
    return pairs.groupBy(*keys).agg(F.map_from_entries(entries).alias("counts"))


def map_text(column: Column | str, sep: str = " | ") -> Column:
    """A map as ``key=value`` text in the order of its entries."""
    pairs = F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.array_join(pairs, sep)


def crosstab(df: DataFrame, rows: list[str], column: str, values: list[str]) -> DataFrame:
    """Counts of ``column`` values per row key, missing combinations 0."""
    return df.groupBy(*rows).pivot(column, values).agg(F.count(F.lit(1))).fillna(0, values)


def to_long(df: DataFrame, keys: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def prefixed(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]
