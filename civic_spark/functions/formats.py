"""Display formats: thousands separators, percents and dollars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import as_col

CENTS_SHOWN_BELOW = 100000  # larger amounts are always shown in whole dollars


def comma(value: Column | str) -> Column:
    return F.format_number(as_col(value), 0)


def percent(value: Column | str) -> Column:
    """Share to two decimals, e.g. 0.5 -> ``50.00%``."""
    return F.concat(F.format_number(as_col(value) * 100, 2), F.lit("%"))


def shows_cents(largest: Column, any_part: Column) -> Column:
    """Whether a set of amounts is written with cents: none of them is large and one of them is not whole."""
    return (largest < CENTS_SHOWN_BELOW) & any_part


def has_cents(value: Column) -> Column:
    return value.cast("double") != F.floor(value.cast("double"))


def dollar(value: Column | str, cents: Column | None = None) -> Column:
    """``-$1,234``. Amounts shown together share one decision on cents; a lone amount decides for itself."""
    value = as_col(value)
    magnitude = F.abs(value)
    cents = shows_cents(magnitude, has_cents(value)) if cents is None else cents
    digits = F.when(cents, F.format_number(magnitude, 2)).otherwise(F.format_number(magnitude, 0))
    return F.concat(F.when(value < 0, F.lit("-$")).otherwise(F.lit("$")), digits)


def whole_dollar(value: Column | str) -> Column:
    """Dollar text after rounding half to even."""
    return dollar(F.bround(as_col(value), 0))
