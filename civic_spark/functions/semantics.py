"""NULL, text and number rules shared by every plan.

Two families exist on purpose. SQL-side expressions ignore NULLs the way a database does. The
``na_*`` family follows statistical-frame rules: one missing input makes the result missing,
missing keys match each other, and missing text prints as ``NA``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_OR_GAP = r"([\p{L}\p{N}_]+(?:['.:][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_]+)"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def named(value: Column, build) -> Column:
    """Bind a value to a name: ``build`` sees it as one lambda variable, so a long expression that uses it many
    times neither repeats its computation nor grows past what code generation can compile."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def na_sum(value: Column | str) -> Column:
    """Sum that is NULL as soon as one input is NULL (mergeable, so it pre-aggregates map-side)."""
    value = as_col(value)
    return F.when(F.bool_or(value.isNull()), None).otherwise(F.sum(value))


def na_paste(*values: Column | str, sep: str = " ") -> Column:
    """Concatenate with NULL printed as ``NA``."""
    parts = [F.coalesce(as_col(v).cast("string"), F.lit("NA")) for v in values]
    return F.concat_ws(sep, *parts)


def not_in(value: Column | str, allowed: Iterable[str]) -> Column:
    """``NOT IN`` that keeps NULLs: a NULL is not a member, so the answer is TRUE."""
    return ~F.coalesce(as_col(value).isin(*allowed), F.lit(False))


def unanimous(value: Column | str, skip_nulls: bool = False) -> Column:
    """The single distinct value of a group, NULL when the group disagrees.

    A NULL counts as disagreement unless NULLs are skipped. min = max decides, which merges in constant memory
    where a distinct count would not.
    """
    value = as_col(value)
    agree = F.min(value) == F.max(value)
    if not skip_nulls:
        agree = agree & ~F.bool_or(value.isNull())
    return F.when(agree, F.min(value))


def title_case(value: Column | str) -> Column:
    """Capitalise after every word break, so ``judge/executive`` becomes ``Judge/Executive``."""
    pieces = F.regexp_extract_all(F.lower(as_col(value)), F.lit(WORD_OR_GAP), F.lit(1))
    raised = F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(2, 1 << 30)))
    return F.array_join(raised, "")


def squish(value: Column | str) -> Column:
    return F.trim(F.regexp_replace(as_col(value), r"\s+", " "))


def digits_number(value: Column | str) -> Column:
    """Number spelled by the digits of a text (``hb12`` -> 12), NULL when there are none."""
    return F.regexp_replace(as_col(value), r"\D", "").try_cast("bigint")


def matched(value: Column | str, pattern: str, group: int = 1) -> Column:
    """First match of a capture group, NULL (not '') when the pattern does not occur."""
    return F.nullif(F.regexp_extract(as_col(value), pattern, group), F.lit(""))


def ratio(top: Column, bottom: Column) -> Column:
    """Division that yields NULL on a zero denominator instead of failing in ANSI mode."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))
