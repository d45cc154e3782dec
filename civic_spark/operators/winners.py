"""Winners, ties, shares and candidate slots.

Input rows are (unit, candidate, party, votes), as totals with one row per candidate and party, or ``counted``: equal
rows put together, with their number ``n``. Everything per unit is one ``groupBy`` of mergeable aggregates over such
reduced rows: the leading row is a minimum of (-votes, candidate, party) and the trailing one a maximum of (votes,
candidate, party); a unit is tied when more than one row has its top score, so when the two ends differ or stand for
several equal rows. No unit is ever sorted or buffered, and a hot unit is pre-aggregated on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import comma
from ..functions.semantics import na_sum, ratio
from .joins import nullsafe_join

#: Most candidates of the contests that are shown with a column per candidate, as the original does (2, 3 or 4).
SLOTS = 4


def totals(rows: DataFrame, keys: list[str], party: bool = True) -> DataFrame:
    """Votes per candidate (and party) within the keys; one missing count makes the total missing."""
    by = [*keys, "candidate", "party"] if party else [*keys, "candidate"]
    return rows.groupBy(*by).agg(na_sum("votes").alias("votes"))


def counted(rows: DataFrame, unit: list[str]) -> DataFrame:
    """Equal rows of a unit put together by a hash aggregate, with ``n``, how many they are."""
    return rows.groupBy(*unit, "candidate", "party", "votes").agg(F.count(F.lit(1)).alias("n"))


def _who() -> list[Column]:
    """Candidate and party with NULLs placed last, as sort fields."""
    fields = []
    for name in ("candidate", "party"):
        fields += [F.col(name).isNull().alias(f"no_{name}"), F.col(name).alias(name)]
    return fields


def _rows(n: Column | int) -> Column:
    return (F.lit(n) if isinstance(n, int) else n).cast("bigint")


def leading_row(n: Column | int = 1) -> Column:
    """Aggregate: the first highest row, with how many equal rows it stands for. Rows without votes never win."""
    row = F.struct((-F.col("votes")).alias("against"), F.col("votes").alias("votes"), *_who(), _rows(n).alias("n"))
    return F.min(F.when(F.col("votes").isNotNull(), row))


def trailing_row() -> Column:
    """Aggregate: the last of the highest rows."""
    row = F.struct(F.col("votes").alias("votes"), *_who())
    return F.max(F.when(F.col("votes").isNotNull(), row))


def winner_columns(ties: bool = True, n: Column | int = 1) -> list[Column]:
    """Aggregates behind ``finish_winner``; ``n`` is the number of rows that a row stands for."""
    columns = [
        leading_row(n).alias("_top"),
        na_sum(F.col("votes") * _rows(n)).alias("total_votes"),
        F.bool_or(F.col("votes").isNull()).alias("_missing"),
    ]
    return columns + [trailing_row().alias("_end")] if ties else columns


def finish_winner(units: DataFrame, prize: str = "party", ties: bool = True) -> DataFrame:
    """Turn the aggregates into ``winner``, ``winning_votes``, ``winning_share``; several rows at the top are a Tie."""
    champion = F.col(f"_top.{prize}")
    if ties:
        same = [F.col(f"_top.{c}").eqNullSafe(F.col(f"_end.{c}")) for c in ("candidate", "party")]
        alone = same[0] & same[1] & (F.col("_top.n") == 1)
        champion = F.when(F.col("_missing"), None).when(alone, champion).otherwise("Tie")
    return units.withColumns(
        {
            "winner": champion,
            "winning_votes": F.col("_top.votes"),
            "winning_share": ratio(F.col("_top.votes"), F.col("total_votes")),
        }
    ).drop("_top", "_end", "_missing")


def unit_winners(rows: DataFrame, unit: list[str], prize: str = "party", ties: bool = True, extra: list[Column] = ()):
    """One row per unit: winner, total, share and any extra aggregates. ``rows`` are totals, or ``counted``."""
    n = F.col("n") if "n" in rows.columns else 1
    return finish_winner(rows.groupBy(*unit).agg(*winner_columns(ties, n), *extra), prize, ties)


def winner_beside(rows: DataFrame, unit: list[str], prize: str = "party", ties: bool = True) -> DataFrame:
    """Every row of a unit with the unit's winner and total beside it.

    Joins the per-unit summary back instead of opening a window, so that a hot unit can still be split. The unit
    columns must not be NULL.
    """
    return rows.join(unit_winners(rows, unit, prize, ties), unit)


def candidate_slots(rows: DataFrame, contest: list[str], unit: str) -> DataFrame:
    """Number the candidates of a contest in order of first appearance in (unit, candidate) order.

    The window sees one row per candidate of a contest, i.e. the length of a ballot. The candidate's votes in the
    whole contest come along: they head the candidate's column, and reading the same columns as the rows do lets
    Spark reuse the rows' shuffle instead of computing them a second time.
    """
    firsts = rows.groupBy(*contest, "candidate").agg(
        F.min(unit).alias("first_unit"), na_sum("votes").alias("contest_votes")
    )
    ballot = Window.partitionBy(*contest)
    order = ballot.orderBy(F.col("first_unit").asc_nulls_last(), F.col("candidate").asc_nulls_last())
    return firsts.select(
        *contest,
        "candidate",
        F.row_number().over(order).cast("bigint").alias("slot"),
        F.count(F.lit(1)).over(ballot).alias("n_candidates"),
        "contest_votes",
    )


def slot_columns(slots: int = SLOTS) -> list[Column]:
    """Aggregates ``canN`` (name), ``canN_total`` (its heading) and ``canN_votes``; the fixed list avoids a job to
    discover columns."""
    columns = []
    for n in range(1, slots + 1):
        here = F.col("slot") == n
        columns += [
            F.max(F.when(here, F.col("candidate"))).alias(f"can{n}"),
            F.max(F.when(here, F.col("contest_votes"))).alias(f"can{n}_total"),
            F.sum(F.when(here, F.col("votes"))).alias(f"can{n}_votes"),
        ]
    return columns


def ballot_column() -> Column:
    """Aggregate: all candidates of a ballot of any length, in slot order: ``(slot, candidate, contest_votes, votes)``.

    A unit has one summed row per candidate and party; the list is as long as the ballot.
    """
    row = F.struct("slot", "candidate", "contest_votes", F.col("party").isNull().alias("no_party"), "party", "votes")
    rows = F.sort_array(F.collect_list(row))
    return F.transform(rows, lambda x: F.struct(x["slot"], x["candidate"], x["party"], x["contest_votes"], x["votes"]))


def ballots(rows: DataFrame, contest: list[str], unit: str) -> DataFrame:
    """One row per unit with its whole ballot, whatever its length, as ``ballot``; rows are totals."""
    slots = candidate_slots(rows, contest, unit)
    placed = nullsafe_join(rows, slots, [*contest, "candidate"], never_null=contest)
    return placed.groupBy(*contest, unit).agg(F.max("n_candidates").alias("n_candidates"), ballot_column().alias("ballot"))


def with_slot_shares(wide: DataFrame, slots: int = SLOTS) -> DataFrame:
    shares = {f"can{n}_pct": ratio(F.col(f"can{n}_votes"), F.col("total_votes")) for n in range(1, slots + 1)}
    return wide.withColumns(shares)


def ranked_candidates(rows: DataFrame, contest: list[str]) -> DataFrame:
    """Candidates of a contest by descending share of its votes, labelled IND1, IND2, ..."""
    by_candidate = totals(rows, contest, party=False)
    ballot = Window.partitionBy(*contest)
    whole = F.when(F.bool_or(F.col("votes").isNull()).over(ballot), None).otherwise(F.sum("votes").over(ballot))
    shares = by_candidate.withColumn("pct", ratio(F.col("votes"), whole))
    order = ballot.orderBy(F.col("pct").desc_nulls_last(), F.col("candidate").asc_nulls_last())
    ranked = shares.withColumn("cnt", F.row_number().over(order).cast("bigint"))
    return ranked.withColumn("party", F.concat(F.lit("IND"), F.col("cnt").cast("string")))


def vote_label(n: Column | int = 1) -> Column:
    """Aggregate: ``candidate: 1,234`` lines of a unit in candidate order, each as often as its row stands there."""
    line = F.concat(F.coalesce("candidate", F.lit("NA")), F.lit(": "), F.coalesce(comma("votes"), F.lit("NA")))
    again = F.array_repeat(line, _rows(n).cast("int"))
    lines = F.sort_array(F.collect_list(F.struct(*_who(), F.col("votes").alias("votes"), again.alias("lines"))))
    return F.array_join(F.flatten(F.transform(lines, lambda x: x["lines"])), "<br>")
