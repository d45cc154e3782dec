"""Matching unresolved candidates to an outside roster by name, strictly first and then loosely."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import first_last, name_key
from ..functions.offices import roster_office
from ..functions.semantics import unanimous
from ..operators.joins import nullsafe_join
from .primaries import CANDIDATE


def roster_parties(roster: DataFrame) -> DataFrame:
    """One party per (year, office, name key); names listed under two parties are dropped.

    A roster is a list of versions, told by the ``year`` they were valid for.
    """
    keyed = roster.select(
        "year", roster_office("office_bp").alias("office"), name_key("candidate").alias("nkey"), "party"
    )
    return keyed.groupBy("year", "office", "nkey").agg(unanimous("party").alias("party")).filter(F.col("party").isNotNull())


def roster_status(unresolved: DataFrame, roster: DataFrame, year: int | None = None) -> DataFrame:
    """Every unresolved candidate with the party of the roster of that year, NULL where the roster does not help.

    ``year`` picks one election year; None takes all, each against its own version. The full name key decides
    first, first and last token only for candidates the full key did not find. Both tiers join against unanimous,
    therefore unique, keys, so a candidate stays one row and nothing is re-read to find out who is left over.
    """
    if year is not None:
        unresolved, roster = unresolved.filter(F.col("year") == year), roster.filter(F.col("year") == year)
    listed = roster_parties(roster)
    by_key = listed.withColumnRenamed("party", "_exact")
    by_ends = listed.groupBy("year", "office", first_last("nkey").alias("fl")).agg(unanimous("party").alias("_loose"))
    wanted = unresolved.select(*CANDIDATE, "office").withColumn("nkey", name_key("candidate"))
    found = nullsafe_join(wanted, by_key, ["year", "office", "nkey"], "left", never_null=["year"]).withColumn("fl", first_last("nkey"))
    found = nullsafe_join(found, by_ends, ["year", "office", "fl"], "left", never_null=["year"])
    return found.select(*CANDIDATE, "office", F.coalesce("_exact", "_loose").alias("party"))


def matched_candidates(status: DataFrame) -> DataFrame:
    return status.filter(F.col("party").isNotNull()).select(*CANDIDATE, "party").distinct()


def match_rate(status: DataFrame) -> DataFrame:
    """Candidates asked for, matched, and the percentage, per year."""
    found = F.count_distinct(F.when(F.col("party").isNotNull(), F.struct(*CANDIDATE, "party")))
    both = status.groupBy("year").agg(F.count(F.lit(1)).alias("unresolved"), found.alias("matched"))
    return both.withColumn("match_pct", F.bround(F.col("matched") * 100.0 / F.col("unresolved"), 0))


def matched_by_office(status: DataFrame) -> DataFrame:
    return _by_office(status.filter(F.col("party").isNotNull()))


def unmatched_by_office(status: DataFrame) -> DataFrame:
    return _by_office(status.filter(F.col("party").isNull()))


def _by_office(rows: DataFrame) -> DataFrame:
    return rows.groupBy("office").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "office")
