"""Grouped, ordered pick lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import party_label
from ..functions.offices import PARTISAN_LEVELS, level_label, level_rank, with_office
from ..functions.semantics import na_paste, not_in, title_case
from ..operators.joins import nullsafe_join

# A pick of a primary is the race, a unit separator and a party token.
SEPARATOR = "\u001f"
UNLABELED, EVERYONE = "__UNLABELED__", "__ALL__"


def grouped_choices(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number the choices (value, label, office_level, office, district) of each list by level and by
    office, district number and name inside a level. A level holds distinct names only."""
    ranked = df.withColumns(
        {
            "group_rank": level_rank("office_level").cast("bigint"),
            "group_label": level_label("office_level"),
            "district_num": F.col("district").try_cast("int"),
        }
    )
    order = Window.partitionBy(*keys, "group_rank").orderBy(
        F.col("office").asc_nulls_last(), F.col("district_num").asc_nulls_last(), F.lower("value"), "value"
    )
    return ranked.select(
        *keys,
        "group_rank",
        "group_label",
        F.row_number().over(order).cast("bigint").alias("item_rank"),
        "value",
        "label",
    )


def election_choices(election_data: DataFrame, race_lookup: DataFrame, election: str = "general") -> DataFrame:
    """Races of a year, grouped by office level. Races unknown to the crosswalk are listed as local."""
    races = election_data.filter(F.col("election") == election).select("year", "race").distinct()
    known = nullsafe_join(races, race_lookup, ["race"], "left")
    listed = known.withColumns(
        {"office": F.coalesce("office", "race"), "value": F.col("race"), "label": F.col("race")}
    )
    return grouped_choices(listed, ["year"])


def primary_choices(party_lookup: DataFrame, race_lookup: DataFrame) -> DataFrame:
    """One choice per (race, party), one for unlabeled candidates of partisan races, one per nonpartisan race."""
    cols = ["year", "race", "office", "office_level"]
    resolved = party_lookup.filter(F.col("party").isNotNull()).select(*cols, "party").distinct()
    resolved = resolved.select(
        *cols,
        F.col("party").alias("token"),
        F.concat("race", F.lit(" ("), party_label("party"), F.lit(")")).alias("label"),
    )
    partisan = F.col("office_level").isin(*PARTISAN_LEVELS)
    unlabeled = party_lookup.filter(partisan & F.col("party").isNull()).select(*cols).distinct()
    unlabeled = unlabeled.select(
        *cols, F.lit(UNLABELED).alias("token"), F.concat("race", F.lit(" (Unlabeled)")).alias("label")
    )
    open_races = party_lookup.filter(not_in("office_level", PARTISAN_LEVELS)).select(*cols).distinct()
    open_races = open_races.select(*cols, F.lit(EVERYONE).alias("token"), F.col("race").alias("label"))
    rows = resolved.unionByName(unlabeled).unionByName(open_races)
    rows = rows.withColumn("value", F.concat("race", F.lit(SEPARATOR), "token"))
    districts = race_lookup.select("race", "district").distinct()
    return grouped_choices(nullsafe_join(rows, districts, ["race"], "left"), ["year"])


def office_choices(contrib: DataFrame) -> DataFrame:
    """Offices sought per election date, classified from their title-cased text."""
    offices = contrib.select("election_date", title_case("office_sought").alias("value")).distinct()
    classified = with_office(offices, "value").withColumn("label", F.col("value"))
    return grouped_choices(classified, ["election_date"])


def election_dates(contrib: DataFrame) -> DataFrame:
    """One label (``Type Year``) per election date, newest first."""
    types = contrib.select("election_type", "election_date").distinct()
    first = types.groupBy("election_date").agg(F.min("election_type").alias("election_type"))
    label = na_paste(title_case("election_type"), F.year("election_date"))
    return first.select(label.alias("election_select"), "election_date").orderBy(F.col("election_date").desc_nulls_last())


def candidate_choices(contrib: DataFrame) -> DataFrame:
    """Candidates per election and office, by name without regard to case."""
    cols = ["election_date", "office_sought", "recipient_first_name", "recipient_last_name", "candidate"]
    names = contrib.select(*cols).distinct().select(
        "election_date",
        "office_sought",
        na_paste("recipient_first_name", "recipient_last_name").alias("candidate_name"),
        "candidate",
    )
    return names.distinct().orderBy("election_date", "office_sought", F.lower("candidate_name"), "candidate")
