"""Contest results: totals, winners per county and precinct, and the data behind the maps.

A contest is (year, election, race). Results for every contest come out of one job; filter the input to get
a single one. ``keys`` names the columns of a contest: rows of a split primary carry a token besides (``PRIMARY``
in ``primaries``), so that each party's primary has its own totals, winners and ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.colors import ramp_fill, ramp_position
from ..functions.semantics import title_case
from ..operators import winners as win
from ..operators.joins import layer_for_year, nullsafe_join
from ..operators.spatial import bbox_columns
from ..sources.tables import county_fips, voting_district

CONTEST = ["year", "election", "race"]
GRAIN = [*CONTEST, "county", "precinct", "candidate", "party", "votes"]
WHOLE_COUNTY = "county"  # precinct value of rows that report a county as one unit

# Precinct map layers and the first and last election year each one serves.
PRECINCT_LAYERS = [
    ("precincts", None, 2021),
    ("precincts_22", 2022, 2022),
    ("precincts_24", 2023, 2023),
    ("precincts_general_24", 2024, None),
]


def contest_rows(election_data: DataFrame, counties: list[str] | None = None, **contest) -> DataFrame:
    """Result rows without exact duplicates, optionally of one year, election, race and set of counties.

    Contests and counties are picked by equality, so rows without them belong to none.
    """
    rows = election_data.select(*GRAIN)
    for column in [*CONTEST, "county"]:
        rows = rows.filter(F.col(column).isNotNull())
    for column, value in contest.items():
        rows = rows.filter(F.col(column) == (value.lower() if column == "election" else value))
    if counties is not None:
        rows = rows.filter(F.col("county").isin(*[c.lower() for c in counties]))
    return rows.distinct()


def contest_result(rows: DataFrame, keys: list[str] = CONTEST) -> DataFrame:
    """Votes per candidate, most votes first within a contest."""
    summed = win.totals(rows, keys, party=False).withColumn("display_name", title_case("candidate"))
    return summed.orderBy(*keys, F.col("votes").desc_nulls_last(), "candidate")


def _county_totals(rows: DataFrame, keys: list[str] = CONTEST) -> DataFrame:
    return win.totals(rows, [*keys, "county"]).withColumn("unit", F.col("county"))


def _precinct_totals(rows: DataFrame, keys: list[str] = CONTEST) -> DataFrame:
    units = rows.filter(F.col("precinct") != WHOLE_COUNTY)
    named = units.withColumn("unit", F.concat_ws(" - ", F.upper("county"), "precinct"))
    return win.totals(named, [*keys, "unit"])


def _wide(long: DataFrame, keys: list[str], prize: str, ties: bool) -> DataFrame:
    """One row per unit with up to four candidate slots, for contests with two to four candidates."""
    slots = win.candidate_slots(long, keys, "unit")
    fitting = slots.filter(F.col("n_candidates").between(2, win.SLOTS))
    placed = nullsafe_join(long, fitting, [*keys, "candidate"], never_null=keys)
    wide = win.unit_winners(
        placed, [*keys, "unit"], prize, ties, [*win.slot_columns(), F.max("n_candidates").alias("n_candidates")]
    )
    return win.with_slot_shares(wide).drop("winning_votes", "winning_share")


def _listed(long: DataFrame, keys: list[str], prize: str, ties: bool) -> DataFrame:
    """One row per unit and candidate, for contests whose candidates do not fit the slots."""
    slots = win.candidate_slots(long, keys, "unit")
    others = slots.filter(~F.col("n_candidates").between(2, win.SLOTS))
    placed = nullsafe_join(long, others, [*keys, "candidate"], never_null=keys)
    beside = win.winner_beside(placed, [*keys, "unit"], prize, ties)
    return beside.select(*keys, "unit", "winner", "candidate", "votes", "contest_votes")


def county_table(rows: DataFrame, keys: list[str] = CONTEST) -> DataFrame:
    """Counties of contests with two to four candidates: winning candidate (first of equals), votes, shares."""
    return _wide(_county_totals(rows, keys), keys, "candidate", ties=False)


def county_table_listed(rows: DataFrame, keys: list[str] = CONTEST) -> DataFrame:
    return _listed(_county_totals(rows, keys), keys, "candidate", ties=False)


def precinct_table(rows: DataFrame, keys: list[str] = CONTEST) -> DataFrame:
    """Precincts of contests with two to four candidates: winning party or Tie, votes, shares."""
    return _wide(_precinct_totals(rows, keys), keys, "party", ties=True)


def precinct_table_listed(rows: DataFrame, keys: list[str] = CONTEST) -> DataFrame:
    return _listed(_precinct_totals(rows, keys), keys, "party", ties=True)


def precinct_counts(rows: DataFrame, keys: list[str] = CONTEST) -> DataFrame:
    """How many (county, precinct) units each contest has."""
    return rows.select(*keys, "county", "precinct").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_units"))


def detail_table(rows: DataFrame, keys: list[str] = CONTEST) -> DataFrame:
    """Precinct and county detail of every contest, with its number of units for callers that choose by size."""
    precincts = precinct_table(rows, keys).withColumn("detail", F.lit("Precinct"))
    both = precincts.unionByName(county_table(rows, keys).withColumn("detail", F.lit("County")))
    return both.join(precinct_counts(rows, keys), keys)


def primary_rank(rows: DataFrame, keys: list[str] = CONTEST) -> DataFrame:
    """Candidates of each contest by share of its votes; the rank becomes the colour family IND1, IND2, ..."""
    return win.ranked_candidates(rows, keys)


def map_rows(rows: DataFrame, keys: list[str] = CONTEST) -> DataFrame:
    """Rows as the maps colour them: a primary shows the rank of its candidates, whatever their party.

    Ranks are taken for every contest, not just primaries, so that both sides read the same rows and share one scan and
    shuffle; there is one rank per contest and candidate, small enough for Spark to broadcast after checking its size.
    """
    ranks = primary_rank(rows, keys).select(*keys, "candidate", F.col("party").alias("_rank"))
    ranked = nullsafe_join(rows, ranks, [*keys, "candidate"], "left", never_null=keys)
    party = F.when(F.col("election") == "primary", F.col("_rank")).otherwise(F.col("party"))
    return ranked.withColumn("party", party).drop("_rank")


def _painted(units: DataFrame) -> DataFrame:
    return units.withColumns(
        {
            "ramp_t": ramp_position("winning_share"),
            "fill_col": ramp_fill("winner", "winning_share"),
        }
    )


def county_map_results(rows: DataFrame, keys: list[str] = CONTEST) -> DataFrame:
    """Winning party, share, label and fill of every county in every contest."""
    summed = win.totals(rows, [*keys, "county"])  # ranks are joined to sums, not to rows
    long = win.totals(map_rows(summed, keys), [*keys, "county"])
    units = win.unit_winners(long, [*keys, "county"], ties=False, extra=[win.vote_label().alias("label")])
    return _painted(units)


def county_map(rows: DataFrame, counties: DataFrame, keys: list[str] = CONTEST) -> DataFrame:
    """County shapes with their results; counties without results stay, with no contest and no fill.

    A county has one result row per contest, so no county is a hot join key.
    """
    shapes = counties.withColumn("county", F.lower("name"))
    return shapes.join(county_map_results(rows, keys), "county", "left")


def precinct_map_results(rows: DataFrame, fips: DataFrame, keys: list[str] = CONTEST) -> DataFrame:
    """Winner or Tie, share, label, fill and shape codes of every precinct of every contest, whatever its size."""
    unit = [*keys, "county", "precinct"]
    shown = win.counted(map_rows(rows, keys), unit)
    units = _painted(win.unit_winners(shown, unit, extra=[win.vote_label(F.col("n")).alias("label")]))
    coded = units.join(fips, "county", "left")
    return coded.withColumns(
        {
            "vtdst": voting_district("precinct"),
            "countyfp": county_fips("fips"),
            "layer": layer_for_year(F.col("year"), PRECINCT_LAYERS),
        }
    )


def precinct_map(rows: DataFrame, fips: DataFrame, precinct_shapes: DataFrame, keys: list[str] = CONTEST) -> DataFrame:
    """Precinct results on the shapes of the layer that was in force in the election year."""
    results = precinct_map_results(rows, fips, keys)
    return results.join(precinct_shapes, ["layer", "countyfp", "vtdst"])


def shown_extent(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """Box around the shapes that carry a fill; a contest with none has no row."""
    return shapes.filter(F.col("fill_col").isNotNull()).groupBy(*keys).agg(*bbox_columns())


def candidate_columns(rows: DataFrame, unit: list[str], candidates: list[str]) -> DataFrame:
    """Votes per unit with one column per named candidate."""
    return win.totals(rows, unit, party=False).groupBy(*unit).pivot("candidate", candidates).agg(F.first("votes"))


def election_years(election_data: DataFrame) -> DataFrame:
    """Years, newest first, with the newest marked as the default."""
    years = election_data.select("year").distinct()
    latest = years.agg(F.max("year").alias("latest"))
    # One row per year and a single-row maximum, both tiny after the aggregation.
    marked = years.join(latest, F.col("year") == F.col("latest"), "left")
    return marked.select("year", F.col("latest").isNotNull().cast("int").alias("is_default")).orderBy(F.desc("year"))


def election_types(election_data: DataFrame) -> DataFrame:
    return election_data.select("year", "election").distinct().select("year", title_case("election").alias("election"))


def contest_counties(election_data: DataFrame) -> DataFrame:
    return election_data.select(*CONTEST, F.lower("county").alias("county")).distinct()
