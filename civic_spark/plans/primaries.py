"""Party of primary candidates: resolution by precedence, coverage, worksheets, and the split of a primary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import name_key, party_code, party_in_race_name
from ..functions.offices import OTHER_OFFICE, PARTISAN_LEVELS, with_office
from ..functions.semantics import not_in
from ..operators.dedupe import merge_overrides
from ..operators.joins import nullsafe_join
from ..operators.reshape import crosstab
from ..operators.winners import totals
from .choices import EVERYONE, UNLABELED
from .elections import CONTEST

PRIMARY_PARTIES = ["DEM", "REP"]
SOURCES = ["manual_cand", "manual_race", "nonpartisan", "suffix", "general", "race_inferred", "unresolved"]
CANDIDATE = ["year", "race", "candidate"]
PRIMARY = [*CONTEST, "token"]  # one party's primary, or what is shown for everyone


def race_crosswalk(races: DataFrame) -> DataFrame:
    """Every distinct race text with its office level, office, district and jurisdiction."""
    classified = with_office(races.select("race").distinct(), "race")
    return classified.select("race", "office_level", "office", "district", "jurisdiction")


def crosswalk_by_level(crosswalk: DataFrame) -> DataFrame:
    return crosswalk.groupBy("office_level").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "office_level")


def crosswalk_by_office(crosswalk: DataFrame) -> DataFrame:
    counted = crosswalk.groupBy("office", "office_level").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "office", "office_level")


def crosswalk_catch_all(crosswalk: DataFrame, n: int = 25) -> DataFrame:
    """The first races that no pattern recognised."""
    return crosswalk.filter(F.col("office") == OTHER_OFFICE).select("race").orderBy("race").limit(n)


def crosswalk_district_sample(crosswalk: DataFrame, n: int = 15) -> DataFrame:
    """A repeatable random handful of races with a district number."""
    numbered = crosswalk.filter(F.col("district").isNotNull()).select("race", "office", "district")
    return numbered.orderBy(F.md5("race"), "race").limit(n)


def resolve_parties(election_data: DataFrame, race_lookup: DataFrame, overrides: DataFrame) -> DataFrame:
    """Party and its source for every primary candidate; the first signal in ``SOURCES`` that speaks wins.

    The results are read once: a flagged aggregate by (year, race, candidate) says who stood in a primary and under
    which major parties in a general election. The signals of a person, over all spellings of a name in an office and district, and
    of a race are windows over these reduced rows: a person's spellings, a race's ballot.
    """
    general = (F.col("election") == "general") & F.col("party").isin(*PRIMARY_PARTIES)
    held = F.when(general, F.col("party"))
    people = election_data.filter((F.col("election") == "primary") | general)
    people = people.groupBy(*CANDIDATE).agg(
        F.bool_or(F.col("election") == "primary").alias("in_primary"), F.min(held).alias("low"), F.max(held).alias("high")
    )
    crosswalk = race_lookup.select("race", "office", "office_level", "district")
    keyed = nullsafe_join(people, crosswalk, ["race"], "left").withColumn("nkey", name_key("candidate"))
    person = Window.partitionBy("year", "office", "district", "nkey")
    least, most = F.min("low").over(person), F.max("high").over(person)
    keyed = keyed.withColumn("general_cand", F.when(F.col("year").isNotNull() & (least == most), least))
    ballot = Window.partitionBy("year", "race")
    first, last = F.min("general_cand").over(ballot), F.max("general_cand").over(ballot)
    primary = keyed.filter("in_primary").withColumn("race_party", F.when(first == last, first))

    by_candidate = overrides.filter(F.col("candidate") != "").select(*CANDIDATE, F.col("party").alias("mc")).distinct()
    by_race = overrides.filter(F.col("candidate") == "").select("year", "race", F.col("party").alias("mr")).distinct()
    joined = nullsafe_join(primary, by_candidate, CANDIDATE, "left", never_null=["year"])
    joined = nullsafe_join(joined, by_race, ["year", "race"], "left", never_null=["year"])

    open_race = not_in("office_level", PARTISAN_LEVELS)
    signals = [
        (F.col("mc").isNotNull(), F.col("mc"), "manual_cand"),
        (F.col("mr").isNotNull(), F.col("mr"), "manual_race"),
        (open_race, F.lit(None).cast("string"), "nonpartisan"),
        (party_in_race_name("race").isNotNull(), party_in_race_name("race"), "suffix"),
        (F.col("general_cand").isNotNull(), F.col("general_cand"), "general"),
        (F.col("race_party").isNotNull(), F.col("race_party"), "race_inferred"),
    ]
    party = source = None
    for applies, value, name in signals:
        party = F.when(applies, value) if party is None else party.when(applies, value)
        source = F.when(applies, name) if source is None else source.when(applies, name)
    return joined.select(
        *CANDIDATE, "office", "office_level", party.alias("party"), source.otherwise("unresolved").alias("source")
    )


def coverage_by_source(lookup: DataFrame) -> DataFrame:
    return crosstab(lookup, ["year"], "source", SOURCES)


def coverage_resolved(lookup: DataFrame) -> DataFrame:
    partisan = lookup.filter(F.col("office_level").isin(*PARTISAN_LEVELS))
    return partisan.groupBy("year").agg(
        F.count_if(F.col("party").isNull()).alias("unresolved"), F.count_if(F.col("party").isNotNull()).alias("resolved")
    )


def coverage_elections(lookup: DataFrame) -> DataFrame:
    elections = lookup.filter(F.col("party").isNotNull()).select("year", "race", "party").distinct()
    return elections.groupBy("year").agg(F.count(F.lit(1)).alias("elections"))


def unresolved_candidates(lookup: DataFrame) -> DataFrame:
    """Partisan candidates without a party, as a worksheet to fill in."""
    rows = lookup.filter(F.col("office_level").isin(*PARTISAN_LEVELS) & F.col("party").isNull())
    sheet = rows.select(*CANDIDATE, "office", F.lit("").alias("party"), F.col("source").alias("note"))
    return sheet.orderBy("year", F.col("office").asc_nulls_last(), "race", "candidate")


def worksheet_seed(lookup: DataFrame) -> DataFrame:
    """First override worksheet: whole races where nobody is resolved, single candidates elsewhere."""
    partisan = F.col("office_level").isin(*PARTISAN_LEVELS)
    races = lookup.groupBy("year", "race").agg(
        F.bool_or(F.col("party").isNotNull()).alias("any_resolved"),
        F.bool_or(F.coalesce(partisan, F.lit(False))).alias("partisan"),
    )
    races = races.filter("partisan")
    whole = races.filter(~F.col("any_resolved")).select("year", "race", F.lit("").alias("candidate"), F.lit("").alias("party"))
    partly = nullsafe_join(lookup, races.filter("any_resolved"), ["year", "race"], "left_semi", never_null=["year"])
    single = partly.filter(partisan & F.col("party").isNull()).select(*CANDIDATE, F.lit("").alias("party"))
    return whole.unionByName(single).orderBy(*CANDIDATE)


def filled_worksheet(todo: DataFrame) -> DataFrame:
    """Hand-filled rows with a recognised party."""
    return todo.select(*CANDIDATE, party_code("party").alias("party")).filter(F.col("party").isNotNull())


def merged_overrides(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Overrides after adding new resolutions; the longest party text per key wins, old before new."""
    existing = current.withColumn("candidate", F.coalesce("candidate", F.lit("")))
    return merge_overrides(existing, incoming, CANDIDATE).orderBy(*CANDIDATE)


def primary_split(rows: DataFrame, party_lookup: DataFrame) -> DataFrame:
    """Primary rows under each token they are shown for: a party, unlabeled, and everyone.

    A party keeps its own candidates and stamps their party; the other two leave the row as it is.
    """
    primary = rows.filter(F.col("election") == "primary")
    known = party_lookup.select(*CANDIDATE, F.col("party").alias("known_party"))
    marked = nullsafe_join(primary, known, CANDIDATE, "left", never_null=["year", "race"])
    own = F.when(F.col("known_party").isin(*PRIMARY_PARTIES), F.col("known_party")).when(
        F.col("known_party").isNull(), UNLABELED
    )
    tokens = F.array_compact(F.array(own, F.lit(EVERYONE)))
    shown = marked.withColumn("token", F.explode(tokens))
    stamped = F.when(F.col("token").isin(*PRIMARY_PARTIES), F.col("known_party")).otherwise(F.col("party"))
    return shown.withColumn("party", stamped).drop("known_party")


def primary_result(split: DataFrame) -> DataFrame:
    """Votes per candidate under each token of each primary."""
    return totals(split, PRIMARY, party=False)


def picked(split: DataFrame, token: str) -> DataFrame:
    """Rows of a split primary for one pick; a pick that has no rows of its own, such as a third party, shows everyone."""
    return split.filter(F.col("token") == (token if token in (*PRIMARY_PARTIES, UNLABELED) else EVERYONE))
