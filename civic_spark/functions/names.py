"""Name and party normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .semantics import as_col, na_paste, squish

# Accepted spellings of each party.
PARTY_SPELLINGS = {
    "REP": ["REP", "REPUBLICAN", "R"],
    "DEM": ["DEM", "DEMOCRAT", "DEMOCRATIC", "D"],
    "IND": ["IND", "INDEPENDENT", "I"],
}

# What a name key leaves out (running mate, nickname, punctuation), and words of a party in a race's name.
RUNNING_MATE, NICKNAME, PUNCTUATION = r"/.*$", r'"[^"]*"', r"[.,]"
RACE_WORDS = {"DEM": "DEMOCRAT", "REP": "REPUBLIC"}

# Display names of the two parties that have their own primaries.
PARTY_LABELS = {"DEM": "Democratic", "REP": "Republican"}


def name_key(name: Column | str) -> Column:
    """Match key of a person: no running mate, nickname or punctuation; one space; upper case."""
    head = F.regexp_replace(as_col(name), RUNNING_MATE, "")
    plain = F.regexp_replace(F.regexp_replace(head, NICKNAME, " "), PUNCTUATION, " ")
    return F.upper(squish(plain))


def first_last(key: Column | str) -> Column:
    """First and last token of a key; a single token stands for itself."""
    tokens = F.split(as_col(key), " ")
    return F.when(F.size(tokens) >= 2, F.concat_ws(" ", F.get(tokens, F.lit(0)), F.element_at(tokens, -1))).otherwise(
        as_col(key)
    )


def party_in_race_name(race: Column | str) -> Column:
    upper = F.upper(as_col(race))
    return F.when(upper.rlike(RACE_WORDS["DEM"]), "DEM").when(upper.rlike(RACE_WORDS["REP"]), "REP")


def party_code(text: Column | str) -> Column:
    """REP, DEM or IND for a recognised spelling, NULL for anything else."""
    cleaned = F.upper(F.trim(as_col(text)))
    code = F.lit(None).cast("string")
    for party, spellings in PARTY_SPELLINGS.items():
        code = F.when(cleaned.isin(*spellings), party).otherwise(code)
    return code


def party_label(code: Column | str) -> Column:
    code = as_col(code)
    lookup = F.create_map(*[F.lit(x) for pair in PARTY_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, code), code)


def payer_identity(organization: str, first: str, last: str, address: str | None = None) -> Column:
    """Organisation if there is one, else the person (with address if given), else NULL."""
    person = na_paste(first, last, address) if address else na_paste(first, last)
    return (
        F.when(F.col(organization).isNull() & F.col(last).isNull(), None)
        .when(F.col(organization).isNull(), person)
        .otherwise(F.col(organization))
    )
