"""Party resolution, worksheets, roster matching and pick lists."""

from __future__ import annotations

import pytest

from civic_spark.operators.dedupe import first_row_per
from civic_spark.plans import choices, elections, primaries, rosters

from .test_elections import SCHEMA, row

LOOKUP = "race STRING, office STRING, office_level STRING, district STRING, jurisdiction STRING"
OVERRIDES = "year INT, race STRING, candidate STRING, party STRING"


def prim(candidate, race):
    return row("x", "1", candidate, "primary", 1, race=race, election="primary")


def gen(candidate, race, party):
    return row("x", "1", candidate, party, 1, race=race)


@pytest.fixture()
def lookup(frame):
    return frame(
        LOOKUP,
        ("GOV", "Governor", "state_exec", None, None),
        ("SEN 5", "State Senate", "state_leg", "5", None),
        ("SHERIFF - DEMOCRATIC", "Sheriff", "county", None, None),
        ("JUDGE", "Judge", "judicial", None, None),
        ("CLERK", "County Clerk", "county", None, None),
    )


@pytest.fixture()
def results(frame):
    return frame(
        SCHEMA,
        prim("Ann A. / Mate", "GOV"),
        prim("Bob", "GOV"),
        prim("Both", "GOV"),
        prim("Dee", "SHERIFF - DEMOCRATIC"),
        prim("Jay", "JUDGE"),
        prim('Sue "S" Lee', "SEN 5"),
        prim("New", "SEN 5"),
        prim("Eve", "UNKNOWN RACE"),
        prim("Kim", "CLERK"),
        gen("ANN A", "GOV", "DEM"),
        gen("Both", "GOV", "REP"),
        gen("Both", "GOV", "DEM"),
        gen("Sue Lee", "SEN 5", "REP"),
        gen("Kim", "GOV", "REP"),
    )


@pytest.fixture()
def overrides(frame):
    return frame(OVERRIDES, (2020, "GOV", "Bob", "REP"))


def test_precedence(frame, results, lookup, overrides):
    got = {r.candidate: (r.party, r.source) for r in primaries.resolve_parties(results, lookup, overrides).collect()}
    assert got == {
        "Ann A. / Mate": ("DEM", "general"),
        "Bob": ("REP", "manual_cand"),
        "Both": ("DEM", "race_inferred"),  # two parties in November, but the rest of the race is one party
        "Dee": ("DEM", "suffix"),
        "Jay": (None, "nonpartisan"),
        'Sue "S" Lee': ("REP", "general"),
        "New": ("REP", "race_inferred"),
        "Eve": (None, "nonpartisan"),
        "Kim": (None, "unresolved"),
    }


def test_whole_race_override_and_candidate_override(frame, results, lookup):
    both = frame(OVERRIDES, (2020, "GOV", "", "IND"), (2020, "GOV", "Bob", "DEM"))
    got = {r.candidate: (r.party, r.source) for r in primaries.resolve_parties(results, lookup, both).filter("race = 'GOV'").collect()}
    assert got["Bob"] == ("DEM", "manual_cand") and got["Both"] == ("IND", "manual_race")


def test_reports_and_worksheets(results, lookup, overrides):
    table = primaries.resolve_parties(results, lookup, overrides)
    counts = primaries.coverage_by_source(table).first()
    assert sum(counts[s] for s in primaries.SOURCES) == 9
    assert tuple(primaries.coverage_resolved(table).first()) == (2020, 1, 6)
    assert [r.candidate for r in primaries.unresolved_candidates(table).collect()] == ["Kim"]
    assert [tuple(r) for r in primaries.worksheet_seed(table).collect()] == [(2020, "CLERK", "", "")]


def test_override_merge(frame):
    current = frame(OVERRIDES, (2020, "A", None, ""), (2020, "A", "x", "REP"), (2020, "B", "y", None))
    incoming = frame(OVERRIDES, (2020, "A", "", "DEM"), (2020, "A", "x", "DEM"), (2020, "C", "z", "IND"))
    got = {(r.race, r.candidate): r.party for r in primaries.merged_overrides(current, incoming).collect()}
    assert got == {("A", ""): "DEM", ("A", "x"): "REP", ("B", "y"): None, ("C", "z"): "IND"}


def test_first_row_per_key(frame):
    rows = frame("k STRING, o INT, v STRING", ("a", 2, "late"), ("a", 1, "early"), ("b", 1, None))
    assert {tuple(r) for r in first_row_per(rows, ["k"], [rows.o]).collect()} == {("a", 1, "early"), ("b", 1, None)}


def test_split(frame, results, lookup, overrides):
    table = primaries.resolve_parties(results, lookup, overrides)
    split = primaries.primary_split(elections.contest_rows(results), table)
    by_token = {}
    for r in split.filter("race = 'GOV'").collect():
        by_token.setdefault(r.token, set()).add((r.candidate, r.party))
    assert by_token["REP"] == {("Bob", "REP")}
    assert by_token["DEM"] == {("Ann A. / Mate", "DEM"), ("Both", "DEM")}
    assert by_token["__ALL__"] == {("Ann A. / Mate", "primary"), ("Bob", "primary"), ("Both", "primary")}
    assert [(r.candidate, r.party) for r in split.filter("race = 'CLERK' AND token = '__UNLABELED__'").collect()] == [("Kim", "primary")]


def test_roster_of_the_year(frame):
    """Each year is matched against the roster that was valid in it; a year can be picked."""
    unresolved = frame("year INT, race STRING, candidate STRING, office STRING", *[(y, "r", "Ann Lee", "Sheriff") for y in (2022, 2024, 2026)])
    roster = frame(
        "year INT, office_bp STRING, candidate STRING, party STRING",
        (2024, "Sheriff", "Ann Lee", "REP"), (2026, "Sheriff", "Ann Lee", "DEM"), (2020, "Sheriff", "Ann Lee", "IND"),
    )
    every = {r.year: r.party for r in rosters.roster_status(unresolved, roster).collect()}
    assert every == {2022: None, 2024: "REP", 2026: "DEM"}
    assert [(r.year, r.party) for r in rosters.roster_status(unresolved, roster, year=2024).collect()] == [(2024, "REP")]


def test_roster_tiers(frame):
    unresolved = frame(
        "year INT, race STRING, candidate STRING, office STRING",
        (2026, "r1", "Ann Q. Lee", "Sheriff"),
        (2026, "r1", "Bob M Ray", "Sheriff"),
        (2026, "r1", "Two Face", "Sheriff"),
        (2026, "r2", "Ann Q. Lee", "Mayor"),
    )
    roster = frame(
        "year INT, county STRING, office_bp STRING, candidate STRING, party STRING",
        (2026, "x", "County Sheriff", "ANN Q LEE", "REP"),
        (2026, "y", "County Sheriff", "Ann Q Lee", "REP"),
        (2026, "x", "County Sheriff", "Bob Ray", "DEM"),
        (2026, "x", "County Sheriff", "Two Face", "DEM"),
        (2026, "x", "County Sheriff", "Two Face", "REP"),
        (2024, "x", "County Sheriff", "Two Face", "REP"),
    )
    status = rosters.roster_status(unresolved, roster)
    assert {(r.race, r.candidate): r.party for r in status.collect()} == {
        ("r1", "Ann Q. Lee"): "REP", ("r1", "Bob M Ray"): "DEM", ("r1", "Two Face"): None, ("r2", "Ann Q. Lee"): None,
    }
    assert rosters.matched_candidates(status).count() == 2
    assert tuple(rosters.match_rate(status).first()) == (2026, 4, 2, 50.0)
    assert [tuple(r) for r in rosters.matched_by_office(status).collect()] == [("Sheriff", 2)]
    assert {tuple(r) for r in rosters.unmatched_by_office(status).collect()} == {("Sheriff", 1), ("Mayor", 1)}


def test_choice_order_and_fallback(frame, lookup):
    races = frame(SCHEMA, *[gen("a", r, "REP") for r in ("zzz unknown", "SEN 5", "GOV", "CLERK")])
    got = [(r.group_label, r.item_rank, r.value) for r in choices.election_choices(races, lookup).orderBy("group_rank", "item_rank").collect()]
    assert got == [
        ("Statewide (Executive)", 1, "GOV"), ("State Legislature", 1, "SEN 5"), ("County Offices", 1, "CLERK"), ("Local", 1, "zzz unknown"),
    ]


def test_numeric_district_order(frame):
    rows = frame(
        "k INT, value STRING, label STRING, office_level STRING, office STRING, district STRING",
        (1, "b", "b", "state_leg", "State Senate", "10"), (1, "a", "a", "state_leg", "State Senate", None),
        (1, "c", "c", "state_leg", "State Senate", "9"),
    )
    assert [r.value for r in choices.grouped_choices(rows, ["k"]).orderBy("item_rank").collect()] == ["c", "b", "a"]


def test_primary_choices(results, lookup, overrides):
    table = primaries.resolve_parties(results, lookup, overrides)
    labels = {r.label for r in choices.primary_choices(table, lookup).collect()}
    assert {"GOV (Republican)", "GOV (Democratic)", "CLERK (Unlabeled)", "JUDGE", "UNKNOWN RACE"} <= labels


def test_each_partys_primary_has_its_own_results(frame):
    schema = "year INT, election STRING, race STRING, county STRING, precinct STRING, candidate STRING, party STRING, votes BIGINT"
    place = (2024, "primary", "R", "x", "A101")
    rows = frame(schema, (*place, "ANN", None, 9), (*place, "BOB", None, 4), (*place, "CAT", None, 6), (*place, "DAN", None, 5))
    known = [(2024, "R", "ANN", "DEM"), (2024, "R", "BOB", "DEM"), (2024, "R", "CAT", "REP"), (2024, "R", "DAN", "REP")]
    split = primaries.primary_split(rows, frame("year INT, race STRING, candidate STRING, party STRING", *known))
    table = {r.token: (r.winner, r.total_votes, r.n_candidates) for r in elections.county_table(split, primaries.PRIMARY).collect()}
    assert table == {"DEM": ("ANN", 13, 2), "REP": ("CAT", 11, 2), "__ALL__": ("ANN", 24, 4)}
    ranks = {(r.token, r.candidate): r.party for r in elections.primary_rank(split, primaries.PRIMARY).collect()}
    assert ranks["REP", "CAT"] == "IND1" and ranks["__ALL__", "CAT"] == "IND2"
    shown = {r.token: r.winner for r in elections.county_map_results(split, primaries.PRIMARY).collect()}
    assert shown == {"DEM": "IND1", "REP": "IND1", "__ALL__": "IND1"}
    assert primaries.picked(split, "REP").count() == 2
    assert {r.candidate for r in primaries.picked(split, "IND").collect()} == {"ANN", "BOB", "CAT", "DAN"}
