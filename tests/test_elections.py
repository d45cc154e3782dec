"""Winners, ties, slots and maps on small elections."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from civic_spark.operators import winners as win
from civic_spark.operators.joins import layer_for_year
from civic_spark.plans import elections

from .conftest import dicts

SCHEMA = "year INT, election STRING, race STRING, county STRING, precinct STRING, candidate STRING, party STRING, votes BIGINT"


def row(county, precinct, candidate, party, votes, race="R", year=2020, election="general"):
    return (year, election, race, county, precinct, candidate, party, votes)


@pytest.fixture()
def results(frame):
    return frame(
        SCHEMA,
        row("adair", "A101", "ANN", "REP", 10),
        row("adair", "A101", "ANN", "REP", 10),  # exact duplicate
        row("adair", "A101", "BOB", "DEM", 10),  # tied precinct
        row("adair", "A102", "ANN", "REP", 0),
        row("adair", "A102", "BOB", "DEM", 0),  # all-zero precinct
        row("adair", "county", "ANN", "REP", 5),
        row("boone", "B101", "ANN", "REP", 3),
        row("boone", "B101", "BOB", "DEM", None),
        row("boone", "B102", "BOB", "DEM", 7),
    )


def test_duplicates_and_filters(results):
    assert elections.contest_rows(results).count() == 8
    assert elections.contest_rows(results, counties=["BOONE"], election="General").count() == 3


def test_missing_votes_make_the_total_missing(results):
    got = {r.candidate: r.votes for r in elections.contest_result(elections.contest_rows(results)).collect()}
    assert got == {"ANN": 18, "BOB": None}


def test_county_table_names_the_first_of_equals(frame):
    rows = frame(SCHEMA, row("x", "1", "BOB", "DEM", 5), row("x", "1", "ANN", "REP", 5))
    got = dicts(elections.county_table(rows), "winner", "total_votes", "can1", "can1_votes", "can1_pct", "can1_total", "can3")
    assert got == [
        {"winner": "ANN", "total_votes": 10, "can1": "ANN", "can1_votes": 5, "can1_pct": 0.5, "can1_total": 5, "can3": None}
    ]


def test_precinct_table_ties_zero_and_missing(results):
    got = {r.unit: r for r in elections.precinct_table(elections.contest_rows(results)).collect()}
    assert set(got) == {"ADAIR - A101", "ADAIR - A102", "BOONE - B101", "BOONE - B102"}
    assert got["ADAIR - A101"].winner == "Tie"
    assert got["ADAIR - A102"].winner == "Tie" and got["ADAIR - A102"].can1_pct is None
    assert got["BOONE - B101"].winner is None and got["BOONE - B101"].total_votes is None
    assert got["BOONE - B102"].winner == "DEM" and got["BOONE - B102"].can1_votes is None


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_wide_for_two_to_four_listed_otherwise(frame, n):
    rows = frame(SCHEMA, *[row("x", "1", f"C{i}", "IND", i) for i in range(n)])
    wide, listed = elections.county_table(rows).count(), elections.county_table_listed(rows).count()
    assert (wide, listed) == ((1, 0) if 2 <= n <= 4 else (0, n))


def test_slots_follow_first_appearance(frame):
    rows = frame(SCHEMA, row("b", "1", "ANN", "REP", 1), row("a", "1", "ZED", "DEM", 1), row("b", "1", "ZED", "DEM", 1))
    long = win.totals(rows, [*elections.CONTEST, "county"])
    slots = {r.candidate: r.slot for r in win.candidate_slots(long, elections.CONTEST, "county").collect()}
    assert slots == {"ZED": 1, "ANN": 2}


def test_every_unit_has_one_winner_and_totals_agree(frame):
    rows = frame(SCHEMA, *[row(f"c{i % 7}", f"p{i % 3}", f"C{i % 4}", f"P{i % 4}", i) for i in range(200)])
    once = elections.contest_rows(rows)
    units = win.unit_winners(win.totals(once, [*elections.CONTEST, "county"]), [*elections.CONTEST, "county"])
    assert units.count() == 7 and units.filter("winning_share NOT BETWEEN 0 AND 1").count() == 0
    total = once.agg(F.sum("votes")).first()[0]
    assert units.agg(F.sum("total_votes")).first()[0] == total


def test_winner_matches_brute_force(frame):
    import random

    random.seed(5)
    data = [(u, f"C{i}", f"P{i % 3}", random.choice([None, 0, 1, 2, 3, 3])) for u in range(300) for i in range(random.randint(1, 5))]
    units = {r.u: r for r in win.unit_winners(frame("u INT, candidate STRING, party STRING, votes BIGINT", *data), ["u"]).collect()}
    for u in {d[0] for d in data}:
        mine = [d for d in data if d[0] == u]
        votes = [d[3] for d in mine]
        if None in votes:
            want = None
        else:
            top = [d for d in mine if d[3] == max(votes)]
            want = top[0][2] if len(top) == 1 else "Tie"
        assert units[u].winner == want, mine


def test_equal_rows_at_the_top_are_a_tie(frame):
    """Rows are counted: two equal ones at the top are no winner, and both stand in the label and the total."""
    data = [("a", "ANN", "IND1", 9), ("a", "ANN", "IND1", 9), ("a", "BOB", "IND2", 3), ("b", "ANN", "IND1", 9), ("b", "BOB", "IND2", 9), ("c", "ANN", "IND1", 9), ("c", "BOB", "IND2", 3), ("c", "BOB", "IND2", 3)]
    rows = win.counted(frame("u STRING, candidate STRING, party STRING, votes BIGINT", *data), ["u"])
    got = {r.u: r for r in win.unit_winners(rows, ["u"], extra=[win.vote_label(F.col("n")).alias("label")]).collect()}
    assert {u: (r.winner, r.winning_votes, r.total_votes) for u, r in got.items()} == {"a": ("Tie", 9, 21), "b": ("Tie", 9, 18), "c": ("IND1", 9, 15)}
    assert got["a"].label == "ANN: 9<br>ANN: 9<br>BOB: 3" and got["c"].label == "ANN: 9<br>BOB: 3<br>BOB: 3"


def test_a_primary_whose_rows_become_equal(frame):
    """Rows that differ in party only are equal once a primary shows ranks."""
    rows = frame(SCHEMA, row("adair", "A101", "ANN", "REP", 7, election="primary"), row("adair", "A101", "ANN", "DEM", 7, election="primary"), row("adair", "A101", "BOB", "DEM", 1, election="primary"))
    fips = frame("county STRING, fips BIGINT", ("adair", 21001))
    (unit,) = elections.precinct_map_results(elections.contest_rows(rows), fips).collect()
    assert (unit.winner, unit.winning_votes, unit.total_votes, unit.label) == ("Tie", 7, 15, "ANN: 7<br>ANN: 7<br>BOB: 1")


def test_a_ballot_of_any_length_comes_out_whole(frame):
    rows = frame(SCHEMA, *[row("x", "1", f"C{i}", "IND", i) for i in range(7)], row("x", "1", "C3", "REP", 5), row("y", "1", "C6", "IND", 2))
    units = {r.unit: r for r in win.ballots(win.totals(rows, [*elections.CONTEST, "county"]).withColumn("unit", F.col("county")), elections.CONTEST, "unit").collect()}
    assert [(b["slot"], b["candidate"], b["party"], b["votes"]) for b in units["x"].ballot] == sorted(
        [(i + 1, f"C{i}", "IND", i) for i in range(7)] + [(4, "C3", "REP", 5)], key=lambda t: (t[0], t[2])
    )
    assert units["x"].n_candidates == 7 and [(b["slot"], b["votes"], b["contest_votes"]) for b in units["y"].ballot] == [(7, 2, 8)]


def test_detail_keeps_contests_of_every_size(frame):
    rows = frame(
        SCHEMA,
        *[row("x", f"p{i}", c, "IND", i, race="big") for i in range(3) for c in "AB"],
        *[row("x", "p1", c, "IND", 1, race="small") for c in "AB"],
    )
    got = {(r.race, r.unit, r.detail, r.n_units) for r in elections.detail_table(rows).collect()}
    big = {("big", f"X - p{i}", "Precinct", 3) for i in range(3)} | {("big", "x", "County", 3)}
    assert got == big | {("small", "X - p1", "Precinct", 1), ("small", "x", "County", 1)}


def test_primary_rank_and_map_party(frame):
    rows = frame(
        SCHEMA,
        row("x", "1", "ANN", "REP", 5, election="primary"),
        row("x", "1", "BOB", "REP", 9, election="primary"),
        row("x", "1", "ANN", "REP", 5),
    )
    ranks = {r.candidate: r.party for r in elections.primary_rank(rows.filter("election = 'primary'")).collect()}
    assert ranks == {"BOB": "IND1", "ANN": "IND2"}
    assert {(r.election, r.candidate, r.party) for r in elections.map_rows(rows).collect()} == {
        ("primary", "ANN", "IND2"), ("primary", "BOB", "IND1"), ("general", "ANN", "REP"),
    }


def test_maps_keep_and_drop_shapes(frame, results):
    once = elections.contest_rows(results)
    box = "xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE"
    counties = frame(f"name STRING, {box}", ("Adair", 0.0, 0.0, 1.0, 1.0), ("Nowhere", 5.0, 5.0, 6.0, 6.0))
    shown = elections.county_map(once, counties)
    got = {r.name: r for r in shown.collect()}
    assert got["Nowhere"].fill_col is None and got["Adair"].winner == "REP"
    assert got["Adair"].label == "ANN: 15<br>BOB: 10"
    extent = elections.shown_extent(shown, elections.CONTEST).collect()
    assert [(r.xmin, r.xmax) for r in extent] == [(0.0, 1.0)]

    shapes = frame(
        f"layer STRING, name STRING, countyfp STRING, vtdst STRING, {box}",
        ("precincts", "Adair", "001", "00A101", 0.0, 0.0, 1.0, 1.0),
        ("precincts_22", "Adair", "001", "00A102", 0.0, 0.0, 1.0, 1.0),
    )
    fips = frame("county STRING, fips BIGINT", ("adair", 21001))
    got = elections.precinct_map(once, fips, shapes).collect()
    assert [(r.vtdst, r.winner, r.layer) for r in got] == [("00A101", "Tie", "precincts")]


def test_layers_by_year(frame):
    years = frame("y INT", (2018,), (2021,), (2022,), (2023,), (2024,), (2030,))
    got = [r[0] for r in years.select(layer_for_year(F.col("y"), elections.PRECINCT_LAYERS)).collect()]
    assert got == ["precincts", "precincts", "precincts_22", "precincts_24", "precincts_general_24", "precincts_general_24"]


def test_selectors(results):
    assert [tuple(r) for r in elections.election_years(results).collect()] == [(2020, 1)]
    assert [tuple(r) for r in elections.election_types(results).collect()] == [(2020, "General")]
    assert {r.county for r in elections.contest_counties(results).collect()} == {"adair", "boone"}
