"""Bills, sponsors, votes and actions on small tables."""

from __future__ import annotations

import datetime

import pytest

from civic_spark.plans import legislation as leg

S = "2022 General Assembly"


@pytest.fixture()
def bills(frame):
    schema = "session STRING, bill_num STRING, title STRING, bill_summary STRING, last_action STRING, passed_house STRING, passed_senate STRING, passed STRING"
    return frame(
        schema,
        (S, "hb10", "Ten", "s", "a", "1", "0", "0"),
        (S, "hb2", "Two", "s", "a", "1", None, "x"),
        (S, "sb1", "One", "s", "a", "0", "0", "0"),
        (S, "hb3", "Three", "s", "a", "0", "0", "0"),
    )


@pytest.fixture()
def legislators(frame):
    return frame(
        "legislator_id BIGINT, name STRING, full_name STRING, party STRING, chamber STRING, district INT, img_src STRING, lrc_link STRING, ga_21 STRING, ga_22 STRING",
        (1, "Ann", "Ann A", "Democratic", "house", 1, None, "l", "0", "1"),
        (2, "Bob", "Bob B", "Republican", "senate", 2, "i", "l", "1", "x"),
        (3, "Cy", "Cy C", None, "house", 3, "i", "l", None, "1"),
        (4, "Di", "Di D", "Independent", "house", 4, "i", "l", "1", "1"),
    )


@pytest.fixture()
def sponsors(frame):
    return frame(
        "session STRING, bill_num STRING, legislator_id BIGINT, chief_sponsor STRING",
        (S, "hb10", 1, "0"), (S, "hb10", 2, "1"), (S, "hb10", 3, "0"), (S, "sb1", 3, "1"), (S, "hb3", 4, "1"), (S, "hb3", 99, "0"),
    )


def test_overview(bills, sponsors, legislators):
    got = {r.bill_num: r for r in leg.bill_overview(bills, sponsors, legislators).collect()}
    assert got["hb10"].spon_list == "Ann|Democratic;Bob|Republican;Cy"
    assert (got["hb10"].Democratic, got["hb10"].Republican) == (1, 1)
    assert (got["hb2"].spon_list, got["hb2"].Democratic) == (None, None)  # no sponsor at all
    assert (got["sb1"].spon_list, got["sb1"].Democratic) == (None, None)  # none with a known party
    assert (got["hb3"].spon_list, got["hb3"].Democratic) == (";Di|Independent", 0)
    assert (got["hb2"].passed_house, got["hb2"].passed) == (1, None)


def test_order_is_numeric(bills, sponsors, legislators):
    assert [r.bill_num for r in leg.bill_list(bills, "house").collect()] == ["hb2", "hb3", "hb10"]
    assert [r.bill_num for r in leg.bill_list(bills, "senate").collect()] == ["sb1"]


def test_sponsor_list_and_header(bills, sponsors, legislators):
    shown = {r.bill_num: r for r in leg.sponsor_list(leg.bill_overview(bills, sponsors, legislators)).collect()}
    assert (shown["hb10"].sponsor_text, shown["hb10"].sponsor_colors) == ("Ann, Bob, Cy", "blue, red, none")
    header = {r.bill_num: r.sponsors for r in leg.bill_header(bills, sponsors, legislators).collect()}
    assert header == {"hb10": "Bob*, Ann, NA", "hb2": "", "sb1": "NA", "hb3": "NANA"}


def test_votes(frame, legislators):
    votes = frame(
        "session STRING, bill_num STRING, legislator_id BIGINT, vote STRING, chamber STRING",
        (S, "hb10", 1, "YEA", "house"), (S, "hb10", 2, "NAY", "house"), (S, "hb10", 3, "YEA", "house"), (S, "hb10", 77, "NV", "house"),
    )
    summary = [(r.vote, r.Total, r.Democratic, r.Republican, r.no_party) for r in leg.vote_summary(votes, legislators).collect()]
    assert summary == [("YEA", 2, 1, 0, 1), ("NAY", 1, 0, 1, None), ("NV", 1, 0, 0, 1)]
    calls = [(r.name, r.vote_shown) for r in leg.roll_call(votes, legislators).collect()]
    assert calls == [("Ann", "✔️ YEA"), ("Bob", "❌ NAY"), ("Cy", "✔️ YEA"), (None, "NV")]
    own = {r.legislator_id: (r.bill_num, r.vote, r.vote_shown) for r in leg.legislator_votes(votes).collect()}
    assert own[77] == ("HB10", "NV", "❌ NAY")


def test_members_profiles_sponsorships(bills, sponsors, legislators):
    assert {r.label for r in leg.session_legislators(sponsors, legislators).collect()} == {"Ann (house)", "Cy (house)", "Di (house)"}
    assert leg.legislator_profile(legislators).count() == 4
    mine = {(r.bill_num, r.title) for r in leg.legislator_sponsorships(sponsors, bills).filter("legislator_id = 2").collect()}
    assert mine == {("HB10*", "Ten")}
    assert [r.session for r in leg.session_list(sponsors).collect()] == [S]


def test_actions(frame):
    day = datetime.date
    actions = frame(
        "session STRING, bill_num STRING, date DATE, action STRING, seq BIGINT",
        (S, "hb1", day(2022, 1, 5), "first", 1), (S, "hb1", day(2022, 1, 5), "second", 2), (S, "hb1", day(2021, 12, 1), "early", 0),
        ("2022 Special Session 2", "hb9", day(2022, 6, 1), "x", 3),
    )
    assert [r.action for r in leg.bill_actions(actions).filter("bill_num = 'hb1'").collect()] == ["second", "first", "early"]
    assert [(r.session, r.date.year) for r in leg.action_days(actions).collect()] == [(S, 2022)]
    assert {(r.bill_num, r.n_actions) for r in leg.actions_by_day_groups(actions).collect()} == {("HB1", 2), ("HB1", 1), ("HB9", 1)}
    assert leg.actions_by_day(actions).count() == 4


def test_links_and_banner(frame, bills):
    assert leg.bill_links(bills.filter("bill_num = 'hb2'")).first().link.endswith("/record/22rs/HB2.html")
    banner = frame("update_day DATE", (datetime.date(2025, 3, 4),))
    assert leg.last_update(banner).first()[0] == "Last Update: March 4, 2025"
    marks = frame("f INT", (1,), (0,), (None,)).select(leg.passed_mark("f")).collect()
    assert [r[0] for r in marks] == ["✔️", "❌", None]
