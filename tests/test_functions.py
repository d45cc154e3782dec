"""Column expressions against hand-worked values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from civic_spark.functions import colors, formats, names, offices
from civic_spark.functions import semantics as sem


def one(frame, expr, kind, *values):
    """Values of an expression over a single column x."""
    rows = frame(f"i INT, x {kind}", *enumerate(values)).orderBy("i")
    return [r[0] for r in rows.select(expr).collect()]


def test_missing_values_in_sums(frame):
    rows = frame("k STRING, x BIGINT", ("a", 1), ("a", 2), ("b", 1), ("b", None))
    got = dict(rows.groupBy("k").agg(sem.na_sum("x")).collect())
    assert got == {"a": 3, "b": None}


def test_unanimous(frame):
    rows = frame("k STRING, x STRING", ("a", "REP"), ("a", "REP"), ("b", "REP"), ("b", "DEM"), ("c", "REP"), ("c", None))
    assert dict(rows.groupBy("k").agg(sem.unanimous("x")).collect()) == {"a": "REP", "b": None, "c": None}
    skipped = rows.groupBy("k").agg(sem.unanimous("x", skip_nulls=True)).collect()
    assert dict(skipped) == {"a": "REP", "b": None, "c": "REP"}


def test_text_rules(frame):
    assert one(frame, sem.title_case("x"), "STRING", "county judge/executive", "O'NEAL st.mary 3RD", None, "") == [
        "County Judge/Executive",
        "O'neal St.mary 3rd",
        None,
        "",
    ]
    assert one(frame, sem.squish("x"), "STRING", "  a \t b\nc ") == ["a b c"]
    assert one(frame, sem.na_paste("x", F.lit("z")), "STRING", "a", None) == ["a z", "NA z"]
    assert one(frame, sem.not_in("x", ["a"]), "STRING", "a", "b", None) == [False, True, True]
    assert one(frame, sem.digits_number("x"), "STRING", "hb12", "sb", "2022 Special 2") == [12, None, 20222]
    assert one(frame, sem.matched("x", r"(\d+)"), "STRING", "a7", "b") == ["7", None]
    assert one(frame, sem.ratio(F.col("x"), F.lit(0)), "INT", 1) == [None]


def test_formats(frame):
    money = [0, 1234, -1234.5, 99999.99, 100000.4, None]
    assert one(frame, formats.dollar("x"), "DOUBLE", *map(lambda m: None if m is None else float(m), money)) == [
        "$0", "$1,234", "-$1,234.50", "$99,999.99", "$100,000", None,
    ]
    assert one(frame, formats.whole_dollar(F.col("x").cast("decimal(18,2)")), "STRING", "2.50", "3.50", "-7.40") == [
        "$2", "$4", "-$7",
    ]
    assert one(frame, formats.comma("x"), "BIGINT", 1234567) == ["1,234,567"]
    assert one(frame, formats.percent("x"), "DOUBLE", 0.5, 1.0, 12.34567) == ["50.00%", "100.00%", "1,234.57%"]


def test_dollar_on_wide_decimals_keeps_cents(frame):
    assert one(frame, formats.dollar(F.col("x").cast("decimal(38,2)")), "STRING", "1477.03") == ["$1,477.03"]


@pytest.mark.parametrize(
    ("name", "key"),
    [
        ("Beshear, Andy / Jacqueline Coleman", "BESHEAR ANDY"),
        ('John "Jack"  Q.  Public', "JOHN Q PUBLIC"),
        ("  ann   lee ", "ANN LEE"),
        ("/x", ""),
    ],
)
def test_name_key(frame, name, key):
    assert one(frame, names.name_key("x"), "STRING", name) == [key]


def test_names_and_parties(frame):
    assert one(frame, names.first_last("x"), "STRING", "A B C", "A B", "A", None) == ["A C", "A B", "A", None]
    assert one(frame, names.party_in_race_name("x"), "STRING", "Sheriff - Democratic", "X republican", "X") == ["DEM", "REP", None]
    assert one(frame, names.party_code("x"), "STRING", " republican", "D", "i", "", "green", None) == [
        "REP", "DEM", "IND", None, None, None,
    ]
    assert one(frame, names.party_label("x"), "STRING", "DEM", "IND", None) == ["Democratic", "IND", None]


def test_payer_identity(frame):
    rows = frame(
        "i INT, o STRING, f STRING, l STRING, a STRING",
        (0, "Org", "A", "B", "x"), (1, None, "A", "B", None), (2, None, "A", None, "x"), (3, None, None, "B", "x"),
    )
    rows = rows.orderBy("i")
    assert [r[0] for r in rows.select(names.payer_identity("o", "f", "l", "a")).collect()] == ["Org", "A B NA", None, "NA B x"]
    assert [r[0] for r in rows.select(names.payer_identity("o", "f", "l")).collect()] == ["Org", "A B", None, "NA B"]


OFFICES = {
    "President of the United States": "President",
    "status senate seat": "U.S. Senate",
    "US Senate": "U.S. Senate",
    "Representative in Congress 3rd Congressional District": "U.S. House",
    "Lieutenant Governor": "Governor",
    "Attorney General": "Attorney General",
    "Auditorium board": "Auditor of Public Accounts",
    "Commissioner of Agriculture": "Commissioner of Agriculture",
    "State Senator": "State Senate",
    "State Representative": "State House",
    "Circuit Court Clerk": "Circuit Court Clerk",
    "County Judge/Executive": "County Judge/Executive",
    "County Commissioner": "County Commissioner",
    "PVA": "Property Valuation Administrator",
    "Contable": "Constable",
    "Commonwealths Attorney": "Commonwealth's Attorney",
    "Circuit Judge, Family Court": "Family Court Judge",
    "District Judge": "District Judge",
    "Judge": "Judge",
    "Constitutional Amendment 2": "Constitutional Amendment",
    "Shall the city annex land?": "Ballot Question",
    "City Commissioner": "City Commission",
    "Fayette BOE": "School Board",
    "Independent schools": "School Board",
    "Soil & Water": "Soil & Water Conservation",
    "Library trustee": "Other Local",
}


def test_offices(frame):
    rows = frame("race STRING, want STRING", *OFFICES.items())
    wrong = offices.with_office(rows, "race").filter("office <> want OR office_level IS NULL").collect()
    assert wrong == []


def test_every_pattern_is_reachable(frame):
    """Each office appears for at least one phrase of the bindings, so the SQL check covers all branches."""
    from civic_spark.bindings.views import PHRASES

    rows = frame("race STRING", *[(p.replace("{n}", "3"),) for p in PHRASES])
    seen = {r.office for r in offices.with_office(rows, "race").collect()}
    assert seen == {name for _, name in offices.OFFICE_PATTERNS} | {offices.OTHER_OFFICE}


def test_district_and_jurisdiction(frame):
    rows = frame(
        "race STRING",
        ("State Senator 12th Senatorial District",),
        ("Sheriff 3rd District",),
        ("Circuit Judge 2 nd Judicial Circuit 1st Division",),
        ("Mayor City of St. Mary's (Unexpired)",),
        ("Mayor City of Oak Grove",),
        ("Mayor city of oak",),
    )
    got = {r.race: (r.district, r.jurisdiction) for r in offices.with_office(rows, "race").collect()}
    assert list(got.values()) == [
        ("12", None), (None, None), ("2", None), (None, "City of St. Mary's"), (None, "City of Oak Grove"), (None, None),
    ]


def test_roster_office_last_override_wins(frame):
    texts = ["U.S. House of Representatives", "Kentucky Senate", "U.S. Senate Kentucky", "Mayor", "Congress"]
    assert one(frame, offices.roster_office("x"), "STRING", *texts) == [
        "State House", "State Senate", "U.S. Senate", "Mayor", "U.S. House",
    ]


def test_ramp(frame):
    assert one(frame, colors.ramp_position("x"), "DOUBLE", None, 0.4, 0.675, 0.9) == [0.0, 0.0, pytest.approx(0.5), 1.0]
    ends = frame("i INT, w STRING, p DOUBLE", (0, "REP", 0.5), (1, "REP", 0.99), (2, "IND4", 0.1), (3, "Tie", 0.5), (4, None, None))
    fills = [r[0] for r in ends.orderBy("i").select(colors.ramp_fill("w", "p")).collect()]
    assert fills == ["#fff5f0", "#99000d", "#f7f4f9", "#f0f0f0", "#f0f0f0"]


def test_ramp_passes_through_every_stop(frame):
    rows = []
    for party, ramp in colors.RAMPS.items():
        for i, stop in enumerate(ramp):
            rows.append((party, 0.5 + 0.35 * i / (len(ramp) - 1), stop))
    table = frame("w STRING, p DOUBLE, stop STRING", *rows).withColumn("fill", colors.ramp_fill("w", "p"))

    def channels(h):
        return [int(h[i : i + 2], 16) for i in (1, 3, 5)]

    for r in table.collect():
        assert all(abs(a - b) <= 1 for a, b in zip(channels(r.fill), channels(r.stop))), r


def test_steps(frame):
    cases = [
        ("REP", 0.81, "#99000d"), ("REP", 0.5, "#fff5f0"), ("DEM", None, "#f7fbff"), ("IND1", 0.5, "white"),
        ("IND2", 0.1, "#d94701"), ("IND2", 0.9, "#fd8d3c"), ("IND3", 0.4, "#edf8e9"), ("Tie", 0.5, "white"), (None, 0.9, "white"),
    ]
    rows = frame("i INT, w STRING, p DOUBLE", *[(i, w, p) for i, (w, p, _) in enumerate(cases)]).orderBy("i")
    assert [r[0] for r in rows.select(colors.step_fill("w", "p")).collect()] == [c for _, _, c in cases]


def test_counts_by_values_that_occur(frame):
    from civic_spark.operators.reshape import counts_by_value, map_text

    rows = frame("k INT, p STRING", (1, "Democratic"), (1, "Independent"), (1, "Independent"), (1, None), (2, "Republican"), (3, None))
    got = {r.k: (r.counts, r.t) for r in counts_by_value(rows, ["k"], "p").withColumn("t", map_text("counts")).collect()}
    assert got == {1: ({"Democratic": 1, "Independent": 2, "NA": 1}, "Democratic=1 | Independent=2 | NA=1"), 2: ({"Republican": 1}, "Republican=1"), 3: ({"NA": 1}, "NA=1")}
