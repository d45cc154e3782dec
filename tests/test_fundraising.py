"""Campaign finance on small tables and against brute force."""

from __future__ import annotations

import datetime
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from civic_spark.functions import colors
from civic_spark.operators.quantiles import bin_of, grouped_quantiles, midpoint_rank
from civic_spark.plans import choices, fundraising

DAY = datetime.date
CONTRIB = (
    "election_type STRING, election_date DATE, office_sought STRING, candidate STRING, recipient_first_name STRING, "
    "recipient_last_name STRING, from_organization_name STRING, contributor_first_name STRING, contributor_last_name STRING, "
    "address1 STRING, amount DECIMAL(18,2), receipt_date DATE, city STRING, state STRING, zip STRING, occupation STRING, "
    "employer STRING, contribution_mode STRING, contribution_type STRING"
)
EXPEND = (
    "election_date DATE, office_sought STRING, candidate STRING, organization_name STRING, recipient_first_name STRING, "
    "recipient_last_name STRING, disbursement_amount DECIMAL(18,2), disbursement_date DATE, purpose STRING, occupation STRING, "
    "disbursement_code STRING"
)


def gift(amount, day=None, last="Lee", org=None, addr="1 Main", state="KY", zip="40000", kind="INDIVIDUAL", cand="C", etype="GENERAL"):
    amount = None if amount is None else Decimal(str(amount))
    day = None if day is None else DAY(2023, 1, day)
    return (etype, DAY(2023, 11, 7), "GOVERNOR", cand, "Pat", "Doe", org, "Ann", last, addr, amount, day, "X", state, zip, "o", "e", "m", kind)


def cost(amount, day=None, cand="C"):
    amount = None if amount is None else Decimal(str(amount))
    day = None if day is None else DAY(2023, 1, day)
    return (DAY(2023, 11, 7), "GOVERNOR", cand, "Org", None, None, amount, day, "p", "o", "c")


def totals(frame, gifts, costs=()):
    return fundraising.finance_totals(frame(CONTRIB, *gifts), frame(EXPEND, *costs)).first()


def test_totals(frame):
    got = totals(
        frame,
        [
            gift(1500, 1), gift(500, 2), gift(700, addr="2 Main"), gift(100, last=None), gift(50, last=None, kind="KYPAC"),
            gift(2500, org="PAC", kind="KYPAC", state="OH"), gift(25, state=None),
        ],
        [cost(1000.25, 3)],
    )
    assert (got.total_raise, got.total_spend, got.cash_on_hand) == (Decimal("5375"), Decimal("1000.25"), Decimal("4374.75"))
    assert got.unique_contrib == 4  # two addresses are two people, one organisation, one group without a name
    assert got.individual_max_contribs == 1  # exactly 2000 (plus the 25) counts
    assert got.pac_contrib == 2550 and got.ky_raise == 2850
    assert got.avg_contrib == pytest.approx(5375 / 7)


def test_missing_amounts(frame):
    got = totals(frame, [gift(None), gift(3000), gift(10, last="B", state="OH")])
    assert (got.total_raise, got.avg_contrib) == (3010, 1505.0)
    assert got.ky_raise is None and got.pac_contrib == 0
    assert got.individual_max_contribs == 0  # the contributor's total is missing
    assert got.total_spend == 0


def test_summary_lines(frame):
    rows = fundraising.finance_summary(frame(CONTRIB, gift("1000.50", 1), gift("2.25", 2)), frame(EXPEND, cost(5000)))
    assert {r.name: r.value for r in rows.collect()} == {
        "Total Amount Raised": "$1,003", "Total Amount Spent": "$5,000", "Cash on Hand": "-$3,997", "Unique Contributors": "1",
        "Average Contribution": "$501.38", "Contributions from Kentucky": "$1,003", "Number of $2000 Contributions": "0",
        "Total PAC Money Raised": "$0",
    }


def test_burn_rate_fills_days_and_moves_undated_rows(frame):
    rows = fundraising.burn_rate(
        frame(CONTRIB, gift(10, 3), gift(5, None), gift(7, 6), gift(None, 6)), frame(EXPEND, cost(2, 2), cost(1, 6))
    ).orderBy("date")
    got = [(r.date.day, float(r.contributions), float(r.disbursement), float(r.cs_contrib), float(r.cs_disburse)) for r in rows.collect()]
    assert got == [(2, 5, 2, 5, 2), (3, 10, 0, 15, 2), (4, 0, 0, 15, 2), (5, 0, 0, 15, 2), (6, 0, 1, 15, 3)]


def test_last_running_total_is_the_dated_sum(frame):
    random.seed(1)
    gifts = [gift(random.randint(1, 500), random.randint(1, 28), cand=f"C{i % 3}") for i in range(200)]
    table = frame(CONTRIB, *gifts)
    ends = fundraising.burn_rate(table, frame(EXPEND)).groupBy("candidate").agg(F.max("cs_contrib").alias("t"))
    assert dict(ends.collect()) == dict(table.groupBy("candidate").agg(F.sum("amount")).collect())


def test_county_giving(frame):
    zips = frame("zip_code STRING, county STRING", ("1", "A"), ("2", "B"), ("2", "C"), ("3", "A"))
    table = frame(CONTRIB, gift(10, zip="1"), gift(20, zip="2"), gift(30, zip="3"), gift(5, zip="9"))
    giving = fundraising.county_giving(table, zips)
    assert {r.county: float(r.amount) for r in giving.collect()} == {"A": 40, "B": 20, "C": 20, None: 5}
    assert {r.label for r in giving.collect()} == {"A $40", "B $20", "C $20", "NA $5"}
    counties = frame("name STRING", ("a",), ("Z",))
    assert {(r.name, r.county) for r in fundraising.giving_map(table, zips, counties).collect()} == {("A", "A"), ("Z", None)}


def test_cents_are_decided_for_all_labels_together(frame):
    zips = frame("zip_code STRING, county STRING", ("1", "A"), ("2", "B"))
    labels = lambda *gifts: {r.label for r in fundraising.county_giving(frame(CONTRIB, *gifts), zips).collect()}
    assert labels(gift(10, zip="1"), gift("20.5", zip="2")) == {"A $10.00", "B $20.50"}
    assert labels(gift(100000, zip="1"), gift("20.5", zip="2")) == {"A $100,000", "B $20"}


def test_lists_and_out_of_state(frame):
    table = frame(CONTRIB, gift(10, 1), gift(20, 5, state="OH"), gift(1, None, state=None), gift(30, 2, state="OH"))
    listed = fundraising.contribution_list(table).collect()
    assert [r.receipt_date and r.receipt_date.day for r in listed] == [5, 2, 1, None]
    assert listed[0].contributor == "Ann Lee"
    assert [(r.state, float(r.amount)) for r in fundraising.out_of_state(table).collect()] == [("OH", 50.0)]
    assert fundraising.expenditure_list(frame(EXPEND, cost(3, 1))).first().recipient == "Org"


def test_pickers(frame):
    table = frame(CONTRIB, gift(1, etype="PRIMARY"), gift(1, etype="GENERAL"), gift(1, cand="A"))
    assert [r.election_select for r in choices.election_dates(table).collect()] == ["General 2023"]
    assert [(r.group_label, r.value) for r in choices.office_choices(table).collect()] == [("Statewide (Executive)", "Governor")]
    assert [r.candidate for r in choices.candidate_choices(table).collect()] == ["A", "C"]


@pytest.mark.parametrize("slices, rank_rows", [(2, 5), (7, 30), (64, 50_000), (64, 2)])
def test_quantiles_match_numpy(frame, slices, rank_rows):
    random.seed(slices)
    groups = {
        "ties": [float(random.randint(1, 5)) for _ in range(500)],
        "spread": [round(random.lognormvariate(3, 2), 2) for _ in range(700)],
        "one": [4.0],
        "two": [1.0, 2.0],
        "hot": [9.0] * 900 + [1.0, 2.0, 100.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("one", None)]
    probs = {"a": 0.0, "b": 0.2, "c": 0.5, "d": 0.8, "e": 1.0}
    table = frame("k STRING, v DOUBLE", *rows)
    linear = {r.k: r for r in grouped_quantiles(table, ["k"], "v", probs, rank_rows=rank_rows, slices=slices).collect()}
    hinges = {r.k: r for r in grouped_quantiles(table, ["k"], "v", probs, rank=midpoint_rank, rank_rows=rank_rows, slices=slices).collect()}
    for k, vs in groups.items():
        assert list(linear[k])[1:] == pytest.approx(np.quantile(vs, list(probs.values())))
        assert list(hinges[k])[1:] == pytest.approx(np.quantile(vs, list(probs.values()), method="hazen"))


def test_large_groups_are_narrowed_before_they_are_ranked(frame):
    """Every interval that goes on to be ranked holds at most the stated number of values, and all wanted ranks."""
    from civic_spark.operators import quantiles

    rows = frame("k STRING, v DOUBLE", *[("big", float((i * 7919) % 5003)) for i in range(5003)], *[("small", float(i)) for i in range(9)])
    counted = rows.groupBy("k", F.col("v").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    nothing = F.lit(None).cast("double")
    ends = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(r).alias("lo"), F.lit(r).alias("hi"), F.lit(float(r)).alias("at")) for n, r in (("a", 17), ("b", 4000))])
    whole = counted.filter("k = 'big'").groupBy("k").agg(F.count(F.lit(1)).alias("_values"))
    open_ = whole.select("k", nothing.alias("_above"), nothing.alias("_upto"), F.lit(0).cast("bigint").alias("_start"), "_values", ends.alias("_wanted"))
    found = quantiles._narrowed(counted, open_, ["k"], 64).collect()
    assert len(found) == 2 and all(r["_values"] < 5003 / 64 * 2 for r in found)
    held = {w["name"]: r["_start"] <= w["lo"] < r["_start"] + r["_values"] for r in found for w in r["_wanted"]}
    assert held == {"a": True, "b": True}


def test_fills_by_number_of_bins(frame):
    rows = frame("bin INT, bins INT", (1, 5), (5, 5), (4, 4), (1, 1), (3, 3), (None, 5))
    got = [r[0] for r in rows.select(colors.bin_fill(F.col("bin"), F.col("bins"))).collect()]
    assert got == ["#ffffcc", "#253494", "#225ea8", "#edf8b1", "#2c7fb8", "#808080"]


def test_bins_cover_all_values(frame):
    rows = frame("x DOUBLE", *[(float(i),) for i in range(11)])
    breaks = F.array(*[F.lit(float(b)) for b in (0, 2, 2, 5, 10)])
    got = {r.x: r.b for r in rows.withColumn("b", bin_of(F.col("x"), breaks)).collect()}
    assert [got[float(i)] for i in range(11)] == [1, 1, 2, 2, 2, 3, 3, 3, 3, 3, 3]
