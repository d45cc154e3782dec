"""Campaign finance per campaign. A campaign is (election_date, office_sought, candidate).

Contributions are always reduced by (campaign, contributor), (campaign, day) or (campaign, place) before
anything else happens, so a campaign holding a third of all rows shrinks on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colors import NO_VALUE_FILL, bin_fill
from ..functions.formats import comma, dollar, has_cents, shows_cents, whole_dollar
from ..functions.names import payer_identity
from ..functions.semantics import na_sum
from ..operators.joins import lookup_missing_as_null
from ..operators.quantiles import bin_of, grouped_quantiles, midpoint_rank
from ..operators.reshape import to_long
from ..operators.series import fill_days, running_totals

CAMPAIGN = ["election_date", "office_sought", "candidate"]

# The home state, contribution types, the "large gift" line and the quantiles of the map bins.
HOME_STATE = "KY"
INDIVIDUAL, PAC = "INDIVIDUAL", "KYPAC"
LARGE_GIFT = 2000
BIN_QUANTILES = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]

# Names of the summary lines, in display order.
SUMMARY_LINES = {
    "total_raise": "Total Amount Raised",
    "total_spend": "Total Amount Spent",
    "cash_on_hand": "Cash on Hand",
    "unique_contrib": "Unique Contributors",
    "avg_contrib": "Average Contribution",
    "ky_raise": "Contributions from Kentucky",
    "individual_max_contribs": "Number of $2000 Contributions",
    "pac_contrib": "Total PAC Money Raised",
}


def contributor(with_address: bool) -> Column:
    return payer_identity(
        "from_organization_name", "contributor_first_name", "contributor_last_name", "address1" if with_address else None
    )


def contribution_list(contrib: DataFrame) -> DataFrame:
    """Contributions of each campaign, newest first; every column is in the sort key, so one date spreads over tasks."""
    fields = ["amount", "receipt_date", "city", "state", "zip", "occupation", "employer"]
    kinds = ["contribution_mode", "contribution_type"]
    rows = contrib.select(*CAMPAIGN, contributor(False).alias("contributor"), *fields, *kinds)
    return rows.orderBy(*CAMPAIGN, F.col("receipt_date").desc_nulls_last(), "contributor", "amount", *fields[2:], *kinds)


def expenditure_list(expend: DataFrame) -> DataFrame:
    """Expenditures of each campaign, newest first, sorted as contributions are."""
    recipient = payer_identity("organization_name", "recipient_first_name", "recipient_last_name")
    rows = expend.select(
        *CAMPAIGN,
        recipient.alias("recipient"),
        "disbursement_amount",
        F.to_date("disbursement_date").alias("disbursement_date"),
        "purpose",
        "occupation",
        "disbursement_code",
    )
    last = ["recipient", "disbursement_amount", "purpose", "occupation", "disbursement_code"]
    return rows.orderBy(*CAMPAIGN, F.col("disbursement_date").desc_nulls_last(), *last)


def _part(condition: Column, name: str) -> list[Column]:
    """Level-one aggregates of a conditional sum that may turn missing."""
    mine = F.coalesce(condition, F.lit(False))
    return [
        F.sum(F.when(mine, F.col("amount"))).alias(f"{name}_sum"),
        F.bool_or(mine & F.col("amount").isNull()).alias(f"{name}_gap"),
        F.count_if(mine).alias(f"{name}_rows"),
    ]


def _whole(name: str) -> Column:
    """Level-two value: NULL if any amount in the set was missing, 0 for an empty set."""
    return F.when(F.bool_or(f"{name}_gap"), None).otherwise(F.coalesce(F.sum(f"{name}_sum"), F.lit(0)))


def finance_totals(contrib: DataFrame, expend: DataFrame) -> DataFrame:
    """Money raised and spent per campaign, contributor counts and special sums.

    Two grouping levels: first (campaign, contributor), where the NULL contributor is one group like any
    other, then campaign. Distinct counts and the large-gift count fall out of the second level.
    """
    person = contrib.withColumn("contributor", contributor(True)).groupBy(*CAMPAIGN, "contributor").agg(
        F.sum("amount").alias("all_sum"),
        F.count("amount").alias("all_given"),
        *_part(F.col("state") == HOME_STATE, "home"),
        *_part(F.col("contribution_type") == INDIVIDUAL, "person"),
        *_part(F.col("contribution_type") == PAC, "pac"),
    )
    large = (F.col("person_rows") > 0) & ~F.col("person_gap") & (F.col("person_sum") >= LARGE_GIFT)
    raised = person.groupBy(*CAMPAIGN).agg(
        F.coalesce(F.sum("all_sum"), F.lit(0)).alias("total_raise"),
        F.count(F.lit(1)).alias("unique_contrib"),
        (F.sum("all_sum").cast("double") / F.nullif(F.sum("all_given"), F.lit(0))).alias("avg_contrib"),
        _whole("home").alias("ky_raise"),
        F.count_if(large).alias("individual_max_contribs"),
        _whole("pac").alias("pac_contrib"),
    )
    spent = expend.groupBy(*CAMPAIGN).agg(F.sum("disbursement_amount").alias("total_spend"))
    both = raised.join(spent, CAMPAIGN, "left")
    both = both.withColumn("total_spend", F.coalesce("total_spend", F.lit(0)))
    return both.withColumn("cash_on_hand", F.col("total_raise") - F.col("total_spend"))


def finance_summary(contrib: DataFrame, expend: DataFrame) -> DataFrame:
    """The eight formatted summary lines of each campaign, one row per line."""
    totals = finance_totals(contrib, expend)
    money = {c: whole_dollar(c) for c in ("total_raise", "total_spend", "cash_on_hand", "ky_raise", "pac_contrib")}
    texts = {
        **money,
        "unique_contrib": comma("unique_contrib"),
        "avg_contrib": dollar(F.bround("avg_contrib", 2)),
        "individual_max_contribs": comma("individual_max_contribs"),
    }
    shown = totals.select(*CAMPAIGN, *[texts[c].alias(line) for c, line in SUMMARY_LINES.items()])
    return to_long(shown, CAMPAIGN, list(SUMMARY_LINES.values()))


def burn_rate(contrib: DataFrame, expend: DataFrame) -> DataFrame:
    """Money in and out per day with running totals, every day between the first and the last present.

    Undated rows count on the campaign's earliest day; a day with a missing amount counts as 0.
    """
    given = contrib.groupBy(*CAMPAIGN, F.to_date("receipt_date").alias("date")).agg(
        F.sum("amount").alias("amount"), F.bool_or(F.col("amount").isNull()).alias("gap")
    )
    paid = expend.groupBy(*CAMPAIGN, F.to_date("disbursement_date").alias("date")).agg(
        F.sum("disbursement_amount").alias("amount"), F.bool_or(F.col("disbursement_amount").isNull()).alias("gap")
    )
    sides = given.withColumn("side", F.lit("in")).unionByName(paid.withColumn("side", F.lit("out")))
    # Two rows per campaign and day at most from here on, and one partitioning serves everything below.
    campaign = Window.partitionBy(*CAMPAIGN)
    dated = sides.withColumn("date", F.coalesce(F.col("date"), F.min("date").over(campaign)))

    def of(side: str) -> Column:
        mine = F.col("side") == side
        gap = F.bool_or(mine & F.col("gap"))
        return F.when(gap, 0).otherwise(F.coalesce(F.sum(F.when(mine, F.col("amount"))), F.lit(0)))

    daily = dated.groupBy(*CAMPAIGN, "date").agg(of("in").alias("contributions"), of("out").alias("disbursement"))
    totals = running_totals(daily, CAMPAIGN, "date", {"contributions": "cs_contrib", "disbursement": "cs_disburse"})
    return fill_days(totals, CAMPAIGN, "date", ["contributions", "disbursement"])


def contributor_totals(contrib: DataFrame) -> DataFrame:
    """What each individual contributor gave to each campaign (the points of the distribution plot)."""
    people = contrib.filter(F.col("contribution_type") == INDIVIDUAL).withColumn("contributor", contributor(True))
    return people.groupBy(*CAMPAIGN, "contributor").agg(na_sum("amount").alias("amount"))


def contributor_box(contrib: DataFrame) -> DataFrame:
    """Five-number summary of the contributor totals of each campaign, hinges placed as box plots do."""
    probs = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    return grouped_quantiles(contributor_totals(contrib), CAMPAIGN, "amount", probs, rank=midpoint_rank)


def county_giving(contrib: DataFrame, zip_county: DataFrame) -> DataFrame:
    """Giving per county with its quintile bin. A zip code in two counties counts in both."""
    by_zip = contrib.groupBy(*CAMPAIGN, "zip").agg(na_sum("amount").alias("amount"))
    placed = lookup_missing_as_null(by_zip, zip_county, "zip", "zip_code")
    by_county = placed.groupBy(*CAMPAIGN, "county").agg(na_sum("amount").alias("amount"))
    # A campaign has at most one row per county here, so the exact percentile buffers one state's counties.
    breaks = by_county.groupBy(*CAMPAIGN).agg(
        F.percentile(F.col("amount").cast("double"), F.array(*[F.lit(q) for q in BIN_QUANTILES])).alias("breaks"),
        shows_cents(F.max(F.abs("amount")), F.bool_or(has_cents(F.col("amount")))).alias("cents"),
    )
    binned = by_county.join(breaks, CAMPAIGN)
    binned = binned.withColumn("bin", bin_of(F.col("amount").cast("double"), F.col("breaks")).cast("bigint"))
    label = F.concat(F.coalesce("county", F.lit("NA")), F.lit(" "), F.coalesce(dollar("amount", F.col("cents")), F.lit("NA")))
    fill = bin_fill(F.col("bin"), F.size(F.array_distinct("breaks")) - 1)
    return binned.withColumns({"label": label, "fill_col": fill}).drop("breaks", "cents")


def giving_map(contrib: DataFrame, zip_county: DataFrame, counties: DataFrame) -> DataFrame:
    """County shapes with giving; counties that gave nothing stay, with no campaign.

    A county has one row per campaign, so no county is a hot join key.
    """
    giving = county_giving(contrib, zip_county).withColumn("name", F.upper("county"))
    shapes = counties.withColumn("name", F.upper("name"))
    return shapes.join(giving, "name", "left").fillna(NO_VALUE_FILL, "fill_col")


def out_of_state(contrib: DataFrame, home: str = HOME_STATE) -> DataFrame:
    away = contrib.filter(F.col("state") != home)
    summed = away.groupBy(*CAMPAIGN, "state").agg(na_sum("amount").alias("amount"))
    return summed.orderBy(*CAMPAIGN, F.col("amount").desc_nulls_last(), "state")
