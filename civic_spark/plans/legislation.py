"""Bills, sponsors, roll calls, legislators and actions, for all sessions at once.

Bills are keyed by (session, bill_num). A bill's sponsor list is at most the membership of the legislature,
which bounds every text aggregate below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import digits_number, na_paste
from ..operators.reshape import count_by_value, prefixed, to_long

BILL = ["session", "bill_num"]

# Party names, their display colours, and chamber prefixes of bill numbers.
DEMOCRATIC, REPUBLICAN = "Democratic", "Republican"
PARTY_COLORS = {REPUBLICAN: "red", DEMOCRATIC: "blue"}
CHAMBER_PREFIX = {"house": "h", "senate": "s"}
YES, NO = "✔️", "❌"
BILL_SITE = "https://apps.legislature.ky.gov/record"


def session_list(sponsors: DataFrame) -> DataFrame:
    return sponsors.select("session").distinct().orderBy(F.col("session").desc_nulls_last())


def last_update(update_day: DataFrame) -> DataFrame:
    return update_day.select(
        F.concat(F.lit("Last Update: "), F.date_format("update_day", "MMMM d, yyyy")).alias("last_update")
    )


def in_chamber(chamber: str) -> Column:
    return F.col("bill_num").startswith(CHAMBER_PREFIX[chamber])


def bill_list(bills: DataFrame, chamber: str | None = None) -> DataFrame:
    """Bill fields in the order of the bill's number."""
    rows = bills if chamber is None else bills.filter(in_chamber(chamber))
    fields = ["title", "bill_summary", "last_action", "passed_house", "passed_senate", "passed"]
    return rows.select(*BILL, *fields).orderBy("session", digits_number("bill_num").asc_nulls_last(), "bill_num")


def other_parties() -> Column:
    """Aggregate: rows of any party but the two with a column of their own."""
    return F.count_if(~F.col("party").isin(DEMOCRATIC, REPUBLICAN)).alias("other_party")


def bill_overview(bills: DataFrame, sponsors: DataFrame, legislators: DataFrame) -> DataFrame:
    """Bills with their sponsors (``name|party``) and sponsor counts per party.

    Bills without a sponsor of known party keep NULL counts; a known bill without, say, Democrats has 0.
    """
    people = legislators.select("legislator_id", "name", "party")
    signed = sponsors.select(*BILL, "legislator_id").join(people, "legislator_id", "left")
    signed = signed.withColumn("name_party", F.concat_ws("|", "name", "party"))
    per_bill = signed.groupBy(*BILL).agg(
        _joined("name_party", ";").alias("spon_list"),
        *count_by_value("party", {DEMOCRATIC: DEMOCRATIC, REPUBLICAN: REPUBLICAN}),
        other_parties(),
        F.count("party").alias("_known"),
    )
    known = per_bill.filter(F.col("_known") > 0).drop("_known")
    flags = {c: F.col(c).try_cast("int") for c in ("passed_house", "passed_senate", "passed")}
    table = bills.select(*BILL, "title", "bill_summary", "last_action", *flags).join(known, BILL, "left")
    return table.withColumns(flags).orderBy("session", digits_number("bill_num").asc_nulls_last(), "bill_num")


def _joined(column: str, separator: str) -> Column:
    """Texts of a group in text order."""
    return F.array_join(F.sort_array(F.collect_list(column)), separator)


def passed_mark(flag: Column | str) -> Column:
    return F.when(F.col(flag) == 1, YES).when(F.col(flag).isNotNull(), NO)


def sponsor_list(overview: DataFrame) -> DataFrame:
    """Sponsor names of a bill and the colour each is shown in."""
    entries = F.split("spon_list", ";")

    def color(entry: Column) -> Column:
        party = F.split_part(entry, F.lit("|"), F.lit(2))
        return F.when(party == REPUBLICAN, "red").when(party == DEMOCRATIC, "blue").otherwise("none")

    return overview.filter(F.col("spon_list").isNotNull()).select(
        *BILL,
        F.array_join(F.transform(entries, lambda e: F.split_part(e, F.lit("|"), F.lit(1))), ", ").alias("sponsor_text"),
        F.array_join(F.transform(entries, color), ", ").alias("sponsor_colors"),
    )


def bill_header(bills: DataFrame, sponsors: DataFrame, legislators: DataFrame) -> DataFrame:
    """Title, sponsors (chief ones first, marked ``*``) and summary.

    A sponsor of neither major party prints as ``NA`` without a separator, as the original header does.
    """
    people = legislators.select("legislator_id", "name", "party")
    signed = sponsors.select(*BILL, "legislator_id", "chief_sponsor").join(people, "legislator_id", "left")
    chief = F.coalesce(F.col("chief_sponsor") == "1", F.lit(False))
    name = na_paste(F.col("name"), F.when(chief, "*").otherwise(""), F.lit(", "), sep="")
    shown = F.when(F.col("party").isin(*PARTY_COLORS), name).otherwise("NA")
    ordered = F.sort_array(
        F.collect_list(
            F.struct((~chief).alias("later"), "legislator_id", shown.alias("shown"))
        )
    )
    text = F.regexp_replace(F.array_join(F.transform(ordered, lambda s: s["shown"]), ""), ", $", "")
    per_bill = signed.groupBy(*BILL).agg(text.alias("sponsors"))
    header = bills.select(*BILL, "title", "bill_summary").join(per_bill, BILL, "left")
    return header.withColumn("sponsors", F.coalesce("sponsors", F.lit("")))


def bill_actions(actions: DataFrame) -> DataFrame:
    """Actions of each bill, last recorded first. A range sort on (bill, seq), so a busy bill spreads out."""
    return actions.orderBy(*BILL, F.col("seq").desc()).select(*BILL, "date", "action", "seq")


def _votes_with_names(votes: DataFrame, legislators: DataFrame) -> DataFrame:
    people = legislators.select("legislator_id", "name", "party")
    return votes.select(*BILL, "chamber", "legislator_id", "vote").join(people, "legislator_id", "left")


def vote_rank(vote: Column | str = "vote") -> Column:
    return F.when(F.col(vote) == "YEA", 1).when(F.col(vote) == "NAY", 2).otherwise(3)


def vote_summary(votes: DataFrame, legislators: DataFrame) -> DataFrame:
    """Votes per party and kind for each bill and chamber, with the total: yeas, nays, then the rest."""
    named = _votes_with_names(votes, legislators)
    counted = named.groupBy(*BILL, "chamber", "vote").agg(
        F.count(F.lit(1)).alias("Total"),
        *count_by_value("party", {DEMOCRATIC: DEMOCRATIC, REPUBLICAN: REPUBLICAN, "no_party": None}),
        other_parties(),
    )
    counted = counted.withColumn("no_party", F.nullif("no_party", F.lit(0)))
    return counted.orderBy(*BILL, "chamber", vote_rank(), "vote")


def roll_call(votes: DataFrame, legislators: DataFrame) -> DataFrame:
    """Who voted how, by name; yeas and nays carry a mark."""
    named = _votes_with_names(votes, legislators)
    shown = (
        F.when(F.col("vote") == "YEA", f"{YES} YEA").when(F.col("vote") == "NAY", f"{NO} NAY").otherwise(F.col("vote"))
    )
    rows = named.select(*BILL, "chamber", "name", "party", "vote", shown.alias("vote_shown"))
    return rows.orderBy(*BILL, "chamber", F.col("name").asc_nulls_last())


def session_flags(legislators: DataFrame) -> DataFrame:
    """One row per legislator and session column, with its 0/1 flag."""
    flags = prefixed(legislators, "ga_")
    numbers = legislators.withColumns({c: F.col(c).try_cast("int") for c in flags})
    return to_long(numbers, ["legislator_id", "name", "chamber"], flags, "session_flag", "serving")


def session_legislators(sponsors: DataFrame, legislators: DataFrame) -> DataFrame:
    """Members of every session, labelled ``name (chamber)``."""
    sessions = sponsors.select("session").distinct()
    sessions = sessions.filter(F.col("session").rlike(r"^\d{4} General Assembly$"))
    sessions = sessions.withColumn("session_flag", F.concat(F.lit("ga_"), F.substring("session", 3, 2)))
    serving = session_flags(legislators).filter(F.col("serving") == 1)
    label = na_paste(F.col("name"), F.lit(" ("), F.col("chamber"), F.lit(")"), sep="")
    return serving.join(sessions, "session_flag").select("session", "legislator_id", label.alias("label"))


def legislator_profile(legislators: DataFrame) -> DataFrame:
    """Profile fields; a portrait address only where a portrait exists."""
    return legislators.select("legislator_id", "full_name", "party", "chamber", "district", "img_src", "lrc_link")


def legislator_votes(votes: DataFrame) -> DataFrame:
    """Votes of each legislator by bill number. Anything but a yea is shown as a nay; the raw vote stays."""
    shown = F.when(F.col("vote") == "YEA", f"{YES} YEA").when(F.col("vote").isNotNull(), f"{NO} NAY")
    rows = votes.select(
        "legislator_id", "session", F.upper("bill_num").alias("bill_num"), "vote", shown.alias("vote_shown")
    )
    return rows.orderBy("legislator_id", "session", digits_number("bill_num").asc_nulls_last(), "bill_num")


def legislator_sponsorships(sponsors: DataFrame, bills: DataFrame) -> DataFrame:
    """Bills each legislator sponsors, ``*`` for chief sponsor, with titles."""
    titled = sponsors.join(bills.select(*BILL, "title"), BILL, "left")
    number = F.upper(F.when(F.col("chief_sponsor") == "1", F.concat("bill_num", F.lit("*"))).otherwise(F.col("bill_num")))
    return titled.select("legislator_id", "session", number.alias("bill_num"), "title")


def action_days(actions: DataFrame) -> DataFrame:
    """Days with actions whose year is the number spelled by all digits of the session's label, newest first."""
    days = actions.select("session", "date").distinct()
    return days.filter(F.year("date") == digits_number("session")).orderBy("session", F.col("date").desc())


def actions_by_day(actions: DataFrame) -> DataFrame:
    return actions.select("session", "date", F.upper("bill_num").alias("bill_num"), "action", "seq").orderBy(
        "session", "date", "bill_num", "seq"
    )


def actions_by_day_groups(actions: DataFrame) -> DataFrame:
    """Bills acted on per day with the number of actions."""
    return actions.groupBy("session", "date", F.upper("bill_num").alias("bill_num")).agg(
        F.count(F.lit(1)).alias("n_actions")
    )


def bill_links(bills: DataFrame, site: str = BILL_SITE) -> DataFrame:
    """Address of each bill's page, from the year in its session label."""
    year = F.substring(F.regexp_substr("session", F.lit(r"\d{4}")), 3, 2)
    link = F.concat(F.lit(f"{site}/"), year, F.lit("rs/"), F.upper("bill_num"), F.lit(".html"))
    return bills.select(*BILL, link.alias("link"))
