"""The user-level results over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colors
from ..functions.colors import ramp_fill, ramp_position
from ..operators.winners import totals
from ..operators.spatial import polygons_from_vertices
from ..plans import choices, districts, elections, fundraising, legislation, primaries, rosters
from ..sources import tables
from . import sqltext as s
from .registry import query
from .views import Views

CONTEST = s.CONTEST
PARTISAN = "('federal', 'state_exec', 'state_leg', 'county')"
CAMPAIGN = "strftime(election_date, '%Y-%m-%d') AS election_date, office_sought, candidate"


def contest_rows(v: Views):
    return elections.contest_rows(v.election_data)


def race_lookup(v: Views):
    """Stored crosswalk of all ballot races."""
    return v.stored("race_lookup", lambda: primaries.race_crosswalk(v.ballots))


def overrides(v: Views):
    return tables.clean_overrides(v.manual_raw)


def resolved(v: Views):
    return primaries.resolve_parties(v.ballots, race_lookup(v), overrides(v))


def parties(v: Views):
    """Stored party lookup, the table that pick lists, splits and worksheets read."""
    return v.stored("primary_party_lookup", lambda: resolved(v))


def split(v: Views):
    """Primary rows under each token they are shown for."""
    return primaries.primary_split(elections.contest_rows(v.ballots), parties(v))


def unresolved(v: Views):
    return primaries.unresolved_candidates(parties(v))


def roster_status(v: Views):
    return rosters.roster_status(unresolved(v), v.roster)


def precinct_shapes(v: Views):
    return v.precinct_shapes


def district_rows(v: Views):
    return districts.district_rows(v.election_data, v.district_precincts)


def plan(v: Views):
    return polygons_from_vertices(v.plan_vertices, ["district"])


# Elections


@query("contest_rows", f"SELECT DISTINCT {CONTEST}, county, precinct, candidate, party, votes FROM election_items")
def _(v):
    return elections.contest_rows(v.election_items)


@query(
    "contest_result",
    f"SELECT {CONTEST}, candidate, {s.nasum()} AS votes, {s.title('candidate')} AS display_name FROM d_rows GROUP BY {CONTEST}, candidate",
)
def contest_result(v):
    return elections.contest_result(contest_rows(v))


@query("county_table", s.wide("d_county_long", CONTEST, "candidate", False))
def _(v):
    return elections.county_table(contest_rows(v))


@query("county_table_listed", s.listed("d_county_long", CONTEST, "candidate", False))
def _(v):
    return elections.county_table_listed(contest_rows(v))


@query("precinct_table", s.wide("d_precinct_long", CONTEST, "party", True))
def precinct_table(v):
    return elections.precinct_table(contest_rows(v))


@query("precinct_table_listed", s.listed("d_precinct_long", CONTEST, "party", True))
def _(v):
    return elections.precinct_table_listed(contest_rows(v))


@query("primary_rank", f"SELECT {CONTEST}, candidate, votes, pct, cnt, 'IND' || cnt AS party FROM d_rank WHERE election = 'primary'")
def _(v):
    return elections.primary_rank(contest_rows(v).filter(F.col("election") == "primary"))


_COUNTY_UNITS = s.winners(
    f"(SELECT {CONTEST}, county, candidate, party, {s.nasum()} AS votes FROM d_map_rows GROUP BY ALL)",
    f"{CONTEST}, county",
    "party",
    False,
    s.LABEL,
)


@query(
    "county_map_data",
    f"""SELECT {CONTEST}, lower(name) AS county, name, winner, winning_votes, total_votes, winning_share, label, ramp_t, fill_col,
        xmin, ymin, xmax, ymax FROM counties LEFT JOIN ({s.painted(_COUNTY_UNITS)}) AS u ON lower(name) = county""",
)
def county_map_data(v):
    return elections.county_map(contest_rows(v), v.counties)


@query(
    "county_map_extent",
    f"""SELECT {CONTEST}, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax
        FROM counties JOIN (SELECT DISTINCT {CONTEST}, county FROM d_rows) AS u ON lower(name) = county GROUP BY {CONTEST}""",
)
def _(v):
    return elections.shown_extent(elections.county_map(contest_rows(v), v.counties), elections.CONTEST)


_PRECINCT_UNITS = s.winners(
    "d_map_rows",
    f"{CONTEST}, county, precinct",
    extra=s.LABEL,
)


@query(
    "precinct_map_data",
    f"""SELECT {CONTEST}, u.county, precinct, winner, winning_votes, total_votes, winning_share, label,
        ramp_t, fill_col, layer, countyfp, vtdst, fips, name, xmin, ymin, xmax, ymax
        FROM ({s.painted(_PRECINCT_UNITS)}) AS u JOIN fips f ON u.county = f.county
        JOIN precinct_shapes g ON g.vtdst = '00' || precinct AND g.countyfp = substring(CAST(fips AS VARCHAR), 3, 3)
            AND g.layer = CASE WHEN year < 2022 THEN 'precincts' WHEN year = 2022 THEN 'precincts_22'
                WHEN year = 2023 THEN 'precincts_24' ELSE 'precincts_general_24' END""",
)
def precinct_map_data(v):
    shown = elections.precinct_map(contest_rows(v), v.fips, precinct_shapes(v))
    return shown


@query("election_years", "SELECT DISTINCT CAST(year AS BIGINT) AS year, CAST(year = (SELECT max(year) FROM ballots) AS BIGINT) AS is_default FROM ballots")
def _(v):
    return elections.election_years(v.ballots)


@query("election_types", f"SELECT DISTINCT year, {s.title('election')} AS election FROM ballots")
def _(v):
    return elections.election_types(v.ballots)


@query("contest_counties", f"SELECT DISTINCT {CONTEST}, lower(county) AS county FROM ballots")
def _(v):
    return elections.contest_counties(v.ballots)


@query(
    "election_choices",
    s.choices(
        """(SELECT DISTINCT e.year, e.race AS value, e.race AS label, coalesce(l.office, e.race) AS office, office_level, district
            FROM ballots e LEFT JOIN d_lookup l ON e.race = l.race WHERE election = 'general') AS c""",
        "year",
    ),
)
def _(v):
    return choices.election_choices(v.ballots, race_lookup(v))


@query(
    "primary_choices",
    s.choices(
        f"""(SELECT t.year, race || chr(31) || token AS value, label, t.office, t.office_level, l.district FROM (
            SELECT DISTINCT year, race, office, office_level, party AS token,
                race || ' (' || CASE party WHEN 'DEM' THEN 'Democratic' WHEN 'REP' THEN 'Republican' ELSE party END || ')' AS label
            FROM d_ppl WHERE party IS NOT NULL
            UNION ALL SELECT DISTINCT year, race, office, office_level, '__UNLABELED__', race || ' (Unlabeled)'
            FROM d_ppl WHERE party IS NULL AND office_level IN {PARTISAN}
            UNION ALL SELECT DISTINCT year, race, office, office_level, '__ALL__', race
            FROM d_ppl WHERE office_level IS NULL OR office_level NOT IN {PARTISAN}) AS t
            LEFT JOIN (SELECT DISTINCT race, district FROM d_lookup) AS l USING (race)) AS c""",
        "year",
    ),
)
def _(v):
    return choices.primary_choices(parties(v), race_lookup(v))


@query("primary_split", f"SELECT {s.PRIMARY}, county, precinct, candidate, party, votes FROM d_split")
def _(v):
    return split(v)


# One party's primary


@query(
    "primary_picked_democratic",
    f"""SELECT {s.PRIMARY}, county, precinct, candidate, party, votes FROM d_split WHERE token = 'DEM'""",
)
def _(v):
    return primaries.picked(split(v), "DEM")


@query(
    "primary_picked_third_party",
    f"""SELECT {s.PRIMARY}, county, precinct, candidate, party, votes FROM d_split WHERE token = '__ALL__'""",
)
def _(v):
    return primaries.picked(split(v), "IND")


@query(
    "primary_token_result",
    f"""SELECT {s.PRIMARY}, candidate, {s.nasum()} AS votes, {s.title('candidate')} AS display_name FROM d_split
        GROUP BY {s.PRIMARY}, candidate""",
)
def _(v):
    return elections.contest_result(split(v), primaries.PRIMARY)


@query("primary_token_county_table", s.wide("d_split_county_long", s.PRIMARY, "candidate", False))
def _(v):
    return elections.county_table(split(v), primaries.PRIMARY)


@query("primary_token_county_listed", s.listed("d_split_county_long", s.PRIMARY, "candidate", False))
def _(v):
    return elections.county_table_listed(split(v), primaries.PRIMARY)


@query("primary_token_precinct_table", s.wide("d_split_precinct_long", s.PRIMARY, "party", True))
def _(v):
    return elections.precinct_table(split(v), primaries.PRIMARY)


@query("primary_token_precinct_listed", s.listed("d_split_precinct_long", s.PRIMARY, "party", True))
def _(v):
    return elections.precinct_table_listed(split(v), primaries.PRIMARY)


@query("primary_token_rank", f"SELECT {s.PRIMARY}, candidate, votes, pct, cnt, 'IND' || cnt AS party FROM d_split_rank")
def _(v):
    return elections.primary_rank(split(v), primaries.PRIMARY)


_TOKEN_COUNTIES = s.winners(
    f"(SELECT {s.PRIMARY}, county, candidate, party, {s.nasum()} AS votes FROM d_split_map_rows GROUP BY ALL)",
    f"{s.PRIMARY}, county",
    "party",
    False,
    s.LABEL,
)


@query("primary_token_county_map", s.painted(_TOKEN_COUNTIES))
def _(v):
    return elections.county_map_results(split(v), primaries.PRIMARY)


_TOKEN_PRECINCTS = s.winners("d_split_map_rows", f"{s.PRIMARY}, county, precinct", extra=s.LABEL)


@query("primary_token_precinct_map", f"SELECT {s.PRIMARY}, county, precinct, winner, winning_votes, total_votes, winning_share, label, ramp_t, fill_col FROM ({s.painted(_TOKEN_PRECINCTS)}) AS u")
def _(v):
    shown = elections.precinct_map_results(split(v), v.fips, primaries.PRIMARY)
    return shown.select(*primaries.PRIMARY, "county", "precinct", "winner", "winning_votes", "total_votes", "winning_share", "label", "ramp_t", "fill_col")


# Crosswalk and party jobs


@query("race_crosswalk", "SELECT race, office_level, office, district, jurisdiction FROM d_crosswalk")
def race_crosswalk(v):
    return primaries.race_crosswalk(v.race_strings)


@query("race_crosswalk_report", "SELECT office_level, office, count(*) AS n FROM d_crosswalk GROUP BY ALL")
def _(v):
    return primaries.crosswalk_by_office(race_crosswalk(v))


@query("race_crosswalk_levels", "SELECT office_level, count(*) AS n FROM d_crosswalk GROUP BY ALL")
def _(v):
    return primaries.crosswalk_by_level(race_crosswalk(v))


@query("primary_party_resolve", "SELECT year, race, candidate, office, office_level, party, source FROM d_ppl")
def primary_party_resolve(v):
    return resolved(v)


_SOURCE_COUNTS = ", ".join(f"count(*) FILTER (source = '{x}') AS {x}" for x in primaries.SOURCES)


@query("primary_party_coverage", f"SELECT year, {_SOURCE_COUNTS} FROM d_ppl GROUP BY year")
def _(v):
    return primaries.coverage_by_source(parties(v))


@query(
    "primary_party_resolved",
    f"""SELECT year, count(*) FILTER (party IS NULL) AS unresolved, count(*) FILTER (party IS NOT NULL) AS resolved
        FROM d_ppl WHERE office_level IN {PARTISAN} GROUP BY year""",
)
def _(v):
    return primaries.coverage_resolved(parties(v))


@query(
    "primary_party_elections",
    "SELECT year, count(*) AS elections FROM (SELECT DISTINCT year, race, party FROM d_ppl WHERE party IS NOT NULL) AS e GROUP BY year",
)
def _(v):
    return primaries.coverage_elections(parties(v))


@query("primary_unresolved", "SELECT year, race, candidate, office, '' AS party, source AS note FROM d_unresolved")
def _(v):
    return unresolved(v)


@query(
    "worksheet_seed",
    f"""SELECT year, race, candidate, '' AS party FROM (
        SELECT year, race, '' AS candidate FROM d_ppl GROUP BY year, race
            HAVING bool_or(coalesce(office_level IN {PARTISAN}, false)) AND NOT bool_or(party IS NOT NULL)
        UNION ALL
        SELECT year, race, candidate FROM d_ppl JOIN (SELECT year, race FROM d_ppl GROUP BY year, race
            HAVING bool_or(coalesce(office_level IN {PARTISAN}, false)) AND bool_or(party IS NOT NULL)) AS r USING (year, race)
        WHERE office_level IN {PARTISAN} AND party IS NULL) AS w""",
)
def _(v):
    return primaries.worksheet_seed(parties(v))


@query(
    "override_merge",
    f"""SELECT year, race, candidate, party FROM (SELECT *, row_number() OVER (PARTITION BY year, race, candidate
            ORDER BY length(coalesce(party, '')) DESC, src, party NULLS FIRST) AS rn
        FROM (SELECT year, race, coalesce(candidate, '') AS candidate, party, 0 AS src FROM manual_raw
            UNION ALL SELECT year, race, candidate, {s.party_code("party")}, 1 FROM todo_raw WHERE {s.party_code("party")} IS NOT NULL) AS m) AS r
        WHERE rn = 1""",
)
def _(v):
    return primaries.merged_overrides(v.manual_raw, primaries.filled_worksheet(v.todo_raw))


@query("roster_match", "SELECT year, race, candidate, party FROM d_matched")
def roster_match(v):
    return rosters.matched_candidates(roster_status(v))


@query("roster_match_year", "SELECT year, race, candidate, party FROM d_matched WHERE year = 2018")
def _(v):
    return rosters.matched_candidates(rosters.roster_status(unresolved(v), v.roster, year=2018))


@query(
    "roster_match_report",
    """SELECT year, unresolved, coalesce(matched, 0) AS matched, round_even(coalesce(matched, 0) * 100.0 / unresolved, 0)::DOUBLE AS match_pct
        FROM (SELECT year, count(*) AS unresolved FROM d_unresolved GROUP BY year) AS a
        LEFT JOIN (SELECT year, count(*) AS matched FROM d_matched GROUP BY year) AS b USING (year)""",
)
def _(v):
    return rosters.match_rate(roster_status(v))


@query(
    "roster_matched_by_office",
    "SELECT office, count(*) AS n FROM d_matched m JOIN d_unresolved u USING (year, race, candidate) GROUP BY office",
)
def _(v):
    return rosters.matched_by_office(roster_status(v))


@query(
    "roster_unmatched_by_office",
    "SELECT office, count(*) AS n FROM d_unresolved u ANTI JOIN d_matched m USING (year, race, candidate) GROUP BY office",
)
def _(v):
    return rosters.unmatched_by_office(roster_status(v))


# Legislation


@query("session_list", "SELECT DISTINCT session FROM sponsors")
def _(v):
    return legislation.session_list(v.sponsors)


@query("last_update", "SELECT 'Last Update: ' || strftime(update_day, '%B %-d, %Y') AS last_update FROM update_day")
def _(v):
    return legislation.last_update(v.update_day)


@query(
    "bill_list",
    "SELECT session, bill_num, title, bill_summary, last_action, passed_house, passed_senate, passed FROM bills WHERE starts_with(bill_num, 'h')",
)
def _(v):
    return legislation.bill_list(v.bills, "house")


@query("bill_overview", "SELECT * FROM d_overview")
def bill_overview(v):
    return legislation.bill_overview(v.bills, v.sponsors, v.legislators)


@query(
    "sponsor_list",
    """SELECT session, bill_num, array_to_string(list_transform(string_split(spon_list, ';'), lambda e: string_split(e, '|')[1]), ', ') AS sponsor_text,
        array_to_string(list_transform(string_split(spon_list, ';'), lambda e: CASE WHEN string_split(e, '|')[2] = 'Republican' THEN 'red'
            WHEN string_split(e, '|')[2] = 'Democratic' THEN 'blue' ELSE 'none' END), ', ') AS sponsor_colors
        FROM d_overview WHERE spon_list IS NOT NULL""",
)
def _(v):
    return legislation.sponsor_list(bill_overview(v))


@query(
    "bill_header",
    r"""SELECT b.session, b.bill_num, title, bill_summary, coalesce(sponsors_, '') AS sponsors FROM bills b LEFT JOIN (
        SELECT session, bill_num, regexp_replace(string_agg(CASE WHEN party IN ('Democratic', 'Republican')
            THEN coalesce(name, 'NA') || CASE WHEN chief_sponsor = '1' THEN '*' ELSE '' END || ', ' ELSE 'NA' END, ''
            ORDER BY chief_sponsor = '1' DESC, legislator_id), ', $', '') AS sponsors_
        FROM d_signed GROUP BY ALL) s ON b.session = s.session AND b.bill_num = s.bill_num""",
)
def _(v):
    return legislation.bill_header(v.bills, v.sponsors, v.legislators)


@query("bill_actions", "SELECT session, bill_num, strftime(date, '%Y-%m-%d') AS date, action, seq FROM actions")
def _(v):
    return legislation.bill_actions(v.actions)


@query(
    "vote_summary",
    """SELECT session, bill_num, chamber_ AS chamber, vote, count(*) AS "Total", count(*) FILTER (party = 'Democratic') AS "Democratic",
        count(*) FILTER (party = 'Republican') AS "Republican", nullif(count(*) FILTER (party IS NULL), 0) AS no_party,
        count(*) FILTER (party NOT IN ('Democratic', 'Republican')) AS other_party
        FROM d_roll GROUP BY ALL""",
)
def _(v):
    return legislation.vote_summary(v.roll, v.legislators)


_VOTE_SHOWN = "CASE vote WHEN 'YEA' THEN '✔️ YEA' WHEN 'NAY' THEN '❌ NAY' ELSE vote END AS vote_shown"


@query("roll_call", f"SELECT session, bill_num, chamber_ AS chamber, name, party, vote, {_VOTE_SHOWN} FROM d_roll")
def _(v):
    return legislation.roll_call(v.roll, v.legislators)


@query(
    "session_legislators",
    """SELECT session, legislator_id, name || ' (' || chamber || ')' AS label
        FROM (UNPIVOT legislators ON COLUMNS('ga_.*') INTO NAME flag VALUE serving) AS u
        JOIN (SELECT DISTINCT session FROM sponsors) AS s ON flag = 'ga_' || substring(session, 3, 2) WHERE try_cast(serving AS INTEGER) = 1""",
)
def _(v):
    return legislation.session_legislators(v.sponsors, v.legislators)


@query("legislator_profile", "SELECT legislator_id, full_name, party, chamber, district, img_src, lrc_link FROM legislators")
def _(v):
    return legislation.legislator_profile(v.legislators)


@query(
    "legislator_votes",
    """SELECT legislator_id, session, upper(bill_num) AS bill_num, vote,
        CASE WHEN vote = 'YEA' THEN '✔️ YEA' WHEN vote IS NOT NULL THEN '❌ NAY' END AS vote_shown FROM roll""",
)
def _(v):
    return legislation.legislator_votes(v.roll)


@query(
    "legislator_sponsorships",
    """SELECT legislator_id, s.session, upper(CASE WHEN chief_sponsor = '1' THEN s.bill_num || '*' ELSE s.bill_num END) AS bill_num, title
        FROM sponsors s LEFT JOIN bills b ON s.session = b.session AND s.bill_num = b.bill_num""",
)
def _(v):
    return legislation.legislator_sponsorships(v.sponsors, v.bills)


@query(
    "action_days",
    r"""SELECT DISTINCT session, strftime(date, '%Y-%m-%d') AS date FROM actions
        WHERE year(date) = try_cast(regexp_replace(session, '\D', '', 'g') AS BIGINT)""",
)
def _(v):
    return legislation.action_days(v.actions)


@query("actions_by_day", "SELECT session, strftime(date, '%Y-%m-%d') AS date, upper(bill_num) AS bill_num, action, seq FROM actions")
def _(v):
    return legislation.actions_by_day(v.actions)


@query(
    "actions_by_day_groups",
    "SELECT session, strftime(date, '%Y-%m-%d') AS date, upper(bill_num) AS bill_num, count(*) AS n_actions FROM actions GROUP BY ALL",
)
def _(v):
    return legislation.actions_by_day_groups(v.actions)


@query(
    "bill_link",
    r"""SELECT session, bill_num, 'https://apps.legislature.ky.gov/record/' || substring(regexp_extract(session, '\d{4}'), 3) || 'rs/'
        || upper(bill_num) || '.html' AS link FROM bills""",
)
def _(v):
    return legislation.bill_links(v.bills)


# Campaign finance


@query(
    "fund_elections",
    f"""SELECT {s.title("election_type")} || ' ' || year(d) AS election_select, strftime(d, '%Y-%m-%d') AS election_date
        FROM (SELECT election_date AS d, min(election_type) AS election_type FROM contrib GROUP BY 1) AS t""",
)
def _(v):
    return choices.election_dates(v.contrib)


@query(
    "fund_offices",
    s.choices(
        f"""(SELECT strftime(d, '%Y-%m-%d') AS election_date, value AS label, * EXCLUDE (d)
            FROM ({s.classified(f"(SELECT election_date AS d, {s.title('office_sought')} AS value FROM contrib)", "value", "d")}) AS k) AS c""",
        "election_date",
    ),
)
def _(v):
    return choices.office_choices(v.contrib)


@query(
    "fund_candidates",
    f"""SELECT DISTINCT strftime(election_date, '%Y-%m-%d') AS election_date, office_sought,
        {s.paste("recipient_first_name", "recipient_last_name")} AS candidate_name, candidate FROM contrib""",
)
def _(v):
    return choices.candidate_choices(v.contrib)


_TOTALS = f"""SELECT c.*, coalesce(p.total_spend, 0) AS total_spend, total_raise - coalesce(p.total_spend, 0) AS cash_on_hand, individual_max_contribs
    FROM (SELECT election_date, office_sought, candidate, coalesce(sum(amount), 0) AS total_raise,
            CAST(sum(amount) AS DOUBLE) / nullif(count(amount), 0) AS avg_contrib,
            count(DISTINCT contributor) + CASE WHEN bool_or(contributor IS NULL) THEN 1 ELSE 0 END AS unique_contrib,
            CASE WHEN bool_or(state = 'KY' AND amount IS NULL) THEN NULL ELSE coalesce(sum(amount) FILTER (state = 'KY'), 0) END AS ky_raise,
            CASE WHEN bool_or(contribution_type = 'KYPAC' AND amount IS NULL) THEN NULL
                ELSE coalesce(sum(amount) FILTER (contribution_type = 'KYPAC'), 0) END AS pac_contrib
        FROM d_contrib GROUP BY ALL) AS c
    LEFT JOIN (SELECT election_date, office_sought, candidate, sum(disbursement_amount) AS total_spend FROM expend GROUP BY ALL) AS p
        USING (election_date, office_sought, candidate)
    LEFT JOIN (SELECT election_date, office_sought, candidate, count(*) FILTER (amount >= 2000) AS individual_max_contribs FROM d_person GROUP BY ALL) AS i
        USING (election_date, office_sought, candidate)"""


@query(
    "finance_totals",
    f"""SELECT {CAMPAIGN}, CAST(total_raise AS DOUBLE) AS total_raise, CAST(total_spend AS DOUBLE) AS total_spend,
        CAST(cash_on_hand AS DOUBLE) AS cash_on_hand, unique_contrib, avg_contrib, CAST(ky_raise AS DOUBLE) AS ky_raise,
        coalesce(individual_max_contribs, 0) AS individual_max_contribs, CAST(pac_contrib AS DOUBLE) AS pac_contrib FROM ({_TOTALS}) AS t""",
)
def finance_totals(v):
    return fundraising.finance_totals(v.contrib, v.expend)


_LINES = {
    "Total Amount Raised": s.dollar("round_even(total_raise, 0)"),
    "Total Amount Spent": s.dollar("round_even(total_spend, 0)"),
    "Cash on Hand": s.dollar("round_even(cash_on_hand, 0)"),
    "Unique Contributors": s.comma("unique_contrib"),
    "Average Contribution": s.dollar("round_even(avg_contrib, 2)"),
    "Contributions from Kentucky": s.dollar("round_even(ky_raise, 0)"),
    "Number of $2000 Contributions": s.comma("coalesce(individual_max_contribs, 0)"),
    "Total PAC Money Raised": s.dollar("round_even(pac_contrib, 0)"),
}


@query(
    "finance_summary",
    " UNION ALL ".join(f"SELECT {CAMPAIGN}, {s.text(line)} AS name, {expr} AS value FROM ({_TOTALS}) AS t" for line, expr in _LINES.items()),
)
def finance_summary(v):
    return fundraising.finance_summary(v.contrib, v.expend)


@query(
    "burn_rate",
    f"""SELECT {CAMPAIGN}, strftime(day, '%Y-%m-%d') AS date, CAST(coalesce(contributions, 0) AS DOUBLE) AS contributions,
        CAST(coalesce(disbursement, 0) AS DOUBLE) AS disbursement,
        CAST(sum(coalesce(contributions, 0)) OVER w AS DOUBLE) AS cs_contrib, CAST(sum(coalesce(disbursement, 0)) OVER w AS DOUBLE) AS cs_disburse
        FROM (SELECT election_date, office_sought, candidate, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day
            FROM (SELECT election_date, office_sought, candidate, min(date) AS a, max(date) AS b FROM d_daily GROUP BY ALL) AS ends) AS spine
        LEFT JOIN (SELECT election_date, office_sought, candidate, date AS day, contributions, disbursement FROM d_daily) AS d
            USING (election_date, office_sought, candidate, day)
        WINDOW w AS (PARTITION BY election_date, office_sought, candidate ORDER BY day)""",
)
def burn_rate(v):
    return fundraising.burn_rate(v.contrib, v.expend)


@query("contributor_distribution", f"SELECT {CAMPAIGN}, contributor, CAST(amount AS DOUBLE) AS amount FROM d_person")
def _(v):
    return fundraising.contributor_totals(v.contrib)


def _hinge(p: float) -> str:
    at = f"least(greatest(n * {p!r}::DOUBLE - 5e-1, 0e0), n - 1e0)"
    low, high = f"max(a) FILTER (i = floor({at}))", f"max(a) FILTER (i = ceil({at}))"
    return f"{low} + ({high} - {low}) * max({at} - floor({at}))"


@query(
    "contributor_box",
    f"""SELECT {CAMPAIGN}, {_hinge(0.0)} AS low, {_hinge(0.25)} AS q1, {_hinge(0.5)} AS median, {_hinge(0.75)} AS q3, {_hinge(1.0)} AS high
        FROM (SELECT election_date, office_sought, candidate, CAST(amount AS DOUBLE) AS a,
                row_number() OVER (PARTITION BY election_date, office_sought, candidate ORDER BY amount) - 1 AS i,
                count(*) OVER (PARTITION BY election_date, office_sought, candidate) AS n
            FROM d_person WHERE amount IS NOT NULL) AS r GROUP BY election_date, office_sought, candidate""",
)
def contributor_box(v):
    return fundraising.contributor_box(v.contrib)


@query(
    "giving_by_county",
    f"""SELECT {CAMPAIGN}, upper(c.name) AS name, county, CAST(amount AS DOUBLE) AS amount, bin, label,
            coalesce(fill_col, '{colors.NO_VALUE_FILL}') AS fill_col, xmin, ymin, xmax, ymax
        FROM counties c LEFT JOIN d_giving g ON upper(c.name) = upper(county)""",
)
def giving_by_county(v):
    return fundraising.giving_map(v.contrib, tables.zip_dimension(v.zip_county), v.counties)


@query(
    "out_of_state",
    f"SELECT {CAMPAIGN}, state, {s.nasum('amount', 'DOUBLE')} AS amount FROM contrib WHERE state <> 'KY' GROUP BY election_date, office_sought, candidate, state",
)
def _(v):
    return fundraising.out_of_state(v.contrib)


@query(
    "contribution_list",
    f"""SELECT {CAMPAIGN}, {s.payer("from_organization_name", "contributor_first_name", "contributor_last_name")} AS contributor,
        CAST(amount AS DOUBLE) AS amount, strftime(receipt_date, '%Y-%m-%d') AS receipt_date, city, state, zip, occupation, employer,
        contribution_mode, contribution_type FROM contrib""",
)
def _(v):
    return fundraising.contribution_list(v.contrib)


@query(
    "expenditure_list",
    f"""SELECT {CAMPAIGN}, {s.payer("organization_name", "recipient_first_name", "recipient_last_name")} AS recipient,
        CAST(disbursement_amount AS DOUBLE) AS disbursement_amount, strftime(disbursement_date, '%Y-%m-%d') AS disbursement_date,
        purpose, occupation, disbursement_code FROM expend""",
)
def _(v):
    return fundraising.expenditure_list(v.expend)


# Districts


@query("district_list", "SELECT DISTINCT chamber, district FROM district_precincts")
def _(v):
    return districts.district_list(v.district_precincts)


@query("district_precincts", "SELECT chamber, district, county, precinct FROM district_precincts")
def _(v):
    return districts.precincts_of(v.district_precincts)


@query(
    "district_races",
    """SELECT DISTINCT chamber, district, year, race FROM election_data JOIN district_precincts USING (county, precinct) WHERE election = 'general'""",
)
def _(v):
    return districts.district_races(v.election_data, v.district_precincts)


@query("district_results", f"SELECT chamber, district, {CONTEST}, county, precinct, candidate, party, votes FROM d_district_rows")
def _(v):
    return district_rows(v)


@query(
    "district_summary",
    f"SELECT chamber, district, {CONTEST}, candidate, {s.nasum()} AS votes FROM d_district_rows GROUP BY chamber, district, {CONTEST}, candidate",
)
def district_summary(v):
    return districts.district_summary(district_rows(v))


@query("district_detail", s.wide("d_district_long", f"chamber, district, {CONTEST}", "party", True))
def _(v):
    return districts.district_detail(district_rows(v))


@query("district_detail_listed", s.listed("d_district_long", f"chamber, district, {CONTEST}", "party", True))
def _(v):
    return districts.district_detail_listed(district_rows(v))


@query(
    "district_map_data",
    f"""SELECT u.*, {s.step_fill("winner", "winning_share")} AS fill_col, fips, countyfp, vtdst, layer, name, xmin, ymin, xmax, ymax
        FROM ({s.winners("d_district_rows", f"chamber, district, {CONTEST}, county, precinct", extra=s.LABEL)}) AS u
        JOIN fips f ON u.county = f.county
        JOIN precinct_shapes g ON g.vtdst = '00' || precinct AND g.countyfp = substring(CAST(fips AS VARCHAR), 3, 3) AND layer = 'precincts'""",
)
def _(v):
    return districts.district_map(district_rows(v), v.fips, precinct_shapes(v))


_LAYERS = """SELECT plan, chamber, plan_label, district, count(*) AS npoints, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax
        FROM layer_vertices JOIN (VALUES ('house_plan_hcs', 'House', '2022 HCS'), ('house_plan', 'House', '2022 Original Bill'),
            ('house_plan_dem', 'House', '2022 Democratic Plan'), ('house_2014', 'House', '2014'), ('sen_plan', 'Senate', '2022'),
            ('sen_2014', 'Senate', '2014'), ('cong_plan', 'Congress', '2022')) AS t(plan, chamber, plan_label) USING (plan) GROUP BY ALL"""


def plan_layers(v: Views):
    """All versions of all plans with their own shapes, from one scan."""
    return districts.versioned_layers(polygons_from_vertices(v.layer_vertices, ["plan", "district"]))


@query("plan_layers", _LAYERS)
def _(v):
    return plan_layers(v).drop("rings")


@query(
    "district_outline",
    f"""SELECT chamber, district, plan, npoints, CAST(replace(district, 'District ', '') AS BIGINT) AS district_num, plan_label, xmin, ymin, xmax, ymax
        FROM ({_LAYERS}) AS l WHERE (chamber, plan) IN (('House', 'house_plan_hcs'), ('Senate', 'sen_plan'))""",
)
def _(v):
    return districts.district_outline(plan_layers(v)).drop("rings")


@query(
    "district_map_outlined",
    f"""SELECT u.chamber, u.district, {CONTEST}, u.county, precinct, winner, {s.step_fill("winner", "winning_share")} AS fill_col, g.xmin, g.ymin, g.xmax, g.ymax,
            o.plan AS outline_plan, npoints AS outline_points, o.xmin AS outline_xmin, o.ymin AS outline_ymin, o.xmax AS outline_xmax, o.ymax AS outline_ymax
        FROM ({s.winners("d_district_rows", f"chamber, district, {CONTEST}, county, precinct")}) AS u
        JOIN fips f ON u.county = f.county
        JOIN precinct_shapes g ON g.vtdst = '00' || precinct AND g.countyfp = substring(CAST(fips AS VARCHAR), 3, 3) AND layer = 'precincts'
        LEFT JOIN (SELECT * FROM ({_LAYERS}) AS l WHERE (chamber, plan) IN (('House', 'house_plan_hcs'), ('Senate', 'sen_plan'))) AS o
            ON o.chamber = u.chamber AND replace(o.district, 'District ', '') = replace(u.district, 'District ', '')""",
)
def _(v):
    shown = districts.district_map(district_rows(v), v.fips, precinct_shapes(v))
    shown = shown.select("chamber", "district", *elections.CONTEST, "county", "precinct", "winner", "fill_col", "xmin", "ymin", "xmax", "ymax")
    return districts.outlined_map(shown, plan_layers(v))


@query("candidate_directory", "SELECT * REPLACE (CAST(district AS VARCHAR) AS district) FROM d_directory")
def _(v):
    return districts.candidate_directory(v.candidates)


_MAP_COLUMNS = """office, first_name, middle_name, last_name, lrc_website, political_website, facebook, twitter, instagram, label"""


@query(
    "district_candidates_map",
    f"""SELECT 'House' AS chamber, d.n AS district, {_MAP_COLUMNS}, coalesce(fill, 'white') AS fill
        FROM (SELECT DISTINCT replace(district, 'District ', '') AS n FROM plan_vertices) d
        LEFT JOIN (SELECT * FROM d_directory WHERE office = 'State Representative') p ON d.n = CAST(p.district AS VARCHAR)
        UNION ALL SELECT 'Senate', d.n, {_MAP_COLUMNS},
            CASE WHEN fill IS NOT NULL THEN fill WHEN CAST(d.n AS INTEGER) % 2 <> 0 THEN 'white' ELSE 'black' END
        FROM (SELECT DISTINCT replace(district, 'District ', '') AS n FROM plan_vertices) d
        LEFT JOIN (SELECT * FROM d_directory WHERE office = 'State Senator') p ON d.n = CAST(p.district AS VARCHAR)""",
)
def _(v):
    both = [
        districts.district_candidates_map(plan(v), v.candidates, c).withColumn("chamber", F.lit(c)).drop("rings")
        for c in ("House", "Senate")
    ]
    return both[0].unionByName(both[1])


@query(
    "candidates_at_point",
    f"""SELECT chamber, id, x, y, CAST(p.district AS BIGINT) AS district_num, 'District ' || p.district AS district_label,
        CASE WHEN middle_name IS NULL THEN {s.paste("first_name", "last_name")} ELSE {s.paste("first_name", "middle_name", "last_name")} END AS name,
        political_website, lrc_website, facebook, twitter, instagram
        FROM d_inside i JOIN candidates p ON i.district = 'District ' || p.district
        JOIN (VALUES ('House', 'State Representative'), ('Senate', 'State Senator')) AS t(chamber, office_) ON office_ = office""",
)
def candidates_at_point(v):
    plans = plan(v).withColumn("chamber", F.explode(F.array(F.lit("House"), F.lit("Senate"))))
    return districts.candidates_at_point(v.points, plans, v.candidates)
