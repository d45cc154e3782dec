"""DuckDB SQL fragments and helper subqueries for checking results."""

from __future__ import annotations

from ..functions import colors, offices
from ..functions.semantics import WORD_OR_GAP
from .views import dialect, with_clauses


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def title(expr: str) -> str:
    pieces = f"regexp_extract_all(lower({expr}), {text(WORD_OR_GAP)}, 1)"
    return f"array_to_string(list_transform({pieces}, lambda p: upper(p[1]) || p[2:]), '')"


def nasum(expr: str = "votes", kind: str = "BIGINT") -> str:
    return f"CASE WHEN bool_or({expr} IS NULL) THEN NULL ELSE CAST(sum({expr}) AS {kind}) END"


def paste(*exprs: str, sep: str = " ") -> str:
    return f" || {text(sep)} || ".join(f"coalesce(CAST({e} AS VARCHAR), 'NA')" for e in exprs)


def comma(expr: str) -> str:
    return f"format('{{:,}}', CAST({expr} AS BIGINT))"


def dollar(expr: str) -> str:
    cents = f"format('{{:,.2f}}', CAST(abs({expr}) AS DOUBLE))"
    whole = f"format('{{:,}}', CAST(round_even(abs({expr}), 0) AS BIGINT))"
    return (
        f"CASE WHEN {expr} < 0 THEN '-$' ELSE '$' END || "
        f"CASE WHEN abs({expr}) < 100000 AND {expr} <> floor({expr}) THEN {cents} ELSE {whole} END"
    )


def office(expr: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches(lower({expr}), {text(p)}) THEN {text(name)}" for p, name in offices.OFFICE_PATTERNS
    )
    return f"CASE {whens} ELSE {text(offices.OTHER_OFFICE)} END"


def level(expr: str) -> str:
    whens = " ".join(
        f"WHEN {expr} IN ({', '.join(map(text, members))}) THEN {text(name)}"
        for name, members in offices.OFFICES_BY_LEVEL.items()
    )
    return f"CASE {whens} END"


def roster_office(expr: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches(lower({expr}), {text(p)}) THEN {text(name)}" for p, name in reversed(offices.ROSTER_OVERRIDES)
    )
    return f"CASE {whens} ELSE {office(expr)} END"


def classified(source: str, column: str, keep: str = "") -> str:
    """Subquery adding the four office columns to the distinct rows of a source."""
    more = f"{keep}, " if keep else ""
    members = ", ".join(map(text, offices.DISTRICT_OFFICES))
    return f"""SELECT {more}{column}, {level("office")} AS office_level, office,
        CASE WHEN office IN ({members})
            THEN nullif(regexp_extract(lower({column}), {text(offices.DISTRICT_PATTERN)}, 1), '') END AS district,
        CASE WHEN {level("office")} = 'local'
            THEN trim(nullif(regexp_extract({column}, {text(offices.CITY_PATTERN)}, 1), '')) END AS jurisdiction
        FROM (SELECT DISTINCT {more}{column}, {office(column)} AS office FROM {source}) AS named"""


def level_rank(expr: str) -> str:
    names = ", ".join(map(text, offices.LEVEL_LABELS))
    return f"CAST(list_position([{names}], coalesce({expr}, 'local')) AS BIGINT)"


def level_label(expr: str) -> str:
    whens = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in offices.LEVEL_LABELS.items())
    return f"CASE coalesce({expr}, 'local') {whens} END"


def choices(source: str, keys: str) -> str:
    """Numbered pick list over a source with value, label, office_level, office and district."""
    return f"""SELECT {keys}, {level_rank("office_level")} AS group_rank, {level_label("office_level")} AS group_label,
        row_number() OVER (PARTITION BY {keys}, {level_rank("office_level")}
            ORDER BY office NULLS LAST, try_cast(district AS INTEGER) NULLS LAST, lower(value), value) AS item_rank,
        value, label FROM {source}"""


def name_key(expr: str) -> str:
    head = f"regexp_replace({expr}, '/.*$', '')"
    plain = f"""regexp_replace(regexp_replace({head}, '"[^"]*"', ' ', 'g'), '[.,]', ' ', 'g')"""
    return rf"upper(trim(regexp_replace({plain}, '\s+', ' ', 'g')))"


def first_last(expr: str) -> str:
    return (
        f"CASE WHEN len(string_split({expr}, ' ')) >= 2 "
        f"THEN string_split({expr}, ' ')[1] || ' ' || string_split({expr}, ' ')[-1] ELSE {expr} END"
    )


def party_code(expr: str) -> str:
    clean = f"upper(trim({expr}))"
    return (
        f"CASE WHEN {clean} IN ('REP', 'REPUBLICAN', 'R') THEN 'REP' "
        f"WHEN {clean} IN ('DEM', 'DEMOCRAT', 'DEMOCRATIC', 'D') THEN 'DEM' "
        f"WHEN {clean} IN ('IND', 'INDEPENDENT', 'I') THEN 'IND' END"
    )


def payer(org: str, first: str, last: str, address: str | None = None) -> str:
    person = paste(first, last, address) if address else paste(first, last)
    return f"CASE WHEN {org} IS NULL AND {last} IS NULL THEN NULL WHEN {org} IS NULL THEN {person} ELSE {org} END"


def ramp_t(share: str) -> str:
    return f"greatest(least(coalesce(({share} - 5e-1) / (85e-2 - 5e-1), 0e0), 1e0), 0e0)"


def step_fill(winner: str, share: str) -> str:
    whens = " ".join(
        f"WHEN {winner} = '{party}'" + (f" AND {share} {sign} {limit!r}" if sign else "") + f" THEN '{fill}'"
        for party, sign, limit, fill in colors.STEPS
    )
    return f"CASE {whens} ELSE '{colors.STEP_DEFAULT}' END"


def bin_fill(bin_: str, bins: str) -> str:
    whens = " ".join(f"WHEN {bins} <= {n} THEN {fills!r}" for n, fills in colors.BIN_FILLS.items() if n < 5)
    return f"(CASE {whens} ELSE {colors.BIN_FILLS[5]!r} END)[{bin_}]"


def painted(units: str, winner: str = "winner", share: str = "winning_share") -> str:
    """Subquery adding ramp_t and the Lab-blended fill_col to rows with a winner and a share, one step per level."""

    def constant(ramp: list[str], axis: int) -> str:
        return "[" + ", ".join(f"{colors.lab_of(stop)[axis]!r}::DOUBLE" for stop in ramp) + "]"

    def stops(axis: int) -> str:
        whens = " ".join(f"WHEN '{party}' THEN {constant(ramp, axis)}" for party, ramp in colors.RAMPS.items())
        return f"CASE {winner} {whens} END AS s{axis}"

    def cube(f: str) -> str:
        return (
            f"CASE WHEN {f} * {f} * {f} > {colors.LAB_EPSILON!r}::DOUBLE THEN {f} * {f} * {f} "
            f"ELSE ({f} * 116 - 16) / {colors.LAB_KAPPA!r}::DOUBLE END"
        )

    def channel(c: str) -> str:
        gamma = (
            f"CASE WHEN {c} <= 0.0031308::DOUBLE THEN {c} * 12.92::DOUBLE "
            f"ELSE pow(greatest({c}, 0e0), {1 / 2.4!r}::DOUBLE) * 1.055::DOUBLE - 0.055::DOUBLE END"
        )
        return f"format('{{:02x}}', CAST(floor(greatest(least({gamma}, 1e0), 0e0) * 255 + 5e-1) AS INTEGER))"

    mixed = ", ".join(f"s{i}[low + 1] + (s{i}[low + 2] - s{i}[low + 1]) * (at_ - low) AS m{i}" for i in range(3))
    xyz = ", ".join(f"({cube(f)}) * {w!r}::DOUBLE AS {n}" for f, w, n in zip(("fx", "fy", "fz"), colors.WHITE, ("x_", "y_", "z_")))
    rgb = ", ".join(
        f"x_ * {row[0]!r}::DOUBLE + y_ * {row[1]!r}::DOUBLE + z_ * {row[2]!r}::DOUBLE AS {n}"
        for row, n in zip(colors.XYZ_TO_RGB, ("r_", "g_", "b_"))
    )
    levels = [
        f"SELECT *, {ramp_t(share)} AS ramp_t, {stops(0)}, {stops(1)}, {stops(2)} FROM ({units}) AS p0",
        "SELECT *, ramp_t * (len(s0) - 1) AS at_, CAST(least(floor(ramp_t * (len(s0) - 1)), len(s0) - 2) AS INTEGER) AS low FROM ({}) AS p1",
        f"SELECT *, {mixed} FROM ({{}}) AS p2",
        "SELECT *, (m0 + 16) / 116 + m1 / 500 AS fx, (m0 + 16) / 116 AS fy, (m0 + 16) / 116 - m2 / 200 AS fz FROM ({}) AS p3",
        f"SELECT *, {xyz} FROM ({{}}) AS p4",
        f"SELECT *, {rgb} FROM ({{}}) AS p5",
    ]
    statement = levels[0]
    for outer in levels[1:]:
        statement = outer.replace("{}", statement)
    names = ", ".join(f"'{p}'" for p in colors.RAMPS)
    fill = f"CASE WHEN {winner} IN ({names}) THEN '#' || {channel('r_')} || {channel('g_')} || {channel('b_')} ELSE '{colors.NO_PARTY_FILL}' END"
    helpers = "s0, s1, s2, at_, low, m0, m1, m2, fx, fy, fz, x_, y_, z_, r_, g_, b_"
    return f"SELECT * EXCLUDE ({helpers}), {fill} AS fill_col FROM ({statement}) AS p6"


CONTEST = "year, election, race"
PRIMARY = CONTEST + ", token"


def winners(source: str, unit: str, prize: str = "party", ties: bool = True, extra: str = "") -> str:
    """Winner of each unit the long way round: ranked rows and a count of rows at the top score."""
    tie = (
        f"CASE WHEN bool_or(votes IS NULL) THEN NULL WHEN sum(CASE WHEN votes = top THEN 1 ELSE 0 END) = 1 "
        f"THEN max(CASE WHEN rn = 1 THEN {prize} END) ELSE 'Tie' END"
        if ties
        else f"max(CASE WHEN rn = 1 AND votes IS NOT NULL THEN {prize} END)"
    )
    more = f", {extra}" if extra else ""
    return f"""SELECT {unit}, {tie} AS winner, CAST(max(top) AS BIGINT) AS winning_votes, {nasum()} AS total_votes,
        max(top) / nullif(CAST({nasum()} AS DOUBLE), 0) AS winning_share{more}
        FROM (SELECT *, max(votes) OVER (PARTITION BY {unit}) AS top,
            row_number() OVER (PARTITION BY {unit} ORDER BY votes DESC NULLS LAST, candidate, party) AS rn
            FROM {source}) AS ranked GROUP BY {unit}"""


LABEL = (
    "string_agg(candidate || ': ' || coalesce(format('{:,}', votes), 'NA'), '<br>' ORDER BY candidate, party, votes NULLS FIRST) AS label"
)


def slots(source: str, contest: str) -> str:
    return f"""SELECT {contest}, candidate, row_number() OVER (PARTITION BY {contest} ORDER BY first_unit, candidate) AS slot,
        count(*) OVER (PARTITION BY {contest}) AS n_candidates, contest_votes
        FROM (SELECT {contest}, candidate, min(unit) AS first_unit, {nasum()} AS contest_votes FROM {source} GROUP BY {contest}, candidate) AS firsts"""


def wide(source: str, contest: str, prize: str, ties: bool) -> str:
    cols = ", ".join(
        f"max(CASE WHEN slot = {n} THEN candidate END) AS can{n}, max(CASE WHEN slot = {n} THEN contest_votes END) AS can{n}_total, "
        f"CAST(sum(CASE WHEN slot = {n} THEN votes END) AS BIGINT) AS can{n}_votes"
        for n in range(1, 5)
    )
    shares = ", ".join(f"can{n}_votes / nullif(CAST(total_votes AS DOUBLE), 0) AS can{n}_pct" for n in range(1, 5))
    joined = f"(SELECT s.*, t.slot, t.n_candidates, t.contest_votes FROM {source} s JOIN ({slots(source, contest)}) t USING ({contest}, candidate) WHERE n_candidates BETWEEN 2 AND 4)"
    units = winners(joined, f"{contest}, unit", prize, ties, f"{cols}, max(n_candidates) AS n_candidates")
    return f"SELECT * EXCLUDE (winning_votes, winning_share), {shares} FROM ({units}) AS u"


def listed(source: str, contest: str, prize: str, ties: bool) -> str:
    joined = f"(SELECT s.*, t.contest_votes FROM {source} s JOIN ({slots(source, contest)}) t USING ({contest}, candidate) WHERE n_candidates NOT BETWEEN 2 AND 4)"
    return f"""SELECT {contest}, unit, winner, candidate, votes, contest_votes FROM {joined} AS l
        JOIN (SELECT {contest}, unit, winner FROM ({winners(joined, contest + ", unit", prize, ties)}) AS w1) AS w
        USING ({contest}, unit)"""


_PARTISAN = "('federal', 'state_exec', 'state_leg', 'county')"

DERIVED = {
    "d_rows": f"SELECT DISTINCT {CONTEST}, county, precinct, candidate, party, votes FROM election_data",
    "d_crosswalk": classified("race_strings", "race"),
    "d_lookup": f"SELECT * FROM ({classified('ballots', 'race')}) AS c",
    "d_overrides": """SELECT DISTINCT year, race, coalesce(candidate, '') AS candidate, upper(trim(party)) AS party FROM manual_raw
        WHERE party IS NOT NULL AND trim(party) <> ''""",
    "d_county_long": f"SELECT {CONTEST}, county, county AS unit, candidate, party, {nasum()} AS votes FROM d_rows GROUP BY ALL",
    "d_precinct_long": f"""SELECT {CONTEST}, upper(county) || ' - ' || precinct AS unit, candidate, party, {nasum()} AS votes
        FROM d_rows WHERE precinct <> 'county' GROUP BY ALL""",
    "d_rank": f"""SELECT {CONTEST}, candidate, votes, pct,
        row_number() OVER (PARTITION BY {CONTEST} ORDER BY pct DESC NULLS LAST, candidate) AS cnt
        FROM (SELECT *, votes / nullif(CAST(CASE WHEN bool_or(votes IS NULL) OVER w THEN NULL ELSE sum(votes) OVER w END AS DOUBLE), 0) AS pct
            FROM (SELECT {CONTEST}, candidate, {nasum()} AS votes FROM d_rows GROUP BY ALL) AS t
            WINDOW w AS (PARTITION BY {CONTEST})) AS shares""",
    "d_map_rows": f"""SELECT r.year, r.election, r.race, county, precinct, candidate,
            CASE WHEN election = 'primary' THEN 'IND' || cnt ELSE party END AS party, r.votes
        FROM d_rows r LEFT JOIN (SELECT {CONTEST}, candidate, cnt FROM d_rank) AS k USING ({CONTEST}, candidate)""",
    "d_prim": """SELECT DISTINCT year, race, candidate FROM ballots WHERE election = 'primary'""",
    "d_prim_keyed": f"""SELECT p.*, office, office_level, district, {name_key("candidate")} AS nkey
        FROM d_prim p LEFT JOIN d_lookup l ON p.race = l.race""",
    "d_gen": f"""SELECT DISTINCT g.year, office, district, {name_key("candidate")} AS nkey, party
        FROM (SELECT DISTINCT year, race, candidate, party FROM ballots WHERE election = 'general' AND party IN ('REP', 'DEM')) AS g
        LEFT JOIN d_lookup l ON g.race = l.race""",
    "d_cand_match": """SELECT p.year, p.race, p.candidate,
            CASE WHEN count(DISTINCT party) = 1 THEN min(party) END AS general_cand
        FROM d_prim_keyed p JOIN d_gen g ON p.year = g.year AND p.office IS NOT DISTINCT FROM g.office
            AND p.district IS NOT DISTINCT FROM g.district AND p.nkey = g.nkey GROUP BY ALL""",
    "d_race_sig": """SELECT year, race, CASE WHEN count(DISTINCT general_cand) = 1 THEN min(general_cand) END AS race_party
        FROM d_cand_match WHERE general_cand IS NOT NULL GROUP BY ALL""",
    "d_ppl": f"""SELECT year, race, candidate, office, office_level,
            CASE source WHEN 'manual_cand' THEN mc WHEN 'manual_race' THEN mr WHEN 'suffix' THEN suffix
                WHEN 'general' THEN general_cand WHEN 'race_inferred' THEN race_party END AS party, source
        FROM (SELECT *, CASE WHEN mc IS NOT NULL THEN 'manual_cand' WHEN mr IS NOT NULL THEN 'manual_race'
                WHEN office_level IS NULL OR office_level NOT IN {_PARTISAN} THEN 'nonpartisan'
                WHEN suffix IS NOT NULL THEN 'suffix' WHEN general_cand IS NOT NULL THEN 'general'
                WHEN race_party IS NOT NULL THEN 'race_inferred' ELSE 'unresolved' END AS source
            FROM (SELECT p.year, p.race, p.candidate, office, office_level, mc, mr, general_cand, race_party,
                    CASE WHEN contains(upper(p.race), 'DEMOCRAT') THEN 'DEM' WHEN contains(upper(p.race), 'REPUBLIC') THEN 'REP' END AS suffix
                FROM d_prim_keyed p
                LEFT JOIN (SELECT year, race, candidate, party AS mc FROM d_overrides WHERE candidate <> '') a USING (year, race, candidate)
                LEFT JOIN (SELECT year, race, party AS mr FROM d_overrides WHERE candidate = '') b USING (year, race)
                LEFT JOIN d_cand_match c USING (year, race, candidate)
                LEFT JOIN d_race_sig s USING (year, race)) AS j) AS k""",
    "d_pieces": """SELECT *, sum(CASE WHEN starts_with(piece, '<div') THEN 1 WHEN starts_with(piece, '</div') THEN -1 ELSE 0 END)
            OVER (PARTITION BY page_id ORDER BY i) AS depth
        FROM (SELECT page_id, url, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i
            FROM (SELECT page_id, url, string_split(regexp_replace(html, '(</?div\\b)', chr(1) || '\\1', 'g'), chr(1)) AS pieces FROM county_pages) AS s) AS u""",
    "d_split": """SELECT year, election, race, county, precinct, candidate, CASE WHEN token IN ('DEM', 'REP') THEN token ELSE party END AS party, votes, token
        FROM (SELECT *, unnest(CASE WHEN known IN ('DEM', 'REP') THEN [known, '__ALL__'] WHEN known IS NULL THEN ['__UNLABELED__', '__ALL__']
                ELSE ['__ALL__'] END) AS token
            FROM (SELECT b.year, b.election, b.race, b.county, b.precinct, b.candidate, b.party, b.votes, p.party AS known
                FROM (SELECT DISTINCT * FROM ballots WHERE election = 'primary') b
                LEFT JOIN d_ppl p ON b.year = p.year AND b.race = p.race AND b.candidate = p.candidate) AS m) AS t""",
    "d_split_county_long": f"""SELECT {PRIMARY}, county AS unit, candidate, party, {nasum()} AS votes FROM d_split
        GROUP BY {PRIMARY}, county, candidate, party""",
    "d_split_precinct_long": f"""SELECT {PRIMARY}, upper(county) || ' - ' || precinct AS unit, candidate, party, {nasum()} AS votes
        FROM d_split WHERE precinct <> 'county' GROUP BY ALL""",
    "d_split_rank": f"""SELECT {PRIMARY}, candidate, votes, pct,
        row_number() OVER (PARTITION BY {PRIMARY} ORDER BY pct DESC NULLS LAST, candidate) AS cnt
        FROM (SELECT *, votes / nullif(CAST(CASE WHEN bool_or(votes IS NULL) OVER w THEN NULL ELSE sum(votes) OVER w END AS DOUBLE), 0) AS pct
            FROM (SELECT {PRIMARY}, candidate, {nasum()} AS votes FROM d_split GROUP BY {PRIMARY}, candidate) AS t
            WINDOW w AS (PARTITION BY {PRIMARY})) AS shares""",
    "d_split_map_rows": f"""SELECT r.year, r.election, r.race, r.token, county, precinct, candidate, 'IND' || cnt AS party, r.votes
        FROM d_split r LEFT JOIN (SELECT {PRIMARY}, candidate, cnt FROM d_split_rank) AS k USING ({PRIMARY}, candidate)""",
    "d_unresolved": f"SELECT year, race, candidate, office, source FROM d_ppl WHERE office_level IN {_PARTISAN} AND party IS NULL",
    "d_listed": f"""SELECT year, office, nkey, min(party) AS party FROM (SELECT year, {roster_office("office_bp")} AS office,
            {name_key("candidate")} AS nkey, party FROM roster) AS k GROUP BY ALL HAVING count(DISTINCT party) = 1""",
    "d_exact": f"""SELECT u.year, u.race, u.candidate, u.office, l.party FROM d_unresolved u
        JOIN d_listed l ON u.year = l.year AND u.office = l.office AND {name_key("u.candidate")} = l.nkey""",
    "d_loose": f"""SELECT u.year, u.race, u.candidate, u.office, f.party
        FROM (SELECT * FROM d_unresolved WHERE (year, race, candidate) NOT IN (SELECT (year, race, candidate) FROM d_exact)) u
        JOIN (SELECT year, office, {first_last("nkey")} AS fl, min(party) AS party FROM d_listed GROUP BY ALL
            HAVING count(DISTINCT party) = 1) f ON u.year = f.year AND u.office = f.office AND {first_last(name_key("u.candidate"))} = f.fl""",
    "d_matched": "SELECT DISTINCT year, race, candidate, party FROM (SELECT * FROM d_exact UNION ALL SELECT * FROM d_loose) AS m",
    "d_contrib": f"""SELECT *, {payer("from_organization_name", "contributor_first_name", "contributor_last_name", "address1")} AS contributor
        FROM contrib""",
    "d_person": f"""SELECT election_date, office_sought, candidate, contributor, {nasum("amount", "DECIMAL(38, 2)")} AS amount
        FROM d_contrib WHERE contribution_type = 'INDIVIDUAL' GROUP BY ALL""",
    "d_county_giving": f"""SELECT election_date, office_sought, candidate, county, {nasum("amount", "DECIMAL(38, 2)")} AS amount
        FROM (SELECT election_date, office_sought, candidate, zip, {nasum("amount", "DECIMAL(38, 2)")} AS amount FROM contrib GROUP BY ALL) AS z
        LEFT JOIN zip_county ON zip = CAST(zip_code AS VARCHAR) GROUP BY ALL""",
    "d_giving": f"""SELECT g.election_date, g.office_sought, g.candidate, county, amount,
            CASE WHEN amount IS NOT NULL AND breaks IS NOT NULL THEN greatest(1, least(len(list_filter(list_distinct(breaks), lambda b: b <= CAST(amount AS DOUBLE))),
                greatest(len(list_distinct(breaks)) - 1, 1))) END AS bin,
            coalesce(county, 'NA') || ' ' || coalesce('$' || CASE WHEN cents THEN format('{{:,.2f}}', CAST(amount AS DOUBLE))
                ELSE format('{{:,}}', CAST(round_even(amount, 0) AS BIGINT)) END, 'NA') AS label,
            coalesce({bin_fill("bin", "len(list_distinct(breaks)) - 1")}, '{colors.NO_VALUE_FILL}') AS fill_col
        FROM d_county_giving g JOIN (SELECT election_date, office_sought, candidate,
            quantile_cont(CAST(amount AS DOUBLE), [0, 0.2, 0.4, 0.6, 0.8, 1]) AS breaks,
            max(abs(amount)) < 100000 AND bool_or(amount <> floor(amount)) AS cents FROM d_county_giving GROUP BY ALL) AS b
        ON g.election_date = b.election_date AND g.office_sought = b.office_sought AND g.candidate = b.candidate""",
    "d_daily": f"""SELECT election_date, office_sought, candidate, date,
            CASE WHEN bool_or(side = 'in' AND amount IS NULL) THEN 0 ELSE coalesce(sum(CASE WHEN side = 'in' THEN amount END), 0) END AS contributions,
            CASE WHEN bool_or(side = 'out' AND amount IS NULL) THEN 0 ELSE coalesce(sum(CASE WHEN side = 'out' THEN amount END), 0) END AS disbursement
        FROM (SELECT election_date, office_sought, candidate, side, amount,
                coalesce(date, min(date) OVER (PARTITION BY election_date, office_sought, candidate)) AS date
            FROM (SELECT election_date, office_sought, candidate, 'in' AS side, receipt_date AS date, amount FROM contrib
                UNION ALL SELECT election_date, office_sought, candidate, 'out', disbursement_date, disbursement_amount FROM expend) AS s) AS dated
        GROUP BY ALL""",
    "d_signed": """SELECT session, bill_num, s.legislator_id, chief_sponsor, name, party, concat_ws('|', name, party) AS name_party
        FROM sponsors s LEFT JOIN legislators l ON s.legislator_id = l.legislator_id""",
    "d_overview": """SELECT b.session, b.bill_num, title, bill_summary, last_action, spon_list, Democratic, Republican, other_party,
            try_cast(passed_house AS BIGINT) AS passed_house, try_cast(passed_senate AS BIGINT) AS passed_senate,
            try_cast(passed AS BIGINT) AS passed
        FROM bills b LEFT JOIN (SELECT session, bill_num, string_agg(name_party, ';' ORDER BY name_party) AS spon_list,
                count(*) FILTER (party = 'Democratic') AS Democratic, count(*) FILTER (party = 'Republican') AS Republican,
                count(*) FILTER (party NOT IN ('Democratic', 'Republican')) AS other_party
            FROM d_signed GROUP BY ALL HAVING count(party) > 0) s ON b.session = s.session AND b.bill_num = s.bill_num""",
    "d_roll": """SELECT session, bill_num, chamber_, r.legislator_id, vote, name, party
        FROM (SELECT session, bill_num, chamber AS chamber_, legislator_id, vote FROM roll) r
        LEFT JOIN legislators l ON r.legislator_id = l.legislator_id""",
    "d_district_rows": f"""SELECT chamber, district, {CONTEST}, county, precinct, candidate, party, votes
        FROM (SELECT {CONTEST}, county, substring(precinct, 1, 4) AS precinct, candidate, party, CAST(sum(votes) AS BIGINT) AS votes
            FROM election_data WHERE election = 'general' GROUP BY ALL) AS s
        JOIN district_precincts USING (county, precinct)""",
    "d_district_long": f"""SELECT chamber, district, {CONTEST}, upper(county) || ' - ' || precinct AS unit, candidate, party, {nasum()} AS votes
        FROM d_district_rows WHERE precinct <> 'county' GROUP BY ALL""",
    "d_edges": """SELECT district, ring, x AS x1, y AS y1,
            coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
        FROM plan_vertices WINDOW w AS (PARTITION BY district, ring ORDER BY seq)""",
    "d_inside": """SELECT id, x, y, district FROM points JOIN d_edges ON (y1 > y) <> (y2 > y)
        GROUP BY ALL HAVING sum(CASE WHEN x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1""",
    "d_directory": f"""SELECT *, CASE WHEN lrc_website IS NULL THEN '#6baed6' ELSE '#08519c' END AS fill,
            CAST(district AS VARCHAR) || '-' || CASE WHEN middle_name IS NULL THEN {paste("first_name", "last_name")}
                ELSE {paste("first_name", "middle_name", "last_name")} END AS label
        FROM (SELECT DISTINCT * FROM candidates) AS p""",
}


def oracle(statement: str) -> str:
    """Complete DuckDB statement with every helper subquery it needs."""
    return with_clauses(statement, {**dialect(1), **DERIVED})
