"""Civic tables as SQL over the driver tables.

The text runs unchanged in Spark SQL and in DuckDB, except where a pair gives one text per dialect. In Spark
each view is a lazy subquery, so pruning and pushdown reach the Parquet scans.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.sinks import run_job, shared_folder
from ..sources.tables import scan_parquet

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Columns of the driver's tables by kind.
NUMBERS, TEXTS, TIMES, LISTS = "number", "text", "time", "list"
TABLE_COLUMNS: dict[str, dict[str, str]] = {
    "region": {NUMBERS: "r_regionkey", TEXTS: "r_name"},
    "nation": {NUMBERS: "n_nationkey n_regionkey", TEXTS: "n_name"},
    "customer": {NUMBERS: "c_custkey c_nationkey c_acctbal", TEXTS: "c_name c_mktsegment"},
    "supplier": {NUMBERS: "s_suppkey s_nationkey s_acctbal", TEXTS: "s_name"},
    "part": {NUMBERS: "p_partkey p_size p_retailprice", TEXTS: "p_name p_brand p_type"},
    "orders": {NUMBERS: "o_orderkey o_custkey o_totalprice", TEXTS: "o_orderstatus o_orderpriority", TIMES: "o_orderdate"},
    "lineitem": {
        NUMBERS: "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax",
        TEXTS: "l_returnflag l_linestatus", TIMES: "l_shipdate",
    },
    "events": {NUMBERS: "event_id user_id value", TEXTS: "event_type props", TIMES: "ts"},
    "documents": {NUMBERS: "doc_id n_chars", TEXTS: "text lang source"},
    "embeddings": {NUMBERS: "vec_id label", LISTS: "embedding"},
    "pages": {NUMBERS: "page_id", TEXTS: "url html"},
    "benchmark": {NUMBERS: "item_id", TEXTS: "text"},
    "labels": {NUMBERS: "doc_id quality toxic"},
    "conversations": {NUMBERS: "conv_id turn", TEXTS: "role text"},
}

# Race wordings that reach every office class, the catch-all, suffixes, typos and order conflicts.
PHRASES = [
    "PRESIDENT of the UNITED STATES",
    "UNITED STATES SENATOR",
    "UNITED STATES REPRESENTATIVE in CONGRESS {n}th Congressional District",
    "GOVERNOR and LIEUTENANT GOVERNOR",
    "ATTORNEY GENERAL - REPUBLICAN",
    "SECRETARY OF STATE",
    "AUDITOR of PUBLIC ACCOUNTS",
    "COMMISSIONER of AGRICULTURE",
    "SUPERINTENDENT of PUBLIC INSTRUCTION",
    "STATE TREASURER",
    "STATE SENATOR {n}th Senatorial District",
    "STATE REPRESENTATIVE {n}th Representative District",
    "STATE REPRESENTATIVE {n}th Representative District - DEMOCRATIC",
    "CIRCUIT COURT CLERK",
    "COUNTY CLERK",
    "COUNTY JUDGE/EXECUTIVE",
    "COUNTY ATTORNEY",
    "COUNTY COMMISSIONER {n}th District",
    "SHERIFF",
    "JAILER",
    "CORONER",
    "PROPERTY VALUATION ADMINISTRATOR",
    "PVA",
    "SURVEYOR",
    "CONSTABLE {n}th Magisterial District",
    "CONTABLE {n}th Magisterial District",
    "MAGISTRATE {n}th Magisterial District",
    "JUSTICE OF THE PEACE",
    "FISCAL COURT",
    "JUSTICE of the SUPREME COURT {n}th Supreme Court District",
    "JUDGE of the COURT OF APPEALS {n}th Appellate District",
    "COMMONWEALTH'S ATTORNEY {n}th Judicial Circuit",
    "FAMILY COURT JUDGE {n}th Judicial Circuit",
    "CIRCUIT JUDGE {n}th Judicial Circuit 1st Division",
    "DISTRICT JUDGE {n} th Judicial District",
    "JUDGE {n}nd Division",
    "CONSTITUTIONAL AMENDMENT {n}",
    "Are you in favor of the sale of alcohol?",
    "LOCAL OPTION ELECTION",
    "CANNABIS QUESTION",
    "MAYOR City of St. Mary's",
    "Mayor City of Falls-Town",
    "CITY CLERK City of Oak Grove",
    "CITY COMMISSION City of Oak Grove",
    "CITY COUNCIL City of Hill",
    "LEGISLATIVE BODY",
    "MEMBER of the SCHOOL BOARD {n}th Educational District",
    "BOARD OF EDUCATION",
    "SOIL AND WATER CONSERVATION DISTRICT",
    "INDEPENDENT DISTRICT {n}",
    "LIBRARY TRUSTEE",
    "STATUS SENATE ADVISORY",
    "U.S. HOUSE {n}st Congressional District",
    "US SENATE",
    "State Senate {n}rd District",
    "State House of Representatives {n}th District",
    "COUNTY JUDGE - REPUBLICAN",
    "SHERIFF - DEMOCRATIC",
    "ANNEXATION {n}",
    "WATER DISTRICT BOARD",
]


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_PHRASE_ROWS = ", ".join(f"({i}, {_text(p)})" for i, p in enumerate(PHRASES))

# Outline templates of a map cell in cell units: plain square, notched square, square with a hole.
_OUTLINES = {
    0: [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]],
    1: [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.625, 1.0), (0.625, 0.375), (0.25, 0.375), (0.25, 1.0), (0.0, 1.0)]],
    2: [
        [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)],
        [(0.25, 0.25), (0.25, 0.75), (0.75, 0.75), (0.75, 0.25)],
    ],
}
_OUTLINE_ROWS = ", ".join(
    f"({kind}, {ring}, {seq}, {x:e}, {y:e})"
    for kind, rings in _OUTLINES.items()
    for ring, points in enumerate(rings)
    for seq, (x, y) in enumerate(points)
)

_PLANS = ["house_plan_hcs", "house_plan", "house_plan_dem", "house_2014", "sen_plan", "sen_2014", "cong_plan", "draft"]
_VERSION_ROWS = ", ".join(f"('{plan}', {i}, {third}, {(third + i) % 3})" for i, plan in enumerate(_PLANS) for third in range(3))

_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _ballot_case() -> str:
    """Candidate of a segment when a race has fewer candidates than there are segments."""
    sizes = {"STANDARD": 1, "ECONOMY": 2, "LARGE": 3, "MEDIUM": 4}
    whens = [
        f"WHEN p_type = '{kind}' AND c_mktsegment = '{segment}' THEN '{_SEGMENTS[i % size]}'"
        for kind, size in sizes.items()
        for i, segment in enumerate(_SEGMENTS)
        if i >= size
    ]
    return f"CASE {' '.join(whens)} ELSE c_mktsegment END"


VIEWS: dict[str, str | tuple[str, str]] = {
    # Phrase list and outline templates: constants joined to real rows, never queried alone.
    "phrases": f"SELECT * FROM (VALUES {_PHRASE_ROWS}) AS t(k, phrase)",
    "outlines": f"SELECT * FROM (VALUES {_OUTLINE_ROWS}) AS t(kind, ring, seq, dx, dy)",
    # Elections from line items: one row per sold item, duplicates included.
    "election_raw": f"""
        SELECT year(o_orderdate) + 23 AS year,
            CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'primary' ELSE 'general' END AS election,
            CASE p_type WHEN 'ECONOMY' THEN 'GOVERNOR and LIEUTENANT GOVERNOR'
                WHEN 'LARGE' THEN 'STATE SENATOR 5th Senatorial District' WHEN 'MEDIUM' THEN 'ATTORNEY GENERAL'
                WHEN 'PROMO' THEN 'MAYOR City of Oak Grove' WHEN 'SMALL' THEN 'COUNTY CLERK'
                ELSE 'CIRCUIT JUDGE 3rd Judicial Circuit' END AS race,
            lower(n_name) AS county,
            CASE WHEN o_custkey % 40 = 39 THEN 'county'
                WHEN o_custkey % 8 >= 4 THEN 'a10' || cast(o_custkey % 4 AS string) || 'b'
                ELSE 'a10' || cast(o_custkey % 4 AS string) END AS precinct,
            {_ballot_case()} AS candidate,
            cast(l_quantity AS bigint) AS votes
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
            JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "election_items": """
        SELECT *, CASE WHEN candidate IN ('BUILDING', 'MACHINERY') THEN 'REP' WHEN candidate = 'AUTOMOBILE' THEN 'DEM'
            ELSE 'IND' END AS party FROM election_raw""",
    # One row per precinct and candidate; a few counts are missing.
    "election_data": """
        SELECT year, election, race, county, precinct, candidate, party,
            nullif(cast(sum(votes) AS bigint), cast(37 AS bigint)) AS votes
        FROM election_items GROUP BY year, election, race, county, precinct, candidate, party""",
    # Elections from orders: many races and many people, names written in several ways.
    "ballots": """
        SELECT year(o_orderdate) + 23 AS year,
            CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'primary' ELSE 'general' END AS election,
            replace(phrase, '{n}', cast(o_custkey % 7 + 1 AS string)) || ' (' || r_name || ')' AS race,
            lower(n_name) AS county,
            'a10' || cast(o_custkey % 4 AS string) AS precinct,
            CASE o_orderkey % 4 WHEN 0 THEN c_mktsegment || ' Q. ' || c_name
                WHEN 1 THEN c_mktsegment || ' Q. ' || c_name || ' / Running Mate'
                WHEN 2 THEN c_mktsegment || ' "Buddy"  Q. ' || c_name
                ELSE lower(c_mktsegment) || ' Q, ' || c_name END AS candidate,
            CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'primary' WHEN o_orderkey % 13 = 0 THEN 'DEM'
                WHEN n_regionkey IN (0, 1) THEN 'REP' WHEN n_regionkey IN (2, 3) THEN 'DEM'
                WHEN o_custkey % 2 = 0 THEN 'REP' ELSE 'IND' END AS party,
            cast(floor(o_totalprice) AS bigint) % 1000 AS votes
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
            JOIN region ON n_regionkey = r_regionkey JOIN phrases ON k = o_custkey % 60""",
    "race_strings": """
        SELECT p_partkey, replace(phrase, '{n}', cast(p_size AS string)) || ' (' || p_brand || ')' AS race
        FROM part JOIN phrases ON k = p_partkey % 60""",
    # Worksheets list everybody on a primary ballot; a few rows are filled in by hand: some for a whole race, untidy, blank.
    "manual_raw": """
        SELECT DISTINCT year, race, CASE WHEN votes >= 500 AND votes < 540 THEN NULL ELSE candidate END AS candidate,
            CASE WHEN votes < 400 OR votes >= 540 THEN '' WHEN votes % 5 = 0 THEN ' rep' WHEN votes % 5 = 1 THEN 'DEM ' WHEN votes % 5 = 2 THEN 'ind'
                WHEN votes % 5 = 3 THEN '' END AS party
        FROM ballots WHERE election = 'primary'""",
    "todo_raw": """
        SELECT DISTINCT year, race, candidate,
            CASE WHEN votes < 300 OR votes >= 480 THEN '' WHEN votes % 6 = 0 THEN 'republican' WHEN votes % 6 = 1 THEN ' D' WHEN votes % 6 = 2 THEN 'i'
                WHEN votes % 6 = 3 THEN 'Democratic' WHEN votes % 6 = 4 THEN 'unknown' END AS party
        FROM ballots WHERE election = 'primary'""",
    # A roster per election year: whoever was active in it, with that year's party; some stand in it twice.
    "roster": """
        SELECT DISTINCT year(o_orderdate) + 23 AS year, lower(n_name) AS county,
            CASE WHEN phrase LIKE 'STATE SENATOR%' THEN 'Kentucky Senate District ' || cast(c_custkey % 7 + 1 AS string)
                WHEN phrase LIKE 'STATE REP%' THEN 'Kentucky House of Representatives District ' || cast(c_custkey % 7 + 1 AS string)
                ELSE phrase END AS office_bp,
            CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || ' Q. ' || c_name
                WHEN c_custkey % 3 = 1 THEN c_mktsegment || ' ' || c_name
                ELSE c_mktsegment || ' "Ace" Middle ' || c_name END AS candidate,
            CASE WHEN (c_nationkey + year(o_orderdate)) % 2 = 0 THEN 'REP' ELSE 'DEM' END AS party
        FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN phrases ON k = c_custkey % 60
        UNION ALL
        SELECT DISTINCT year(o_orderdate) + 23, lower(n_name), phrase, c_mktsegment || CASE WHEN c_acctbal < 500 THEN ' Q. ' ELSE ' Z. ' END || c_name, 'REP'
        FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN phrases ON k = c_custkey % 60""",
    # Campaign finance. Campaigns are (election date, office, regional candidate).
    "contrib": """
        SELECT CASE WHEN o_orderstatus = 'P' THEN 'PRIMARY' ELSE 'GENERAL ELECTION' END AS election_type,
            make_date(cast(year(o_orderdate) + 23 AS int), 11, 5) AS election_date,
            CASE n_regionkey WHEN 0 THEN 'GOVERNOR' WHEN 1 THEN 'STATE SENATOR (EVEN)' WHEN 2 THEN 'CITY COUNCIL'
                WHEN 3 THEN 'COUNTY JUDGE/EXECUTIVE' ELSE 'DISTRICT JUDGE' END AS office_sought,
            'CAND ' || cast(n_regionkey AS string) AS candidate,
            'Pat' AS recipient_first_name, 'Region' || cast(n_regionkey AS string) AS recipient_last_name,
            CASE WHEN o_custkey % 7 = 0 THEN c_mktsegment || ' PAC ' || cast(c_nationkey AS string) END AS from_organization_name,
            CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE c_mktsegment END AS contributor_first_name,
            CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE c_name END AS contributor_last_name,
            CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE cast(o_custkey % 9 AS string) || ' Main St' END AS address1,
            CASE WHEN n_regionkey = 0 AND o_orderkey % 97 = 0 THEN NULL
                ELSE cast(cast(floor(o_totalprice) AS decimal(18, 0)) * cast(0.01 AS decimal(3, 2)) AS decimal(18, 2)) END AS amount,
            CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE cast(o_orderdate AS date) END AS receipt_date,
            n_name AS city,
            CASE WHEN n_nationkey % 3 = 0 THEN 'KY' WHEN o_custkey % 29 = 0 THEN NULL ELSE n_name END AS state,
            cast(o_custkey % 200 AS string) AS zip,
            c_mktsegment AS occupation, c_mktsegment || ' CO' AS employer, o_orderpriority AS contribution_mode,
            CASE o_orderstatus WHEN 'F' THEN 'INDIVIDUAL' WHEN 'O' THEN 'KYPAC' ELSE 'OTHER' END AS contribution_type
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "expend": """
        SELECT make_date(cast(year(l_shipdate) + 23 AS int), 11, 5) AS election_date,
            CASE n_regionkey WHEN 0 THEN 'GOVERNOR' WHEN 1 THEN 'STATE SENATOR (EVEN)' WHEN 2 THEN 'CITY COUNCIL'
                WHEN 3 THEN 'COUNTY JUDGE/EXECUTIVE' ELSE 'DISTRICT JUDGE' END AS office_sought,
            'CAND ' || cast(n_regionkey AS string) AS candidate,
            CASE WHEN l_suppkey % 4 = 0 THEN s_name END AS organization_name,
            CASE WHEN l_suppkey % 9 = 1 THEN NULL ELSE 'Ann' END AS recipient_first_name,
            CASE WHEN l_suppkey % 5 = 1 THEN NULL ELSE s_name END AS recipient_last_name,
            CASE WHEN n_regionkey = 1 AND l_orderkey % 997 = 0 THEN NULL
                ELSE cast(cast(floor(l_extendedprice) AS decimal(18, 0)) * cast(0.01 AS decimal(3, 2)) AS decimal(18, 2)) END AS disbursement_amount,
            CASE WHEN l_orderkey % 53 = 0 THEN NULL ELSE cast(l_shipdate AS date) END AS disbursement_date,
            'Purpose ' || l_returnflag AS purpose, l_linestatus AS occupation,
            l_returnflag || l_linestatus AS disbursement_code
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    # Zip codes of each nation: eight apart, one in eight unknown, some listed for a second county.
    "zip_county": """
        SELECT z AS zip_code, n_name AS county
        FROM (SELECT DISTINCT c_custkey % 200 AS z FROM customer) AS codes JOIN nation ON n_nationkey * 8 = z - z % 8
        WHERE z % 8 <> 7
        UNION ALL
        SELECT cast(n_nationkey * 8 AS bigint), r_name FROM nation JOIN region ON n_regionkey = r_regionkey
        WHERE n_nationkey % 5 = 0""",
    # Legislature.
    "legislators": """
        SELECT s_suppkey AS legislator_id, s_name AS name, 'Rep. ' || s_name AS full_name,
            CASE WHEN s_nationkey % 3 = 0 THEN 'Democratic' WHEN s_nationkey % 3 = 1 THEN 'Republican'
                WHEN s_nationkey % 6 = 5 THEN 'Independent' END AS party,
            CASE WHEN s_suppkey % 4 = 0 THEN 'senate' ELSE 'house' END AS chamber, s_suppkey % 100 + 1 AS district,
            CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE '/img/' || cast(s_suppkey AS string) || '.jpg' END AS img_src,
            '/legislator/' || cast(s_suppkey AS string) AS lrc_link,
            CASE WHEN s_suppkey % 2 = 0 THEN '1' ELSE '0' END AS ga_17, CASE WHEN s_suppkey % 3 = 0 THEN '1' ELSE '0' END AS ga_18,
            CASE WHEN s_suppkey % 4 = 0 THEN '1' ELSE '0' END AS ga_19, CASE WHEN s_suppkey % 5 = 0 THEN '1' ELSE '0' END AS ga_20,
            CASE WHEN s_suppkey % 6 = 0 THEN '1' ELSE '0' END AS ga_21, CASE WHEN s_suppkey % 7 = 0 THEN '1' ELSE 'x' END AS ga_22,
            CASE WHEN s_suppkey % 2 = 1 THEN '1' ELSE '0' END AS ga_23, CASE WHEN s_suppkey % 3 = 1 THEN '1' END AS ga_24,
            CASE WHEN s_suppkey % 4 = 1 THEN '1' ELSE '0' END AS ga_25, CASE WHEN s_suppkey % 5 = 1 THEN '1' ELSE '0' END AS ga_26
        FROM supplier""",
    "bills": """
        SELECT cast(year(o_orderdate) + 23 AS string) || ' General Assembly' AS session,
            CASE WHEN o_orderkey % 2 = 0 THEN 'hb' ELSE 'sb' END || cast(o_orderkey AS string) AS bill_num,
            'AN ACT relating to ' || lower(o_orderpriority) AS title,
            'Summary of ' || cast(o_orderkey AS string) AS bill_summary, 'status ' || o_orderstatus AS last_action,
            CASE WHEN o_orderstatus IN ('F', 'P') THEN '1' ELSE '0' END AS passed_house,
            CASE WHEN o_orderstatus = 'F' THEN '1' WHEN o_orderstatus = 'P' THEN '0' END AS passed_senate,
            CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END AS passed
        FROM orders""",
    "bill_people": """
        SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first_line, min(l_returnflag) AS flag,
            min(l_linestatus) AS status FROM lineitem GROUP BY l_orderkey, l_suppkey""",
    "sponsors": """
        SELECT cast(year(o_orderdate) + 23 AS string) || ' General Assembly' AS session,
            CASE WHEN l_orderkey % 2 = 0 THEN 'hb' ELSE 'sb' END || cast(l_orderkey AS string) AS bill_num,
            l_suppkey AS legislator_id, CASE WHEN first_line = 1 THEN '1' ELSE '0' END AS chief_sponsor
        FROM bill_people JOIN orders ON l_orderkey = o_orderkey""",
    # One vote in fifty is by somebody missing from the legislator table.
    "roll": """
        SELECT cast(year(o_orderdate) + 23 AS string) || ' General Assembly' AS session,
            CASE WHEN l_orderkey % 2 = 0 THEN 'hb' ELSE 'sb' END || cast(l_orderkey AS string) AS bill_num,
            CASE WHEN l_suppkey % 50 = 49 THEN -l_suppkey ELSE l_suppkey END AS legislator_id,
            CASE flag WHEN 'A' THEN 'YEA' WHEN 'N' THEN 'NAY' ELSE 'NV' END AS vote,
            CASE WHEN status = 'F' THEN 'house' ELSE 'senate' END AS chamber
        FROM bill_people JOIN orders ON l_orderkey = o_orderkey""",
    "actions": """
        SELECT CASE WHEN user_id % 10 = 0 THEN cast(year(ts) + 1 AS string) || ' General Assembly'
                WHEN user_id % 17 = 0 THEN cast(year(ts) AS string) || ' Special Session 2'
                ELSE cast(year(ts) AS string) || ' General Assembly' END AS session,
            CASE WHEN user_id % 2 = 0 THEN 'hb' ELSE 'sb' END || cast(user_id AS string) AS bill_num,
            cast(ts AS date) AS date, event_type AS action, event_id AS seq FROM events""",
    "update_day": "SELECT max(cast(ts AS date)) AS update_day FROM events",
    # Districts and map layers. Precinct places come from where customers live.
    "places": """
        SELECT DISTINCT c_nationkey AS nk, c_custkey % 4 AS p FROM customer""",
    "district_precincts": """
        SELECT 'House' AS chamber, 'District ' || cast((nk * 4 + p) % 20 + 1 AS string) AS district,
            lower(n_name) AS county, 'a10' || cast(p AS string) AS precinct
        FROM places JOIN nation ON nk = n_nationkey
        UNION ALL
        SELECT 'Senate', 'District ' || cast(nk % 11 + 1 AS string), lower(n_name), 'a10' || cast(p AS string)
        FROM places JOIN nation ON nk = n_nationkey""",
    "fips": """
        SELECT lower(n_name) AS county, cast(21000 + n_nationkey * 2 + 1 AS bigint) AS fips FROM nation
        WHERE n_name <> 'NATION_7'""",
    "counties": """
        SELECT n_name AS name, cast(n_nationkey % 5 AS double) * 2e-1 - 5e-1 AS xmin,
            cast(n_nationkey - n_nationkey % 5 AS double) / 5e0 * 2e-1 - 5e-1 AS ymin,
            cast(n_nationkey % 5 AS double) * 2e-1 - 3e-1 AS xmax,
            cast(n_nationkey - n_nationkey % 5 AS double) / 5e0 * 2e-1 - 3e-1 AS ymax FROM nation
        UNION ALL SELECT 'Empty ' || r_name, 2e0, 2e0, 3e0, 3e0 FROM region""",
    "precinct_shapes": """
        SELECT layer, n_name AS name, substring(cast(21000 + n_nationkey * 2 + 1 AS string), 3, 3) AS countyfp,
            '00a10' || cast(p AS string) AS vtdst,
            cast(n_nationkey % 5 AS double) * 2e-1 - 5e-1 AS xmin, cast(p AS double) * 1e-1 AS ymin,
            cast(n_nationkey % 5 AS double) * 2e-1 - 3e-1 AS xmax, cast(p AS double) * 1e-1 + 1e-1 AS ymax
        FROM places JOIN nation ON nk = n_nationkey
            JOIN (VALUES ('precincts', 0), ('precincts', 1), ('precincts', 2), ('precincts', 3),
                ('precincts_22', 0), ('precincts_22', 1), ('precincts_22', 2),
                ('precincts_24', 0), ('precincts_24', 1), ('precincts_24', 2), ('precincts_24', 3),
                ('precincts_general_24', 0), ('precincts_general_24', 1)) AS t(layer, kept) ON p = kept""",
    # The same layers by vertices, with a bare precinct code.
    "precinct_vertices": """
        SELECT layer, name, countyfp, precinct, ring, seq, xmin + dx * (xmax - xmin) AS x, ymin + dy * (ymax - ymin) AS y
        FROM (SELECT *, substring(vtdst, 3, 4) AS precinct, cast(substring(vtdst, 6, 1) AS int) % 3 AS shape FROM precinct_shapes) AS s
            JOIN outlines ON kind = shape""",
    # Versions of the district plans: shapes, sizes and the writing of a district differ; one is shown to nobody.
    "plan_versions": f"SELECT * FROM (VALUES {_VERSION_ROWS}) AS t(plan, version, third, shape)",
    "layer_vertices": """
        SELECT plan, CASE WHEN plan LIKE '%2014' THEN '' ELSE 'District ' END || cast(n_nationkey + 1 AS string) AS district, ring, seq,
            (cast(n_nationkey % 5 AS double) + dx) * (2e-1 + cast(version AS double) * 1e-2) - 5e-1 AS x,
            (cast(n_nationkey - n_nationkey % 5 AS double) / 5e0 + dy) * (2e-1 - cast(version AS double) * 1e-2) - 5e-1 AS y
        FROM nation JOIN plan_versions ON third = n_nationkey % 3 JOIN outlines ON kind = shape""",
    "plan_vertices": """
        SELECT 'District ' || cast(n_nationkey + 1 AS string) AS district, ring, seq,
            (cast(n_nationkey % 5 AS double) + dx) * 2e-1 - 5e-1 AS x,
            (cast(n_nationkey - n_nationkey % 5 AS double) / 5e0 + dy) * 2e-1 - 5e-1 AS y
        FROM nation JOIN outlines ON kind = n_nationkey % 3""",
    "points": (
        "SELECT vec_id AS id, cast(element_at(embedding, 1) AS double) AS x, cast(element_at(embedding, 2) AS double) AS y FROM embeddings",
        "SELECT vec_id AS id, cast(embedding[1] AS double) AS x, cast(embedding[2] AS double) AS y FROM embeddings",
    ),
    # Candidates: suppliers and, as challengers, customers; duplicates and missing links included. One district has
    # nobody for the legislature.
    "candidates": """
        SELECT CASE WHEN s_nationkey = 3 THEN 'Mayor' WHEN s_suppkey % 3 = 0 THEN 'State Senator' ELSE 'State Representative' END AS office,
            s_nationkey + 1 AS district, 'Sam' AS first_name,
            CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 'Lee' END AS middle_name, s_name AS last_name,
            CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'https://lrc/' || cast(s_suppkey AS string) END AS lrc_website,
            CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'https://site/' || cast(s_suppkey AS string) END AS political_website,
            'fb/' || s_name AS facebook, 'tw/' || s_name AS twitter, 'ig/' || s_name AS instagram
        FROM supplier
        UNION ALL
        SELECT CASE WHEN c_nationkey = 3 OR c_acctbal <= 9000 THEN 'City Council' ELSE 'State Representative' END, c_nationkey + 1, c_mktsegment, NULL, 'Challenger', NULL, NULL, 'fb', 'tw', 'ig'
        FROM customer""",
    # Roster pages: the navigation list of every page rewritten as a roster block.
    "county_pages": (
        r"""
        SELECT page_id, '/Nation_' || cast(page_id % 120 AS string) || '_of_X_County,_elections' AS url,
            regexp_replace(regexp_replace(regexp_replace(
                replace(replace(html, '<nav>', '<div class="box widget-data-list"><div>Offices</div>'), '</nav>', '</div>'),
                r'<li><a href="(/[^"]*)">([a-gA-G][^<]*)</a></li>',
                '<li><a href="$1" title="$2 (State Senate District 5, Kentucky, candidate 2026)">$2</a> (R)</li>'),
                r'<li><a href="(/[^"]*)">([h-pH-P][^<]*)</a></li>',
                '<li class="x"><a href="$1" title="$2 (Mayor of Town, Kentucky, candidate 2026)"><b>$2</b> &amp; Co</a> (D)</li>'),
                r'<li><a href="(/[^"]*)">([q-rQ-R][^<]*)</a></li>', '<li><a href="$1">$2</a> (R)</li>') AS html
        FROM pages""",
        r"""
        SELECT page_id, '/Nation_' || cast(page_id % 120 AS string) || '_of_X_County,_elections' AS url,
            regexp_replace(regexp_replace(regexp_replace(
                replace(replace(html, '<nav>', '<div class="box widget-data-list"><div>Offices</div>'), '</nav>', '</div>'),
                '<li><a href="(/[^"]*)">([a-gA-G][^<]*)</a></li>',
                '<li><a href="\1" title="\2 (State Senate District 5, Kentucky, candidate 2026)">\2</a> (R)</li>', 'g'),
                '<li><a href="(/[^"]*)">([h-pH-P][^<]*)</a></li>',
                '<li class="x"><a href="\1" title="\2 (Mayor of Town, Kentucky, candidate 2026)"><b>\2</b> &amp; Co</a> (D)</li>', 'g'),
                '<li><a href="(/[^"]*)">([q-rQ-R][^<]*)</a></li>', '<li><a href="\1">\2</a> (R)</li>', 'g') AS html
        FROM pages""",
    ),
}


def _needed(text: str, names) -> list[str]:
    words = set(re.findall(r"[A-Za-z_]\w*", text))
    return [n for n in names if n in words]


def with_clauses(text: str, views: dict[str, str], tables: dict[str, str] | None = None) -> str:
    """Prefix a statement with the views (and base tables) it uses, directly or not, in dependency order."""
    ordered: dict[str, str] = {}

    def visit(body: str) -> None:
        for name in _needed(body, views):
            if name not in ordered and views[name] is not body:
                visit(views[name])
                ordered[name] = views[name]
        for name in _needed(body, tables or {}):
            ordered.setdefault(name, tables[name])

    visit(text)
    if not ordered:
        return text
    clauses = ",\n".join(f"{name} AS ({body})" for name, body in ordered.items())
    return f"WITH {clauses}\n{text}"


def dialect(index: int) -> dict[str, str]:
    return {name: body if isinstance(body, str) else body[index] for name, body in VIEWS.items()}


#: Where the lookup tables of a session, data folder and state of its files stand.
STORED: dict[tuple[str, ...], str] = {}


class Views:
    """Attribute access to base tables and civic views of one data folder, e.g. ``Views(spark, d).contrib``.

    Base tables are registered as temporary views of the session once per folder, so footers are read once.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._prefix = "civic_" + hashlib.md5(self.folder.encode()).hexdigest()[:12]

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        view = f"{self._prefix}_{name}"
        if not self.spark.catalog.tableExists(view):
            scan_parquet(self.spark, self.path(name)).createOrReplaceTempView(view)
        return self.spark.table(view)

    def sql(self, text: str) -> DataFrame:
        tables = {t: f"SELECT * FROM {self._prefix}_{t}" for t in BASE_TABLES}
        statement = with_clauses(text, dialect(0), tables)
        for name in _needed(statement, BASE_TABLES):
            self.table(name)
        return self.spark.sql(statement)

    def stored(self, name: str, build) -> DataFrame:
        """Result of a lookup job as the table its consumers read: written once per session, data folder and state of its
        files, to the shared folder. A table that was changed since gives new lookups.

        This is the boundary between the offline jobs and the queries on top of them. It also gives Spark the
        table's real size, so the broadcast decision is made on facts.
        """
        key = (self.spark.sparkContext.applicationId, self.folder, self._state(), name)
        if key not in STORED:
            STORED[key] = shared_folder(self.spark)
            run_job(build(), STORED[key], write=True)
        return self.spark.read.parquet(STORED[key])

    def _state(self) -> str:
        """Names, sizes and times of the files of all base tables."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(self.folder)
        system, seen = place.getFileSystem(conf), []
        files = system.listFiles(place, True)
        while files.hasNext():
            status = files.next()
            seen.append(f"{status.getPath().toString()} {status.getLen()} {status.getModificationTime()}")
        return hashlib.md5("\n".join(sorted(seen)).encode()).hexdigest()

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            df = self.sql(f"SELECT * FROM {name}")
        elif name in BASE_TABLES:
            df = self.table(name)
        else:
            raise AttributeError(name)
        self.__dict__[name] = df
        return df
