"""One query per single operator or function, over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import colors, formats, names, offices
from ..functions import semantics as sem
from ..operators import winners as win
from ..operators.dedupe import first_row_per
from ..operators.joins import layer_for_year, lookup_missing_as_null, natural_left_join, nullsafe_join
from ..operators.quantiles import grouped_quantiles
from ..operators.ordering import global_rank
from ..operators.reshape import counts_by_value, map_text, prefixed
from ..operators.series import fill_days, running_totals
from ..operators.spatial import bbox_columns, points_in_polygons, polygons_from_vertices, with_bbox
from ..plans import elections, fundraising, legislation, primaries
from ..sources import pages, sinks, tables
from ..streaming.incremental import extract_new_pages
from . import sqltext as s
from .queries_results import race_lookup
from .registry import query
from .views import BASE_TABLES, TABLE_COLUMNS, Views, dialect

CONTEST = s.CONTEST
KEYS = elections.CONTEST
PARTISAN = "('federal', 'state_exec', 'state_leg', 'county')"


def long_counties(v: Views):
    return win.totals(v.election_data.distinct(), [*KEYS, "county"])


# Sources and sinks


def _profile_sql(table: str) -> list[str]:
    rows = []
    for kind, names in TABLE_COLUMNS[table].items():
        for c in names.split():
            value = {"time": f"strftime({c}, '%Y-%m-%d %H:%M:%S')", "list": f"len({c})"}.get(kind, c)
            text = kind in ("text", "time")
            ends = [f"min({value})", f"max({value})"]
            shown = [*ends, "NULL::DOUBLE", "NULL::DOUBLE"] if text else ["NULL::VARCHAR", "NULL::VARCHAR", *[f"{e}::DOUBLE + 0" for e in ends]]
            columns = ", ".join(f"{e} AS {n}" for e, n in zip(shown, ("smallest", "largest", "smallest_number", "largest_number")))
            rows.append(f"SELECT '{table}' AS name, '{c}' AS column_name, count(*) AS n, count(*) - count({c}) AS nulls, {columns} FROM {table}")
    return rows


@query("scan_table", " UNION ALL ".join(sql for t in BASE_TABLES for sql in _profile_sql(t)))
def _(v):
    out = None
    for name in BASE_TABLES:
        one = tables.profile(v.table(name)).select(F.lit(name).alias("name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "dim_broadcast",
    "SELECT county, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM contrib LEFT JOIN zip_county ON zip = CAST(zip_code AS VARCHAR) GROUP BY county",
)
def _(v):
    by_zip = v.contrib.groupBy("zip").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    placed = lookup_missing_as_null(by_zip, tables.zip_dimension(v.zip_county), "zip", "zip_code")
    return placed.groupBy("county").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))


@query(
    "scan_layer",
    """SELECT layer, name, countyfp, precinct, '00' || precinct AS vtdst, count(DISTINCT ring) AS nrings, count(*) AS npoints,
            min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM precinct_vertices GROUP BY ALL""",
)
def _(v):
    shapes = v.stored("precinct_layer", lambda: tables.layer_shapes(v.precinct_vertices, ["layer", "name", "countyfp", "precinct"]))
    return tables.scan_layer(shapes, "precinct").withColumn("nrings", F.size("rings")).drop("rings")


@query("scan_csv", "SELECT CAST(year AS BIGINT) AS year, race, candidate, party FROM d_overrides")
def _(v):
    folder = sinks.shared_folder(v.spark)
    sinks.write_csv(v.manual_raw.select(F.col("year").cast("int").alias("year"), "race", "candidate", "party"), folder)
    return tables.clean_overrides(tables.scan_csv(v.spark, folder, tables.OVERRIDE_SCHEMA)).distinct()


@query("scan_sql", "SELECT DISTINCT year, race, candidate FROM ballots WHERE election = 'primary'")
def _(v):
    return tables.scan_sql(
        v.spark, "SELECT DISTINCT year, race, candidate FROM {results} WHERE election = 'primary'", results=v.ballots
    )


@query("sink_overwrite", "SELECT race, office_level, office, district, jurisdiction FROM d_crosswalk")
def _(v):
    folder, crosswalk = sinks.shared_folder(v.spark), primaries.race_crosswalk(v.race_strings)
    sinks.overwrite_table(crosswalk.filter(F.col("district").isNull()), folder)
    sinks.overwrite_table(crosswalk, folder, sort_by=["race"])
    return v.spark.read.parquet(folder)


@query("sink_append", "SELECT event_type AS app, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n FROM events GROUP BY ALL")
def _(v):
    folder = sinks.shared_folder(v.spark)
    visits = v.events.select(F.col("event_type").alias("app"), F.to_date("ts").alias("day"))
    sinks.append_table(visits.filter(F.col("app") == "view"), folder)
    sinks.append_table(visits.filter(F.col("app") != "view"), folder)
    return v.spark.read.parquet(folder).groupBy("app", "day").agg(F.count(F.lit(1)).alias("n"))


@query("sink_csv", "SELECT year, race, candidate, party, office_level FROM (SELECT DISTINCT b.year, b.race, candidate, party, office_level FROM ballots b LEFT JOIN d_lookup l ON b.race = l.race) AS t")
def _(v):
    folder = sinks.shared_folder(v.spark)
    rows = nullsafe_join(v.ballots, race_lookup(v), ["race"], "left")
    rows = rows.select("year", "race", "candidate", "party", "office_level").distinct()
    sinks.write_csv(rows, folder)
    return tables.scan_csv(v.spark, folder, "year BIGINT, race STRING, candidate STRING, party STRING, office_level STRING")


@query("job_dry_run", "SELECT office, count(*) AS n, CAST(1 AS BIGINT) AS written FROM d_crosswalk GROUP BY office UNION ALL SELECT office, count(*), 0 FROM d_crosswalk GROUP BY office")
def _(v):
    folder, job = sinks.shared_folder(v.spark), primaries.race_crosswalk(v.race_strings).groupBy("office").agg(F.count(F.lit(1)).alias("n"))
    seed = sinks.shared_folder(v.spark)
    sinks.seed_csv(job, seed)
    sinks.seed_csv(job.filter("false"), seed)  # must not touch the existing worksheet
    dry = sinks.run_job(job, folder).withColumn("written", F.lit(0))
    seeded = tables.scan_csv(v.spark, seed, "office STRING, n BIGINT")
    written = nullsafe_join(sinks.run_job(job, folder, write=True, sort_by=["office"]), seeded, ["office", "n"], "left_semi")
    return written.withColumn("written", F.lit(1)).unionByName(dry)


_DECODED = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"


def _visible(expr: str) -> str:
    return r"trim(regexp_replace(" + _DECODED.format(f"regexp_replace({expr}, '<[^>]*>', '', 'g')") + r", '\s+', ' ', 'g'))"


# Depth of every piece between two div tags; a block runs from its opening piece to the last one before its depth is left.
_BLOCKS = f"""SELECT any_value(o.url) AS url, string_agg(p.piece, '' ORDER BY p.i) AS block
    FROM (SELECT o.page_id, o.i, any_value(o.url) AS url, any_value(o.depth) AS depth, min(c.i) AS closed
        FROM d_pieces o LEFT JOIN d_pieces c ON o.page_id = c.page_id AND c.i > o.i AND c.depth < o.depth
        WHERE regexp_matches(o.piece, {s.text(pages.BLOCK)}) GROUP BY o.page_id, o.i) AS o
    JOIN d_pieces p ON p.page_id = o.page_id AND p.i >= o.i AND (closed IS NULL OR p.i < closed)
    GROUP BY o.page_id, o.i"""

_ITEMS = f"""SELECT DISTINCT replace(regexp_extract(url, '/([A-Za-z_]+)_County', 1), '_', ' ') AS county,
    nullif(regexp_extract({_DECODED.format("regexp_extract(regexp_extract(item, '<a\\b[^>]*>'), '\\btitle=\"([^\"]*)\"', 1)")}, {s.text(pages.OFFICE)}, 1), '') AS office_bp,
    {_visible(f"regexp_extract(item, {s.text(pages.ANCHOR)}, 1)")} AS candidate,
    CASE regexp_extract({_visible("item")}, '\\((R|D)\\)', 1) WHEN 'R' THEN 'REP' WHEN 'D' THEN 'DEM' END AS party
    FROM (SELECT url, unnest(regexp_extract_all(block, {s.text(pages.ITEM)})) AS item FROM ({_BLOCKS}) AS b) AS i
    WHERE regexp_matches(item, {s.text(pages.ANCHOR)}) AND regexp_matches({_visible("item")}, '\\((R|D)\\)')"""


@query("extract_list_items", f"SELECT CASE WHEN county = '' THEN NULL ELSE county END AS county, office_bp, candidate, party FROM ({_ITEMS}) AS x")
def extract_list_items(v):
    return pages.roster_items(v.county_pages)


@query("extract_list_items_incremental", f"SELECT CASE WHEN county = '' THEN NULL ELSE county END AS county, office_bp, candidate, party FROM ({_ITEMS}) AS x")
def _(v):
    out, checkpoint = sinks.shared_folder(v.spark), sinks.shared_folder(v.spark)

    # The same rewriting as the county_pages view, over the pages of one micro-batch.
    text = dialect(0)["county_pages"].replace("FROM pages", "FROM {batch}")

    def rewrite(batch):
        return batch.sparkSession.sql(text, batch=batch)

    return extract_new_pages(v.spark, v.path("pages*"), v.pages.schema, out, checkpoint, rewrite)


@query(
    "extract_links",
    """SELECT DISTINCT 'https://host.example' || href AS url FROM (SELECT unnest(regexp_extract_all(html, '<a\\b[^>]*\\bhref="([^"]*)"', 1)) AS href FROM pages) AS h
        WHERE regexp_matches(href, '(on|en|e)$')""",
)
def _(v):
    return pages.links(v.pages, r"(on|en|e)$", host="https://host.example")


# Projections and filters


@query("filter_eq_params", "SELECT county, precinct, candidate, party, votes FROM election_data WHERE year = 2020 AND election = 'general' AND race = 'ATTORNEY GENERAL'")
def _(v):
    rows = v.election_data
    for column, value in {"year": 2020, "election": "general", "race": "ATTORNEY GENERAL"}.items():
        rows = rows.filter(F.col(column) == value)
    return rows.select("county", "precinct", "candidate", "party", "votes")


@query("filter_in_list", "SELECT * FROM election_data WHERE county IN ('nation_1', 'nation_7', 'nation_19')")
def _(v):
    return v.election_data.filter(F.col("county").isin("nation_1", "nation_7", "nation_19"))


@query("filter_not_in_nullsafe", f"SELECT DISTINCT b.race, office_level FROM ballots b LEFT JOIN d_lookup l ON b.race = l.race WHERE office_level IS NULL OR office_level NOT IN {PARTISAN}")
def _(v):
    races = v.ballots.select("race").distinct()
    lookup = race_lookup(v).select("race", "office_level")
    return nullsafe_join(races, lookup, ["race"], "left").filter(sem.not_in("office_level", offices.PARTISAN_LEVELS))


@query("filter_nulls", "SELECT contribution_type, receipt_date IS NULL AS undated, count(*) AS n FROM contrib WHERE contributor_last_name IS NOT NULL GROUP BY ALL".replace("receipt_date IS NULL", "CAST(receipt_date IS NULL AS BIGINT)"))
def _(v):
    named = v.contrib.filter(F.col("contributor_last_name").isNotNull())
    return named.groupBy("contribution_type", F.col("receipt_date").isNull().alias("undated")).agg(F.count(F.lit(1)).alias("n"))


@query("filter_prefix", "SELECT session, bill_num, title FROM bills WHERE substring(bill_num, 1, 1) = 's'")
def _(v):
    return v.bills.filter(legislation.in_chamber("senate")).select("session", "bill_num", "title")


@query("filter_threshold", "SELECT candidate, state, zip, CAST(amount AS DOUBLE) AS amount FROM contrib WHERE state <> 'KY' AND amount >= 2000 AND contribution_type = 'INDIVIDUAL'")
def _(v):
    large = v.contrib.filter((F.col("state") != "KY") & (F.col("amount") >= 2000) & (F.col("contribution_type") == "INDIVIDUAL"))
    return large.select("candidate", "state", "zip", "amount")


@query("filter_regex", r"SELECT DISTINCT race FROM race_strings WHERE regexp_matches(lower(race), '\bcons?table\b|\bjudge\b')")
def _(v):
    return v.race_strings.filter(F.lower("race").rlike(r"\bcons?table\b|\bjudge\b")).select("race").distinct()


@query("filter_search", "SELECT page_id, url FROM pages WHERE contains(lower(url), lower('ExA')) OR contains(lower(html), lower('NATION'))")
def _(v):
    hits = [F.lower(c).contains(q.lower()) for c, q in (("url", "ExA"), ("html", "NATION"))]
    return v.pages.filter(hits[0] | hits[1]).select("page_id", "url")


@query("project_rename", "SELECT s_suppkey AS id, s_name AS leg_name, s_acctbal AS balance FROM supplier")
def _(v):
    kept = v.supplier.withColumnsRenamed({"s_suppkey": "id", "s_name": "leg_name"}).drop("s_nationkey")
    return kept.select("leg_name", F.col("s_acctbal").alias("balance"), "id")


@query("project_transmute", "SELECT year, race, '' AS party, candidate || '*' AS candidate FROM ballots")
def _(v):
    return v.ballots.select("year", "race", F.concat("candidate", F.lit("*")).alias("candidate"), F.lit("").alias("party"))


@query("project_case", "SELECT legislator_id, CASE WHEN party = 'Democratic' THEN 'blue' WHEN party = 'Republican' THEN 'red' ELSE 'grey' END AS color, coalesce(img_src, 'none') AS img FROM legislators")
def _(v):
    color = F.when(F.col("party") == "Democratic", "blue").when(F.col("party") == "Republican", "red").otherwise("grey")
    return v.legislators.select("legislator_id", color.alias("color"), F.coalesce("img_src", F.lit("none")).alias("img"))


_FLAGS = [f"ga_{n}" for n in range(17, 27)]


@query("project_across", f"SELECT legislator_id, {', '.join(f'try_cast({c} AS BIGINT) AS {c}' for c in _FLAGS)}, {', '.join(f'{c} AS {c}_raw' for c in _FLAGS)} FROM legislators")
def _(v):
    found = prefixed(v.legislators, "ga_")
    numbers = [F.col(c).try_cast("int").alias(c) for c in found]
    return v.legislators.select("legislator_id", *numbers, *[F.col(c).alias(f"{c}_raw") for c in found])


@query("project_recode", "SELECT party, CASE party WHEN 'DEM' THEN 'Democratic' WHEN 'REP' THEN 'Republican' ELSE party END AS label, count(*) AS n FROM ballots GROUP BY ALL")
def _(v):
    return v.ballots.groupBy("party", names.party_label("party").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("project_fillna", "SELECT session, bill_num, coalesce(passed_senate, 'none') AS passed_senate FROM bills")
def _(v):
    return v.bills.select("session", "bill_num", "passed_senate").fillna({"passed_senate": "none"})


# Joins


@query("join_left_lookup", "SELECT b.year, b.race, b.candidate, office, district FROM ballots b LEFT JOIN d_lookup l ON b.race = l.race")
def _(v):
    lookup = race_lookup(v)
    return nullsafe_join(v.ballots, lookup, ["race"], "left").select("year", "race", "candidate", "office", "district")


@query("join_left_natural", "SELECT b.session, b.bill_num, s.legislator_id, title FROM sponsors s LEFT JOIN (SELECT session, bill_num, title FROM bills WHERE passed_house = '1') b ON s.session = b.session AND s.bill_num = b.bill_num".replace("b.session, b.bill_num, s.", "s.session, s.bill_num, s."))
def _(v):
    passed = v.bills.filter(F.col("passed_house") == "1").select("session", "bill_num", "title")
    return natural_left_join(v.sponsors.select("session", "bill_num", "legislator_id"), passed)


@query("join_inner_renamed", "SELECT d.district, d.chamber, count(*) AS n, CAST(sum(votes) AS BIGINT) AS votes FROM election_data e JOIN district_precincts d ON e.county = d.county AND e.precinct = d.precinct GROUP BY ALL")
def _(v):
    sides = v.district_precincts.withColumnRenamed("precinct", "code")
    units = v.election_data.groupBy("county", "precinct").agg(F.count(F.lit(1)).alias("n"), F.sum("votes").alias("votes"))
    joined = units.join(sides, (units.county == sides.county) & (units.precinct == sides.code))
    return joined.groupBy("district", "chamber").agg(F.sum("n").alias("n"), F.sum("votes").alias("votes"))


@query(
    "join_inner_nullsafe",
    f"""SELECT p.year, p.race, p.candidate, count(*) AS n FROM d_prim_keyed p JOIN d_gen g ON p.year = g.year
        AND p.office IS NOT DISTINCT FROM g.office AND p.district IS NOT DISTINCT FROM g.district AND p.nkey IS NOT DISTINCT FROM g.nkey GROUP BY ALL""",
)
def _(v):
    lookup = race_lookup(v).select("race", "office", "district")
    keyed = nullsafe_join(v.ballots, lookup, ["race"], "left").withColumn("nkey", names.name_key("candidate"))
    primary = keyed.filter(F.col("election") == "primary").select("year", "race", "candidate", "office", "district", "nkey").distinct()
    general = keyed.filter((F.col("election") == "general") & F.col("party").isin("REP", "DEM"))
    person = ["year", "office", "district", "nkey"]
    known = general.groupBy(*person).agg(F.count_distinct("party").alias("n"))
    return nullsafe_join(primary, known, person).select("year", "race", "candidate", "n")


@query(
    "join_full_outer",
    """SELECT strftime(coalesce(a.date, b.date), '%Y-%m-%d') AS date, contributions, disbursement
        FROM (SELECT receipt_date AS date, CAST(sum(amount) AS DOUBLE) AS contributions FROM contrib WHERE receipt_date IS NOT NULL GROUP BY 1) a
        FULL JOIN (SELECT disbursement_date AS date, CAST(sum(disbursement_amount) AS DOUBLE) AS disbursement FROM expend WHERE disbursement_date IS NOT NULL GROUP BY 1) b ON a.date = b.date""",
)
def _(v):
    given = v.contrib.groupBy(F.col("receipt_date").alias("date")).agg(F.sum("amount").alias("contributions"))
    paid = v.expend.groupBy(F.col("disbursement_date").alias("date")).agg(F.sum("disbursement_amount").alias("disbursement"))
    return given.filter("date IS NOT NULL").join(paid.filter("date IS NOT NULL"), "date", "full")


@query("join_left_anti", "SELECT session, bill_num FROM bills b WHERE NOT EXISTS (SELECT 1 FROM sponsors s WHERE s.session = b.session AND s.bill_num = b.bill_num)")
def _(v):
    return v.bills.select("session", "bill_num").join(v.sponsors, ["session", "bill_num"], "left_anti")


@query("join_left_semi", "SELECT session, bill_num FROM bills b WHERE EXISTS (SELECT 1 FROM sponsors s WHERE s.session = b.session AND s.bill_num = b.bill_num AND chief_sponsor = '1')")
def _(v):
    chiefs = v.sponsors.filter(F.col("chief_sponsor") == "1")
    return v.bills.select("session", "bill_num").join(chiefs, ["session", "bill_num"], "left_semi")


@query(
    "join_range_version",
    """SELECT year, layer, name, count(*) AS n FROM (SELECT DISTINCT year, county FROM election_data) e
        JOIN precinct_shapes p ON lower(p.name) = e.county AND layer = CASE WHEN year < 2022 THEN 'precincts' WHEN year = 2022 THEN 'precincts_22'
            WHEN year = 2023 THEN 'precincts_24' ELSE 'precincts_general_24' END GROUP BY ALL""",
)
def _(v):
    units = v.election_data.select("year", "county").distinct()
    units = units.withColumn("layer", layer_for_year(F.col("year"), elections.PRECINCT_LAYERS))
    shapes = v.precinct_shapes.withColumn("county", F.lower("name"))
    return units.join(shapes, ["layer", "county"]).groupBy("year", "layer", "name").agg(F.count(F.lit(1)).alias("n"))


@query("join_point_in_polygon", "SELECT id, x, y, district FROM d_inside")
def join_point_in_polygon(v):
    return points_in_polygons(v.points, polygons_from_vertices(v.plan_vertices, ["district"]), ["district"])


# Aggregations


@query("agg_sum_by_key", f"SELECT state, {s.nasum('amount', 'DOUBLE')} AS amount FROM contrib GROUP BY state")
def _(v):
    return v.contrib.groupBy("state").agg(sem.na_sum("amount").alias("amount"))


@query("agg_sum_multi_key", f"SELECT {CONTEST}, county, precinct, candidate, party, CAST(sum(votes) AS BIGINT) AS votes FROM (SELECT {CONTEST}, county, substring(precinct, 1, 4) AS precinct, candidate, party, votes FROM election_items) AS i GROUP BY ALL")
def agg_sum_multi_key(v):
    short = v.election_items.withColumn("precinct", F.substring("precinct", 1, 4))
    return short.groupBy(*KEYS, "county", "precinct", "candidate", "party").agg(F.sum("votes").alias("votes"))


@query("agg_count_groups", "SELECT chamber_ AS chamber, party, vote, count(*) AS n FROM d_roll GROUP BY ALL")
def _(v):
    people = v.legislators.select("legislator_id", "party")
    voted = v.roll.groupBy("chamber", "legislator_id", "vote").agg(F.count(F.lit(1)).alias("k"))
    counted = voted.join(people, "legislator_id", "left").groupBy("chamber", "party", "vote").agg(F.sum("k").alias("n"))
    return counted.orderBy(F.desc("n"))


@query("agg_count_distinct_null", "SELECT candidate, count(DISTINCT contributor) + CASE WHEN bool_or(contributor IS NULL) THEN 1 ELSE 0 END AS contributors FROM d_contrib GROUP BY candidate")
def _(v):
    people = v.contrib.select("candidate", fundraising.contributor(True).alias("contributor")).distinct()
    return people.groupBy("candidate").agg(F.count(F.lit(1)).alias("contributors"))


@query("agg_unanimous", "SELECT race, CASE WHEN count(DISTINCT party) = 1 THEN min(party) END AS party FROM ballots WHERE election = 'general' GROUP BY race")
def _(v):
    return v.ballots.filter(F.col("election") == "general").groupBy("race").agg(sem.unanimous("party").alias("party"))


@query("agg_bool_any", "SELECT session, bill_num, CAST(bool_or(party IS NOT NULL) AS BIGINT) AS any_party, CAST(bool_or(coalesce(party = 'Democratic', false)) AS BIGINT) AS any_dem FROM d_signed GROUP BY session, bill_num")
def _(v):
    people = v.legislators.select("legislator_id", "party")
    signed = v.sponsors.join(people, "legislator_id", "left")
    return signed.groupBy("session", "bill_num").agg(
        F.bool_or(F.col("party").isNotNull()).alias("any_party"),
        F.bool_or(F.coalesce(F.col("party") == "Democratic", F.lit(False))).alias("any_dem"),
    )


@query("agg_conditional_sum", "SELECT candidate, CASE WHEN bool_or(state = 'KY' AND amount IS NULL) THEN NULL ELSE CAST(coalesce(sum(amount) FILTER (state = 'KY'), 0) AS DOUBLE) END AS home, CAST(coalesce(sum(amount) FILTER (contribution_type = 'KYPAC'), 0) AS DOUBLE) AS pac FROM contrib GROUP BY candidate")
def _(v):
    at_home = F.coalesce(F.col("state") == "KY", F.lit(False))
    home = F.when(F.bool_or(at_home & F.col("amount").isNull()), None).otherwise(F.coalesce(F.sum(F.when(at_home, F.col("amount"))), F.lit(0)))
    pac = F.coalesce(F.sum(F.when(F.col("contribution_type") == "KYPAC", F.col("amount"))), F.lit(0))
    return v.contrib.groupBy("candidate").agg(home.alias("home"), pac.alias("pac"))


@query("agg_having_count", "SELECT candidate, count(*) AS n FROM (SELECT candidate, contributor, sum(amount) AS a FROM d_contrib WHERE contribution_type = 'INDIVIDUAL' GROUP BY ALL HAVING sum(amount) >= 2000) AS h GROUP BY candidate")
def _(v):
    people = v.contrib.filter(F.col("contribution_type") == "INDIVIDUAL").withColumn("contributor", fundraising.contributor(True))
    sums = people.groupBy("candidate", "contributor").agg(F.sum("amount").alias("a")).filter(F.col("a") >= 2000)
    return sums.groupBy("candidate").agg(F.count(F.lit(1)).alias("n"))


@query("agg_string", "SELECT session, bill_num, string_agg(name_party, ';' ORDER BY name_party) AS spon_list FROM d_signed GROUP BY session, bill_num")
def _(v):
    people = v.legislators.select("legislator_id", "name", "party")
    signed = v.sponsors.join(people, "legislator_id", "left").withColumn("name_party", F.concat_ws("|", "name", "party"))
    signed.createOrReplaceTempView("civic_signed")
    return v.spark.sql(
        "SELECT session, bill_num, listagg(name_party, ';') WITHIN GROUP (ORDER BY name_party) AS spon_list FROM civic_signed GROUP BY session, bill_num"
    )


_PROBS = {"q0": 0.0, "q20": 0.2, "q40": 0.4, "q60": 0.6, "q80": 0.8, "q100": 1.0}


@query(
    "agg_quantiles",
    "SELECT candidate, "
    + ", ".join(f"round(quantile_cont(CAST(amount AS DOUBLE), {p}), 4) AS {name}" for name, p in _PROBS.items())
    + " FROM contrib GROUP BY candidate",
)
def agg_quantiles(v):
    found = grouped_quantiles(v.contrib, ["candidate"], "amount", _PROBS)
    return found.select("candidate", *[F.round(name, 4).alias(name) for name in _PROBS])


@query("agg_distinct", f"SELECT DISTINCT {CONTEST}, county, precinct FROM election_items")
def _(v):
    return v.election_items.select(*KEYS, "county", "precinct").distinct()


@query(
    "pivot_party",
    """SELECT session, bill_num, coalesce(max(n) FILTER (value = 'Democratic'), 0) AS "Democratic", coalesce(max(n) FILTER (value = 'Republican'), 0) AS "Republican",
            string_agg(value || '=' || n, ' | ' ORDER BY value) AS parties
        FROM (SELECT session, bill_num, coalesce(party, 'NA') AS value, count(*) AS n FROM d_signed GROUP BY ALL) AS c GROUP BY session, bill_num""",
)
def _(v):
    signed = v.sponsors.join(v.legislators.select("legislator_id", "party"), "legislator_id", "left")
    counts = counts_by_value(signed, ["session", "bill_num"], "party")
    both = [F.coalesce(F.try_element_at("counts", F.lit(p)), F.lit(0)).alias(p) for p in ("Democratic", "Republican")]
    return counts.select("session", "bill_num", *both, map_text("counts").alias("parties"))


@query(
    "pivot_candidate_slots",
    f"""SELECT {CONTEST}, unit, max(n_candidates) AS n_candidates,
            string_agg(slot || ' ' || coalesce(l.candidate, 'NA') || '=' || coalesce(CAST(votes AS VARCHAR), 'NA'), ' | ' ORDER BY slot, party NULLS LAST) AS ballot
        FROM d_county_long l JOIN ({s.slots("d_county_long", CONTEST)}) t USING ({CONTEST}, candidate) GROUP BY {CONTEST}, unit""",
)
def _(v):
    long = long_counties(v).withColumn("unit", F.col("county"))
    whole = win.ballots(long, KEYS, "unit")
    line = F.transform("ballot", lambda x: F.concat(x["slot"].cast("string"), F.lit(" "), F.coalesce(x["candidate"], F.lit("NA")), F.lit("="), F.coalesce(x["votes"].cast("string"), F.lit("NA"))))
    return whole.withColumn("ballot", F.array_join(line, " | "))


_FIELD = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "pivot_candidates",
    f"""SELECT {CONTEST}, county, {', '.join(f'max(votes) FILTER (candidate = {c!r}) AS "{c}"' for c in _FIELD)}
        FROM (SELECT {CONTEST}, county, candidate, {s.nasum()} AS votes FROM d_rows GROUP BY ALL) AS t GROUP BY {CONTEST}, county""",
)
def _(v):
    return elections.candidate_columns(v.election_data.distinct(), [*KEYS, "county"], _FIELD)


@query("unpivot_sessions", "SELECT legislator_id, name, chamber, flag AS session_flag, try_cast(serving AS BIGINT) AS serving FROM legislators UNPIVOT INCLUDE NULLS (serving FOR flag IN (" + ", ".join(_FLAGS) + "))")
def _(v):
    return legislation.session_flags(v.legislators)


@query("agg_bbox", "SELECT left(district, 10) AS part, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM plan_vertices GROUP BY 1")
def _(v):
    boxes = with_bbox(polygons_from_vertices(v.plan_vertices, ["district"]))
    return boxes.groupBy(F.substring("district", 1, 10).alias("part")).agg(*bbox_columns())


# Windows


@query("win_argmax", f"SELECT {CONTEST}, county, winner, winning_votes FROM ({s.winners('d_county_long', CONTEST + ', county', 'candidate', False)}) AS w")
def _(v):
    return win.unit_winners(long_counties(v), [*KEYS, "county"], "candidate", ties=False).select(*KEYS, "county", "winner", "winning_votes")


@query("win_argmax_tie", f"SELECT {CONTEST}, unit, winner FROM ({s.winners('d_precinct_long', CONTEST + ', unit')}) AS w")
def win_argmax_tie(v):
    rows = v.election_data.distinct().filter(F.col("precinct") != "county")
    long = win.totals(rows.withColumn("unit", F.concat_ws(" - ", F.upper("county"), "precinct")), [*KEYS, "unit"])
    return win.unit_winners(long, [*KEYS, "unit"]).select(*KEYS, "unit", "winner")


@query("win_group_total", f"SELECT {CONTEST}, county, candidate, party, votes, CASE WHEN bool_or(votes IS NULL) OVER w THEN NULL ELSE CAST(sum(votes) OVER w AS BIGINT) END AS total_votes FROM d_county_long WINDOW w AS (PARTITION BY {CONTEST}, county)")
def _(v):
    # After the aggregate a county has one row per name on the ballot, so the window stays small.
    unit = Window.partitionBy(*KEYS, "county")
    total = F.when(F.bool_or(F.col("votes").isNull()).over(unit), None).otherwise(F.sum("votes").over(unit))
    return long_counties(v).withColumn("total_votes", total)


@query("win_share", f"SELECT {CONTEST}, county, winning_share FROM ({s.winners('d_county_long', CONTEST + ', county', 'party', False)}) AS w")
def _(v):
    return win.unit_winners(long_counties(v), [*KEYS, "county"], ties=False).select(*KEYS, "county", "winning_share")


@query("win_pct_total", f"SELECT {CONTEST}, candidate, pct FROM d_rank")
def _(v):
    return win.ranked_candidates(v.election_data.distinct(), KEYS).select(*KEYS, "candidate", "pct")


@query("win_row_number", f"SELECT {CONTEST}, candidate, cnt, 'IND' || cnt AS party FROM d_rank")
def _(v):
    return win.ranked_candidates(v.election_data.distinct(), KEYS).select(*KEYS, "candidate", "cnt", "party")


@query("win_first_per_group", "SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY user_id")
def _(v):
    return first_row_per(v.events.select("user_id", "event_id", "event_type"), ["user_id"], [F.col("event_id")])


@query("win_priority_dedupe", f"SELECT year, race, candidate, party FROM (SELECT *, row_number() OVER (PARTITION BY year, race, candidate ORDER BY length(coalesce(party, '')) DESC, party NULLS FIRST) AS rn FROM (SELECT year, race, candidate, party FROM todo_raw)) AS t WHERE rn = 1")
def _(v):
    size = F.length(F.coalesce("party", F.lit("")))
    return first_row_per(v.todo_raw.select("year", "race", "candidate", "party"), ["year", "race", "candidate"], [-size])


@query("win_running_total", "SELECT candidate, strftime(receipt_date, '%Y-%m-%d') AS receipt_date, CAST(sum(amount) OVER (PARTITION BY candidate ORDER BY receipt_date) AS DOUBLE) AS so_far FROM (SELECT candidate, receipt_date, sum(amount) AS amount FROM contrib WHERE receipt_date IS NOT NULL GROUP BY ALL) AS d")
def _(v):
    daily = v.contrib.filter("receipt_date IS NOT NULL").groupBy("candidate", "receipt_date").agg(F.sum("amount").alias("amount"))
    return running_totals(daily, ["candidate"], "receipt_date", {"amount": "so_far"}).drop("amount")


@query(
    "win_date_spine",
    """SELECT user_id, strftime(day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM (SELECT user_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day
            FROM (SELECT user_id, min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM events GROUP BY user_id) AS r) AS sp
        LEFT JOIN (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) AS d USING (user_id, day)""",
)
def _(v):
    daily = v.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return fill_days(daily, ["user_id"], "day", ["n"])


@query("win_first_appearance", f"SELECT {CONTEST}, candidate, slot, n_candidates, contest_votes FROM ({s.slots('d_county_long', CONTEST)}) AS t")
def _(v):
    return win.candidate_slots(long_counties(v).withColumn("unit", F.col("county")), KEYS, "unit")


# Sorts, limits, sets


@query("sort_desc", "SELECT state, CAST(amount AS DOUBLE) AS amount, row_number() OVER (ORDER BY amount DESC NULLS LAST, state NULLS FIRST) AS rank FROM (SELECT state, sum(amount) AS amount FROM contrib GROUP BY state) AS t")
def _(v):
    sums = v.contrib.groupBy("state").agg(F.sum("amount").alias("amount"))
    return global_rank(sums, [F.col("amount").desc_nulls_last(), F.col("state")])


@query("sort_numeric_suffix", r"SELECT bill_num, bill_q, row_number() OVER (ORDER BY bill_q NULLS FIRST, bill_num NULLS FIRST) AS rank FROM (SELECT DISTINCT bill_num, try_cast(regexp_replace(bill_num, '\D', '', 'g') AS BIGINT) AS bill_q FROM bills) AS t")
def _(v):
    numbered = v.bills.select("bill_num", sem.digits_number("bill_num").alias("bill_q")).distinct()
    return global_rank(numbered, [F.col("bill_q"), F.col("bill_num")])


@query("sort_custom", "SELECT vote, n, row_number() OVER (ORDER BY CASE vote WHEN 'YEA' THEN 1 WHEN 'NAY' THEN 2 ELSE 3 END, vote NULLS FIRST) AS rank FROM (SELECT vote, count(*) AS n FROM roll GROUP BY vote) AS t")
def _(v):
    counts = v.roll.groupBy("vote").agg(F.count(F.lit(1)).alias("n"))
    return global_rank(counts, [legislation.vote_rank(), F.col("vote")])


@query(
    "sort_multi",
    """SELECT office_sought, candidate, strftime(receipt_date, '%Y-%m-%d') AS receipt_date, CAST(amount AS DOUBLE) AS amount,
            row_number() OVER (ORDER BY receipt_date DESC NULLS LAST, lower(office_sought) NULLS FIRST, candidate NULLS FIRST, amount NULLS FIRST, office_sought NULLS FIRST) AS rank
        FROM contrib""",
)
def _(v):
    rows = v.contrib.select("office_sought", "candidate", "receipt_date", "amount")
    return global_rank(rows, [F.col("receipt_date").desc_nulls_last(), F.lower("office_sought"), F.col("candidate"), F.col("amount"), F.col("office_sought")])


@query("limit_top_n", "SELECT race FROM d_crosswalk WHERE office = 'Other Local' ORDER BY race LIMIT 25")
def _(v):
    return primaries.crosswalk_catch_all(primaries.race_crosswalk(v.race_strings))


@query("sample_n", "SELECT race, office, district FROM d_crosswalk WHERE district IS NOT NULL ORDER BY md5(race), race LIMIT 15")
def _(v):
    return primaries.crosswalk_district_sample(primaries.race_crosswalk(v.race_strings))


@query(
    "guard_max_units",
    f"""SELECT d.*, n_units FROM (
            SELECT *, 'Precinct' AS detail FROM ({s.wide("d_precinct_long", CONTEST, "party", True)}) AS p
            UNION ALL SELECT *, 'County' FROM ({s.wide("d_county_long", CONTEST, "candidate", False)}) AS c) AS d
        JOIN (SELECT {CONTEST}, count(*) AS n_units FROM (SELECT DISTINCT {CONTEST}, county, precinct FROM d_rows) AS u GROUP BY ALL) AS k
            USING ({CONTEST})""",
)
def _(v):
    return elections.detail_table(v.election_data.distinct())


@query("set_union_all", "SELECT year, race, candidate, party, CAST(NULL AS VARCHAR) AS note FROM manual_raw UNION ALL SELECT year, race, candidate, party, 'todo' FROM todo_raw")
def _(v):
    return v.manual_raw.unionByName(v.todo_raw.withColumn("note", F.lit("todo")), allowMissingColumns=True)


@query("set_union_distinct", "SELECT year, race, candidate FROM manual_raw UNION SELECT year, race, candidate FROM todo_raw")
def _(v):
    cols = ["year", "race", "candidate"]
    return v.manual_raw.select(*cols).unionByName(v.todo_raw.select(*cols)).distinct()


# Scalar functions


@query("str_case", f"SELECT DISTINCT race, lower(race) AS low, upper(race) AS up, {s.title('race')} AS title FROM race_strings")
def _(v):
    cols = [F.lower("race").alias("low"), F.upper("race").alias("up"), sem.title_case("race").alias("title")]
    return v.race_strings.select("race", *cols).distinct()


@query("str_substring", "SELECT c_custkey, substring(c_name, 1, 4) AS head, substring(c_name, 3, 3) AS mid, substring(c_name, 10) AS tail FROM customer")
def _(v):
    name = F.col("c_name")
    return v.customer.select("c_custkey", name.substr(1, 4).alias("head"), name.substr(3, 3).alias("mid"), F.substring("c_name", 10, 1 << 30).alias("tail"))


@query("str_replace", r"SELECT c_custkey, regexp_replace(c_name, '\D', '', 'g') AS digits, replace(c_name, 'Customer#', 'C ') AS short FROM customer")
def _(v):
    return v.customer.select("c_custkey", F.regexp_replace("c_name", r"\D", "").alias("digits"), F.replace("c_name", F.lit("Customer#"), F.lit("C ")).alias("short"))


@query("str_extract", r"SELECT DISTINCT race, nullif(regexp_extract(race, '\d{1,4}'), '') AS first_number, array_to_string(regexp_extract_all(race, '\d'), '') AS digits, nullif(regexp_extract(race, '\((Brand#\d+)\)', 1), '') AS brand FROM race_strings")
def _(v):
    first = F.regexp_substr("race", F.lit(r"\d{1,4}")).alias("first_number")
    digits = F.array_join(F.regexp_extract_all("race", F.lit(r"\d"), F.lit(0)), "").alias("digits")
    return v.race_strings.select("race", first, digits, sem.matched("race", r"\((Brand#\d+)\)").alias("brand")).distinct()


@query("str_split", f"SELECT candidate, string_split(candidate, ' ')[1] AS first_token, {s.first_last('candidate')} AS ends FROM (SELECT DISTINCT candidate FROM ballots) AS b")
def _(v):
    people = v.ballots.select("candidate").distinct()
    return people.select("candidate", F.split_part("candidate", F.lit(" "), F.lit(1)).alias("first_token"), names.first_last("candidate").alias("ends"))


@query("str_squish", r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g'), ' ') AS text FROM documents")
def _(v):
    return v.documents.select("doc_id", sem.squish("text").alias("text"))


@query("str_concat", f"SELECT election_date::VARCHAR AS election_date, {s.paste('contributor_first_name', 'contributor_last_name', 'address1')} AS who, concat_ws('|', contributor_last_name, state) AS skip, count(*) AS n FROM contrib GROUP BY ALL")
def _(v):
    who = sem.na_paste("contributor_first_name", "contributor_last_name", "address1").alias("who")
    return v.contrib.groupBy("election_date", who, F.concat_ws("|", "contributor_last_name", "state").alias("skip")).agg(F.count(F.lit(1)).alias("n"))


@query("str_geo_codes", "SELECT county, precinct, '00' || precinct AS vtdst, substring(CAST(fips AS VARCHAR), 3, 3) AS countyfp FROM (SELECT DISTINCT county, precinct FROM ballots) AS u LEFT JOIN fips USING (county)")
def _(v):
    units = nullsafe_join(v.ballots.select("county", "precinct").distinct(), v.fips, ["county"], "left")
    return units.select("county", "precinct", tables.voting_district("precinct").alias("vtdst"), tables.county_fips("fips").alias("countyfp"))


@query("date_parts", "SELECT event_id, year(ts) AS y, strftime(ts, '%B') AS month_name, day(ts) AS d, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%B %-d, %Y') AS long_day FROM events")
def _(v):
    ts = F.col("ts")
    return v.events.select("event_id", F.year(ts).alias("y"), F.date_format(ts, "MMMM").alias("month_name"), F.dayofmonth(ts).alias("d"), F.to_date(ts).alias("day"), F.date_format(ts, "MMMM d, yyyy").alias("long_day"))


@query("num_try_cast", "SELECT legislator_id, try_cast(ga_22 AS BIGINT) AS ga_22, try_cast(name AS DOUBLE) AS as_number FROM legislators")
def _(v):
    return v.legislators.select("legislator_id", F.col("ga_22").try_cast("int").alias("ga_22"), F.col("name").try_cast("double").alias("as_number"))


@query("num_round_clamp", "SELECT o_orderkey, round_even(o_orderkey / 2.0, 0)::DOUBLE AS half, least(greatest(o_totalprice, 1e4), 2e5) AS clamped, o_totalprice / nullif(CAST(o_orderkey AS DOUBLE), 0e0) AS per, o_orderkey % 2 AS parity FROM orders")
def _(v):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    clamped = F.least(F.greatest(price, F.lit(1e4)), F.lit(2e5))
    return v.orders.select("o_orderkey", F.bround(key / 2, 0).alias("half"), clamped.alias("clamped"), sem.ratio(price, key).alias("per"), (key % 2).alias("parity"))


@query("num_format", f"SELECT o_orderkey, {s.comma('floor(o_totalprice)')} AS commas, format('{{:,.2f}}%', o_orderkey / 15000.0::DOUBLE * 100) AS pct, {s.dollar('a')} AS money FROM (SELECT *, CAST(floor(o_totalprice) AS DECIMAL(18, 0)) * CAST(0.01 AS DECIMAL(3, 2)) - 1000 AS a FROM orders) AS t")
def _(v):
    amount = F.floor("o_totalprice").cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)") - 1000
    share = F.col("o_orderkey") / F.lit(15000.0)
    return v.orders.select("o_orderkey", formats.comma(F.floor("o_totalprice")).alias("commas"), formats.percent(share).alias("pct"), formats.dollar(amount).alias("money"))


@query("arr_vote_cell", f"SELECT {CONTEST}, county, candidate, votes, votes / nullif(CAST(total_votes AS DOUBLE), 0) AS pct FROM d_county_long JOIN (SELECT {CONTEST}, county, total_votes FROM ({s.winners('d_county_long', CONTEST + ', county')}) AS w) AS t USING ({CONTEST}, county)")
def _(v):
    beside = win.winner_beside(long_counties(v), [*KEYS, "county"])
    cell = beside.withColumn("vote", F.struct("votes", "total_votes"))
    return cell.select(*KEYS, "county", "candidate", F.col("vote.votes").alias("votes"), sem.ratio(F.col("vote.votes"), F.col("vote.total_votes")).alias("pct"))


_SHARES = "(SELECT o_orderkey, CASE o_custkey % 8 WHEN 0 THEN 'REP' WHEN 1 THEN 'DEM' WHEN 2 THEN 'IND1' WHEN 3 THEN 'IND2' WHEN 4 THEN 'IND3' WHEN 5 THEN 'IND4' WHEN 6 THEN 'Tie' END AS winner, CASE WHEN o_orderkey % 91 = 0 THEN NULL ELSE o_totalprice / 5e5 END AS share FROM orders)"


def _shares(v: Views):
    return v.sql(f"SELECT * FROM {_SHARES} AS t")


@query("color_ramp_t", f"SELECT o_orderkey, winner, share, ramp_t, fill_col FROM ({s.painted(f'SELECT * FROM {_SHARES} AS t', 'winner', 'share')}) AS p")
def _(v):
    return _shares(v).withColumns({"ramp_t": colors.ramp_position("share"), "fill_col": colors.ramp_fill("winner", "share")})


@query("color_steps", f"SELECT o_orderkey, winner, share, {s.step_fill('winner', 'share')} AS fill_col FROM {_SHARES} AS t")
def _(v):
    return _shares(v).withColumn("fill_col", colors.step_fill("winner", "share"))


# Named functions


@query("udf_norm_name", f"SELECT candidate, {s.name_key('candidate')} AS nkey FROM (SELECT DISTINCT candidate FROM ballots) AS b")
def _(v):
    return v.ballots.select("candidate").distinct().withColumn("nkey", names.name_key("candidate"))


@query("udf_suffix_party", "SELECT race, CASE WHEN contains(upper(race), 'DEMOCRAT') THEN 'DEM' WHEN contains(upper(race), 'REPUBLIC') THEN 'REP' END AS party FROM (SELECT DISTINCT race FROM ballots) AS b")
def _(v):
    return v.ballots.select("race").distinct().withColumn("party", names.party_in_race_name("race"))


@query("udf_first_last", f"SELECT candidate, {s.first_last(s.name_key('candidate'))} AS fl FROM (SELECT DISTINCT candidate FROM roster) AS r")
def _(v):
    return v.roster.select("candidate").distinct().withColumn("fl", names.first_last(names.name_key("candidate")))


@query("udf_office_canon", f"SELECT office_bp, {s.roster_office('office_bp')} AS office FROM (SELECT DISTINCT office_bp FROM roster) AS r")
def _(v):
    return v.roster.select("office_bp").distinct().withColumn("office", offices.roster_office("office_bp"))


@query("udf_norm_party", f"SELECT party, {s.party_code('party')} AS code, count(*) AS n FROM todo_raw GROUP BY party")
def _(v):
    return v.todo_raw.groupBy("party", names.party_code("party").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("udf_party_identity", f"SELECT {s.payer('organization_name', 'recipient_first_name', 'recipient_last_name')} AS recipient, count(*) AS n FROM expend GROUP BY 1")
def _(v):
    who = names.payer_identity("organization_name", "recipient_first_name", "recipient_last_name")
    return v.expend.groupBy(who.alias("recipient")).agg(F.count(F.lit(1)).alias("n"))
