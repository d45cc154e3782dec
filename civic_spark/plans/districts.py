"""Past results on new districts, plan layers, and legislative candidates on the map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colors import step_fill
from ..functions.semantics import na_paste
from ..operators import winners as win
from ..operators.joins import product_join
from ..operators.spatial import points_in_polygons, with_bbox
from ..sources.tables import county_fips, voting_district
from .elections import CONTEST, precinct_table, precinct_table_listed

DISTRICT = ["chamber", "district"]
DETAIL = [*DISTRICT, *CONTEST]

# Office names per chamber and the fills of the candidate map.
CHAMBER_OFFICE = {"House": "State Representative", "Senate": "State Senator"}
NEW_CANDIDATE, INCUMBENT, NOBODY, NOT_UP = "#6baed6", "#08519c", "white", "black"

# Plan layers shown together for each chamber, and which one outlines a selected district.
PLAN_GROUPS = {
    "house_plan_hcs": ("House", "2022 HCS"),
    "house_plan": ("House", "2022 Original Bill"),
    "house_plan_dem": ("House", "2022 Democratic Plan"),
    "house_2014": ("House", "2014"),
    "sen_plan": ("Senate", "2022"),
    "sen_2014": ("Senate", "2014"),
    "cong_plan": ("Congress", "2022"),
}
OUTLINE_PLAN = {"House": "house_plan_hcs", "Senate": "sen_plan"}


def district_number(district: Column | str) -> Column:
    """Bare number of a district written ``District N`` or ``N``."""
    text = F.col(district) if isinstance(district, str) else district
    return F.replace(text, F.lit("District "), F.lit("")).try_cast("int")


def district_list(district_precincts: DataFrame) -> DataFrame:
    """Districts of each chamber in numeric order."""
    return district_precincts.select(*DISTRICT).distinct().orderBy("chamber", district_number("district").asc_nulls_last())


def precincts_of(district_precincts: DataFrame, chamber: str | None = None, district: str | None = None) -> DataFrame:
    rows = district_precincts
    if chamber is not None:
        rows = rows.filter(F.col("chamber") == chamber)
    if district is not None:
        rows = rows.filter(F.col("district") == district)
    return rows.select(*DISTRICT, "county", "precinct")


def district_races(election_data: DataFrame, district_precincts: DataFrame) -> DataFrame:
    """General-election races held in any precinct of a district, per year. Reduced to distinct places first."""
    held = election_data.filter(F.col("election") == "general").select("year", "race", "county", "precinct").distinct()
    return held.join(precincts_of(district_precincts), ["county", "precinct"]).select(*DISTRICT, "year", "race").distinct()


def district_rows(election_data: DataFrame, district_precincts: DataFrame) -> DataFrame:
    """General results per four-character precinct, for the precincts of each district.

    Votes are summed before the join, so the join moves one row per precinct and candidate.
    """
    general = election_data.filter(F.col("election") == "general")
    short = general.withColumn("precinct", F.substring("precinct", 1, 4))
    summed = short.groupBy(*CONTEST, "county", "precinct", "candidate", "party").agg(F.sum("votes").alias("votes"))
    return summed.join(precincts_of(district_precincts), ["county", "precinct"])


def district_summary(rows: DataFrame) -> DataFrame:
    """Votes per candidate in each district, most votes first."""
    summed = win.totals(rows, [*DISTRICT, *CONTEST], party=False)
    return summed.orderBy(*DISTRICT, *CONTEST, F.col("votes").desc_nulls_last(), "candidate")


def district_detail(rows: DataFrame) -> DataFrame:
    """Precincts of each district with winner or Tie, for contests with two to four candidates."""
    return precinct_table(rows, DETAIL)


def district_detail_listed(rows: DataFrame) -> DataFrame:
    """The contests that ``district_detail`` cannot hold, with one row per precinct and candidate."""
    return precinct_table_listed(rows, DETAIL)


def district_map(rows: DataFrame, fips: DataFrame, precinct_shapes: DataFrame) -> DataFrame:
    """Precinct winners of each district with step fills and labels, on the pre-2022 precinct shapes."""
    unit = [*DISTRICT, *CONTEST, "county", "precinct"]
    units = win.unit_winners(win.counted(rows, unit), unit, extra=[win.vote_label(F.col("n")).alias("label")])
    painted = units.withColumn("fill_col", step_fill("winner", "winning_share"))
    coded = painted.join(fips, "county", "left").withColumns(
        {"vtdst": voting_district("precinct"), "countyfp": county_fips("fips")}
    )
    shapes = precinct_shapes.filter(F.col("layer") == "precincts")
    return coded.join(shapes, ["countyfp", "vtdst"])


def plan_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """All plan versions in one table with the chamber and the name each is shown under."""
    out = None
    for name, layer in layers.items():
        chamber, label = PLAN_GROUPS[name]
        rows = layer.withColumnsRenamed({"DISTRICT": "district"})
        rows = rows.withColumns({"plan": F.lit(name), "chamber": F.lit(chamber), "plan_label": F.lit(label)})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def versioned_layers(layers: DataFrame) -> DataFrame:
    """Plan versions that stand in one table ``(plan, district, rings)``, with their chamber, label, points and box.

    One scan serves all versions; a plan that is not shown to users has no row.
    """
    shown = [F.struct(F.lit(k).alias("plan"), F.lit(c).alias("chamber"), F.lit(t).alias("plan_label")) for k, (c, t) in PLAN_GROUPS.items()]
    found = F.get(F.filter(F.array(*shown), lambda g: g["plan"] == F.col("plan")), F.lit(0))
    named = layers.withColumn("_group", found).filter(F.col("_group").isNotNull())
    named = named.withColumns({"chamber": F.col("_group.chamber"), "plan_label": F.col("_group.plan_label")}).drop("_group")
    return with_bbox(named).withColumn("npoints", F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r)))


def outlined_map(shown: DataFrame, layers: DataFrame) -> DataFrame:
    """The rows of a district map beside the outline of their district: its points and box.

    ``shown (chamber, district, ...)`` is a map of any districts, ``layers`` the versioned plans. Districts are matched by
    number, as plans and precinct lists write them differently; a district without an outline keeps its rows.
    """
    outline = district_outline(layers).select(
        F.col("chamber"), "district_num", F.col("plan").alias("outline_plan"), F.col("npoints").alias("outline_points"),
        *[F.col(c).alias(f"outline_{c}") for c in ("xmin", "ymin", "xmax", "ymax")],
    )
    rows = shown.withColumn("district_num", district_number("district"))
    return rows.join(outline, ["chamber", "district_num"], "left").drop("district_num")


def district_outline(layers: DataFrame) -> DataFrame:
    """Outline of each district in the plan of its chamber; both ways of writing a district are understood."""
    wanted = None
    for chamber, plan in OUTLINE_PLAN.items():
        hit = (F.col("chamber") == chamber) & (F.col("plan") == plan)
        wanted = hit if wanted is None else wanted | hit
    return layers.filter(wanted).withColumn("district_num", district_number("district"))


def full_name() -> Column:
    middle = F.col("middle_name")
    return F.when(middle.isNull(), na_paste("first_name", "last_name")).otherwise(
        na_paste("first_name", "middle_name", "last_name")
    )


def candidate_directory(candidates: DataFrame) -> DataFrame:
    """Distinct candidates with fill (new or incumbent) and label ``district-First M Last``."""
    people = candidates.distinct()
    return people.withColumns(
        {
            "district": F.col("district").cast("string"),
            "fill": F.when(F.col("lrc_website").isNull(), NEW_CANDIDATE).otherwise(INCUMBENT),
            "label": na_paste(F.col("district").cast("string"), full_name(), sep="-"),
        }
    )


def district_candidates_map(plan: DataFrame, candidates: DataFrame, chamber: str) -> DataFrame:
    """Districts of a plan with their candidates; empty ones are white, senate seats not up this year black."""
    people = candidate_directory(candidates.filter(F.col("office") == CHAMBER_OFFICE[chamber]))
    shapes = plan.withColumn("district", F.replace("district", F.lit("District "), F.lit("")))
    shown = shapes.join(people, "district", "left")
    fill = F.coalesce("fill", F.lit(NOBODY))
    if chamber == "Senate":
        up = F.col("district").try_cast("int") % 2 != 0
        fill = F.when(F.col("fill").isNotNull(), F.col("fill")).when(up, NOBODY).otherwise(NOT_UP)
    return shown.withColumn("fill", fill)


def candidates_at_point(points: DataFrame, plans: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates, with their links, of the districts that contain each point, in every chamber at once.

    ``plans (chamber, district, rings)`` holds the plans of all chambers; points are placed in one join. Every point of a
    district meets every candidate of it, and districts are few, so these pairs are dealt over tasks by blocks.
    """
    found = points_in_polygons(points, plans.select(*DISTRICT, "rings"), DISTRICT)
    located = found.withColumn("district_num", district_number("district")).drop("district")
    chamber = None
    for name, office in CHAMBER_OFFICE.items():
        hit = F.col("office") == office
        chamber = F.when(hit, name) if chamber is None else chamber.when(hit, name)
    people = candidates.withColumns({"name": full_name(), "chamber": chamber}).filter(F.col("chamber").isNotNull())
    links = ["political_website", "lrc_website", "facebook", "twitter", "instagram"]
    people = people.select("chamber", "name", F.col("district").try_cast("int").alias("district_num"), *links)
    people = people.withColumn("district_label", F.concat(F.lit("District "), F.col("district_num").cast("string")))
    return product_join(located, people, ["chamber", "district_num"])
