"""Office taxonomy: free-text race names to level, office, district and jurisdiction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .semantics import as_col, matched, named

# Ordered office patterns over lower-case text, first match wins.
OFFICE_PATTERNS = [
    (r"president", "President"),
    (r"united states senat|u\.?s\.? senat|\bus senat", "U.S. Senate"),
    (
        r"representative in congress|congressional district|\bcongress\b|u\.?s\.? representative|\bus representative"
        r"|u\.?s\.? house|\bus house|united states house",
        "U.S. House",
    ),
    (r"governor", "Governor"),
    (r"attorney general", "Attorney General"),
    (r"secretary of state", "Secretary of State"),
    (r"auditor", "Auditor of Public Accounts"),
    (r"commissioner of agriculture", "Commissioner of Agriculture"),
    (r"superintendent of public instruction", "Superintendent of Public Instruction"),
    (r"state treasurer|\btreasurer\b", "State Treasurer"),
    (r"state senat", "State Senate"),
    (r"state representative", "State House"),
    (r"circuit court clerk|circuit clerk", "Circuit Court Clerk"),
    (r"county clerk", "County Clerk"),
    (r"county judge", "County Judge/Executive"),
    (r"county attorney", "County Attorney"),
    (r"county commissioner", "County Commissioner"),
    (r"\bsheriff\b", "Sheriff"),
    (r"\bjailer\b", "Jailer"),
    (r"\bcoroner\b", "Coroner"),
    (r"property valuation|\bpva\b", "Property Valuation Administrator"),
    (r"\bsurveyor\b", "County Surveyor"),
    (r"\bcons?table\b", "Constable"),
    (r"magistrate", "Magistrate"),
    (r"justice of the peace", "Justice of the Peace"),
    (r"fiscal court", "Fiscal Court"),
    (r"supreme court", "Supreme Court Justice"),
    (r"court of appeals", "Court of Appeals Judge"),
    (r"commonwealth.?s? attorney", "Commonwealth's Attorney"),
    (r"family court", "Family Court Judge"),
    (r"circuit judge|circuit court judge", "Circuit Judge"),
    (r"district judge|district court judge", "District Judge"),
    (r"\bjustice\b|\bjudge\b", "Judge"),
    (r"constitutional amendment", "Constitutional Amendment"),
    (
        r"\?|amendment|are you in favor|ad valorem|local option|referendum|\bquestion\b|annexation|\bannex\b|cannabis",
        "Ballot Question",
    ),
    (r"\bmayor\b", "Mayor"),
    (r"city clerk", "City Clerk"),
    (r"commission", "City Commission"),
    (r"council|legislative body", "City Council"),
    (r"school board|board of education|\bschool\b|\bboe\b", "School Board"),
    (r"soil and water|soil & water|soil conservation", "Soil & Water Conservation"),
    (r"\bindependent\b", "School Board"),
]
OTHER_OFFICE = "Other Local"

# Level of every office.
OFFICES_BY_LEVEL = {
    "federal": ["President", "U.S. Senate", "U.S. House"],
    "state_exec": [
        "Governor",
        "Attorney General",
        "Secretary of State",
        "Auditor of Public Accounts",
        "Commissioner of Agriculture",
        "Superintendent of Public Instruction",
        "State Treasurer",
    ],
    "state_leg": ["State Senate", "State House"],
    "county": [
        "Circuit Court Clerk",
        "County Clerk",
        "County Judge/Executive",
        "County Attorney",
        "County Commissioner",
        "Sheriff",
        "Jailer",
        "Coroner",
        "Property Valuation Administrator",
        "County Surveyor",
        "Constable",
        "Magistrate",
        "Justice of the Peace",
        "Fiscal Court",
    ],
    "judicial": [
        "Supreme Court Justice",
        "Court of Appeals Judge",
        "Commonwealth's Attorney",
        "Family Court Judge",
        "Circuit Judge",
        "District Judge",
        "Judge",
    ],
    "ballot": ["Constitutional Amendment", "Ballot Question"],
    "local": [
        "Mayor",
        "City Clerk",
        "City Commission",
        "City Council",
        "School Board",
        "Soil & Water Conservation",
        "Other Local",
    ],
}

# Display order and headings of the levels.
LEVEL_LABELS = {
    "federal": "Federal",
    "state_exec": "Statewide (Executive)",
    "state_leg": "State Legislature",
    "county": "County Offices",
    "judicial": "Judicial",
    "ballot": "Ballot Questions",
    "local": "Local",
}
PARTISAN_LEVELS = ["federal", "state_exec", "state_leg", "county"]

# Offices that carry a district number, and how numbers and cities are written.
DISTRICT_OFFICES = [
    "U.S. House",
    "State Senate",
    "State House",
    "Constable",
    "Magistrate",
    "Supreme Court Justice",
    "Court of Appeals Judge",
    "Commonwealth's Attorney",
    "Family Court Judge",
    "Circuit Judge",
    "District Judge",
    "Judge",
]
DISTRICT_PATTERN = (
    r"(\d+)\s*(?:st|nd|rd|th)\s+(?:congressional|senatorial|representative|judicial|magisterial|educational|circuit"
    r"|appellate|supreme court|district|division)"
)
CITY_PATTERN = r"(City of [A-Za-z .'-]+?)(?:\s+\(|$)"

# Outside-roster spellings that override the taxonomy, later rows win.
ROSTER_OVERRIDES = [
    (r"u\.?s\.? senate|united states senate", "U.S. Senate"),
    (r"u\.?s\.? house|united states house|congress", "U.S. House"),
    (r"state senate|kentucky senate", "State Senate"),
    (r"house of representatives|state house|state representative", "State House"),
]


def _first_pattern(lower: Column) -> Column:
    office = None
    for pattern, name in OFFICE_PATTERNS:
        hit = lower.rlike(pattern)
        office = F.when(hit, name) if office is None else office.when(hit, name)
    return office.otherwise(OTHER_OFFICE)


def office_of(text: Column | str) -> Column:
    """Canonical office of a race text."""
    return named(F.lower(as_col(text)), _first_pattern)


def level_of(office: Column | str) -> Column:
    office = as_col(office)
    level = None
    for name, members in OFFICES_BY_LEVEL.items():
        hit = office.isin(*members)
        level = F.when(hit, name) if level is None else level.when(hit, name)
    return level


def with_office(df: DataFrame, text: str) -> DataFrame:
    """Add office_level, office, district and jurisdiction derived from one text column."""
    return df.withColumn("office", office_of(text)).withColumns(
        {
            "office_level": level_of("office"),
            "district": F.when(F.col("office").isin(*DISTRICT_OFFICES), matched(F.lower(text), DISTRICT_PATTERN)),
            "jurisdiction": F.when(level_of("office") == "local", F.trim(matched(text, CITY_PATTERN))),
        }
    )


def roster_office(text: Column | str) -> Column:
    """Canonical office for an outside roster's wording."""

    def with_overrides(lower: Column) -> Column:
        office = _first_pattern(lower)
        for pattern, name in ROSTER_OVERRIDES:
            office = F.when(lower.rlike(pattern), name).otherwise(office)
        return office

    return named(F.lower(as_col(text)), with_overrides)


def level_rank(level: Column | str) -> Column:
    """1-based display position of a level; a missing level counts as local."""
    levels = F.array(*[F.lit(x) for x in LEVEL_LABELS])
    return F.array_position(levels, F.coalesce(as_col(level), F.lit("local")))


def level_label(level: Column | str) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in LEVEL_LABELS.items() for x in pair])
    return F.try_element_at(lookup, F.coalesce(as_col(level), F.lit("local")))
