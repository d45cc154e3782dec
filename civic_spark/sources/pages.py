"""Rows out of HTML pages held in a table: list items of a roster block, and links of a hub page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import matched, named

# How roster pages mark their blocks, items, offices, parties and addresses.
BLOCK = r'^<div[^>]*class="[^"]*\bwidget-data-list\b[^"]*"[^>]*>'
ITEM = r"(?s)<li\b[^>]*>.*?</li>"
ANCHOR_TAG = r"<a\b[^>]*>"
ANCHOR = r"(?s)<a\b[^>]*>(.*?)</a>"
TITLE = r'\btitle="([^"]*)"'
OFFICE = r"\(([^()]*?),\s*Kentucky,\s*candidate"
PARTY = r"\((R|D)\)"
COUNTY = r"/([A-Za-z_]+)_County"
HREF = r'<a\b[^>]*\bhref="([^"]*)"'


def visible_text(markup: Column) -> Column:
    """Text of a fragment: tags removed, the common entities decoded, white space collapsed."""
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(markup, r"<[^>]*>", "")), r"\s+", " "))


def decoded(text: Column) -> Column:
    """Common entities as characters."""
    # The ampersand goes last: decoding it first would decode "&amp;lt;" twice.
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def roster_blocks(html: Column) -> Column:
    """Markup of a page's roster blocks, each up to the tag that closes it, whatever is nested inside; an unclosed
    block reaches to the end of the page.

    One pass over the page's tags counts how deep they are; only where a block starts and how long it is are kept.
    """

    def step(state: Column, piece: Column) -> Column:
        depth, at = state["depth"], state["at"] + 1
        opens = (depth == 0) & piece.rlike(BLOCK)
        closes = (depth == 1) & piece.rlike(r"^</div\b")
        deeper = (
            F.when(opens, 1)
            .when(depth == 0, 0)
            .when(piece.rlike(r"^<div\b"), depth + 1)
            .when(piece.rlike(r"^</div\b"), depth - 1)
            .otherwise(depth)
        )
        start = F.when(opens, at).otherwise(state["start"])
        span = F.array(F.struct(state["start"].alias("start"), (at - state["start"]).alias("size")))
        spans = F.when(closes, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(deeper.alias("depth"), at.alias("at"), start.alias("start"), spans.alias("spans"))

    def blocks(pieces: Column) -> Column:
        none = F.array().cast("array<struct<start: int, size: int>>")
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(1).alias("start"), none.alias("spans"))

        def finish(state: Column) -> Column:
            rest = F.array(F.struct(state["start"].alias("start"), (state["at"] + 1 - state["start"]).alias("size")))
            return F.when(state["depth"] > 0, F.concat(state["spans"], rest)).otherwise(state["spans"])

        spans = F.aggregate(pieces, start, step, finish)
        return F.array_join(F.flatten(F.transform(spans, lambda s: F.slice(pieces, s["start"], s["size"]))), "")

    return named(F.split(html, r"(?=<div\b|</div\b)"), blocks)


def roster_items(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(county, office_bp, candidate, party) of every list item with a name and a party."""
    listed = F.regexp_extract_all(roster_blocks(F.col(html)), F.lit(ITEM), F.lit(0))
    items = pages.select(F.col(url).alias("_url"), F.explode(listed).alias("_item"))
    letter = matched(visible_text(F.col("_item")), PARTY)
    item = F.col("_item")
    name = F.when(item.rlike(ANCHOR), visible_text(F.regexp_extract(item, ANCHOR, 1)))
    title = decoded(matched(F.regexp_extract(item, ANCHOR_TAG, 0), TITLE))
    found = items.select(
        F.replace(matched("_url", COUNTY), F.lit("_"), F.lit(" ")).alias("county"),
        matched(title, OFFICE).alias("office_bp"),
        name.alias("candidate"),
        F.when(letter == "R", "REP").when(letter == "D", "DEM").alias("party"),
    )
    return found.filter(F.col("candidate").isNotNull() & F.col("party").isNotNull()).distinct()


def links(pages: DataFrame, keep: str, host: str = "", limit: int | None = None, html: str = "html") -> DataFrame:
    """Distinct link targets that match a pattern, with the host put in front."""
    targets = pages.select(F.explode(F.regexp_extract_all(F.col(html), F.lit(HREF), F.lit(1))).alias("href"))
    kept = targets.filter(F.col("href").rlike(keep)).distinct()
    out = kept.select(F.concat(F.lit(host), "href").alias("url"))
    return out if limit is None else out.orderBy("url").limit(limit)
