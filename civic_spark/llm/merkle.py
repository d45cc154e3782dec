"""Merkle manifest of a dataset as a content-addressed graph, and proofs by descent from its root (operator 12).

Every row is a leaf; the leaves of a group (``lang``), in the order of their ids, and then the groups' roots, become a tree
with ``fan`` children a node. The store holds one record per inner node: its digest and its children's digests. A proof starts
at the root: the digits of a leaf's rank select a child at each node, the other children are collected, and the segments
gathered on the way down are reversed, so that they lead from the leaf up. Requests that share the upper part of their way
share its rows: a level has one row per different prefix, never one row per request, so the root is no hot key.

All steps are aggregations of at most ``fan`` rows, equi-joins and built-in expressions over written tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: What a leaf is the digest of, in this order (fixed by the contract).
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def item(column: Column) -> Column:
    """``-`` for NULL, else the value's UTF-8 byte count, a colon and the value."""
    value = column.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(rows: DataFrame, group: str | None, order: list[str], name: str) -> DataFrame:
    """``rows`` with their position ``name`` from 0 within ``group`` (NULL is a group), or within all rows.

    Rows are dealt by ranges of (group, order), equal ones by a seeded draw, so that no group and no repeated row fills a
    task; a row's place in its sorted part plus the rows of the group in parts before it is its rank. Written tables on the
    way fix the order once; equal rows are interchangeable.
    """
    keys = [F.col(c).asc_nulls_first() for c in ([group] if group else []) + order]
    laid = rows.withColumn("_draw", F.rand(12)).repartitionByRange(*keys, "_draw").sortWithinPartitions(*keys, "_draw").drop("_draw")
    laid = written(laid.withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_at", 33))
    own = [group] if group else []
    counts = laid.groupBy("_part", *own).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    if group:
        running = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    else:
        running = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    before = counts.select(F.col("_part").alias("_p"), *[F.col(c).alias("_g") for c in own], "_first", F.coalesce(F.sum("_rows").over(running), F.lit(0)).alias("_before"))
    same = laid["_part"] == before["_p"]
    if group:
        same = same & laid[group].eqNullSafe(before["_g"])
    return laid.join(before, same).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).cast("long").alias(name))


@dataclass
class Manifest:
    """A built manifest.

    ``root`` (None for no rows), ``records (digest, children)``, ``leaves (doc_id, lang, rank, leaf, changed)`` and
    ``groups (lang, place, subroot, height)``; ``top`` is the height of the tree over the groups.
    """

    spark: SparkSession
    fan: int
    root: str | None
    top: int
    records: DataFrame
    leaves: DataFrame
    groups: DataFrame


def _levels(nodes: DataFrame, group: str, fan: int) -> tuple[DataFrame, list[DataFrame]]:
    """From ``(group, rank, digest)``: the last node and height of each group, and the records of its inner nodes."""
    sizes = nodes.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("left"))
    nodes = nodes.join(sizes, nodes[group].eqNullSafe(sizes["_g"])).drop("_g")  # left: nodes of the group on this level
    records, tops, height = [], [], 0
    while True:
        tops.append(nodes.where("left = 1").select(group, "digest", F.lit(height).alias("height")))
        grown = nodes.where("left > 1").groupBy(group, F.expr(f"(left + {fan - 1}) div {fan}").alias("left"), F.expr(f"rank div {fan}").alias("rank"))
        grown = grown.agg(F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("run"))
        grown = grown.select(group, "left", "rank", F.transform("run", lambda x: x["digest"]).alias("children"))
        grown = written(grown.withColumn("digest", digest(F.array_join("children", ""))), "nodes")
        if grown.isEmpty():
            break
        records.append(grown.select("digest", "children"))
        nodes, height = grown.select(group, "left", "rank", "digest"), height + 1
    ends = tops[0]
    for more in tops[1:]:
        ends = ends.unionByName(more)
    return ends, records


def build(docs: DataFrame, changed_text: Column | None = None, fan: int = 8) -> Manifest:
    """Manifest of ``docs (doc_id, source, lang, n_chars, text)``; other columns take no part.

    ``changed_text`` is what the text of a row became since (by default nothing changed); the leaf it gives is kept beside the
    true one. NULL is a value of its own in every column; NULL ids come first in their group; rows with equal ids follow
    each other by digest, repeated rows are leaves of their own. A table without rows has no root.
    """
    spark = docs.sparkSession
    parts = {c: item(F.col(c)) for c in LEAF_COLUMNS}
    was = digest(*parts.values())
    now = was if changed_text is None else digest(*(parts | {"text": item(changed_text)}).values())
    # texts stay where they are read; only digests move
    hashed = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), was.alias("leaf"), now.alias("changed")), "leaves")
    leaves = written(ranked(hashed, "lang", ["doc_id", "leaf", "changed"], "rank"), "leaves")
    ends, records = _levels(leaves.select("lang", "rank", F.col("leaf").alias("digest")), "lang", fan)
    groups = ranked(ends.select("lang", F.col("digest").alias("subroot"), "height"), None, ["lang"], "place")
    groups = written(groups.withColumn("all", F.lit(0)), "groups")  # the one group of the upper tree
    tops, more = _levels(groups.select("all", F.col("place").alias("rank"), F.col("subroot").alias("digest")), "all", fan)
    last = tops.first()
    store = hashed.select(F.col("leaf").alias("digest"), F.array("leaf").alias("children")).limit(0)
    for table in [*records, *more]:
        store = store.unionByName(table)
    # equal subtrees have one record
    store = written(store.groupBy("digest").agg(F.first("children").alias("children")), "records")
    return Manifest(spark, fan, last["digest"] if last else None, last["height"] if last else 0, store, leaves, groups)


def _descend(frontier: DataFrame, records: DataFrame, fan: int, wanted: DataFrame | None) -> DataFrame:
    """One level down: a row per selected child, with the others of its run put before the segments gathered so far.

    ``wanted (prefix columns)`` are the different prefixes of the requests on the next level; None asks for all.
    """
    keys = [c for c in frontier.columns if c not in ("digest", "proof", "prefix")]
    step = frontier.join(records, "digest").select(*keys, "prefix", "proof", "children", F.posexplode("children").alias("digit", "child"))
    left = F.array_join(F.slice("children", F.lit(1), F.col("digit")), "")
    right = F.array_join(F.slice("children", F.col("digit") + 2, F.lit(fan)), "")
    step = step.select(
        *keys, (F.col("prefix") * fan + F.col("digit")).alias("prefix"), F.col("child").alias("digest"),
        F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), "proof").alias("proof"),
    )
    if wanted is not None:
        step = step.join(wanted, [*keys, "prefix"], "left_semi")
    return step


NO_STEPS = "CAST(array() AS array<struct<left: string, right: string>>)"


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """``leaves`` columns and ``proof``: from the leaf up, the digests left and right of the way at every node.

    ``requests (lang, rank)`` picks leaves by their rank within their group; None asks for all. Ranks that are not there give
    no row; a rank asked for twice gives one.
    """
    spark, fan, records = manifest.spark, manifest.fan, manifest.records
    leaves, groups = manifest.leaves, manifest.groups
    if manifest.root is None:
        return leaves.withColumn("proof", F.expr(NO_STEPS))
    picked = None
    if requests is not None:
        asked = requests.select(F.col("lang").cast("string").alias("_l"), F.col("rank").cast("long").alias("rank")).distinct()
        picked = written(asked.join(groups, asked["_l"].eqNullSafe(groups["lang"])).select("place", "rank"), "asked")
    frontier = spark.createDataFrame([(0, manifest.root)], "prefix long, digest string").withColumn("proof", F.expr(NO_STEPS))
    for level in range(manifest.top - 1, -1, -1):
        wanted = None if picked is None else picked.select(F.expr(f"place div {fan**level}").alias("prefix")).distinct()
        frontier = _descend(frontier, records, fan, wanted)
    # at the groups' roots: prefix is the group's place; from here on it is the rank within the group
    starts = written(frontier.withColumnRenamed("prefix", "place").join(groups.select("place", "height"), "place").withColumn("prefix", F.lit(0).cast("long")), "starts")
    heights = sorted((r["height"] for r in starts.select("height").distinct().collect()), reverse=True)  # a few numbers
    frontier = starts.limit(0).drop("height")
    for level in range(heights[0] if heights else 0, 0, -1):
        frontier = frontier.unionByName(starts.where(F.col("height") == level).drop("height"))
        if level == 1:
            break
        wanted = None if picked is None else picked.select("place", F.expr(f"rank div {fan ** (level - 1)}").alias("prefix")).distinct()
        frontier = written(_descend(frontier, records, fan, wanted), "frontier")
    # the last level is spread after its join with the run of leaves, so that a proof moves once for each run
    named = leaves.join(groups.select(F.col("lang").alias("_l"), "place", "height"), leaves["lang"].eqNullSafe(F.col("_l"))).drop("_l")
    if picked is not None:
        named = named.join(picked, ["place", "rank"], "left_semi")
    content = F.struct(*leaves.columns)
    runs = named.where("height > 0").groupBy("place", F.expr(f"rank div {fan}").alias("prefix")).agg(F.collect_list(content).alias("rows"))
    last = frontier.join(records, "digest").join(runs, ["place", "prefix"]).select("proof", "children", F.explode("rows").alias("row"))
    digit = (F.col("row.rank") % fan).cast("int")
    left, right = F.array_join(F.slice("children", F.lit(1), digit), ""), F.array_join(F.slice("children", digit + 2, F.lit(fan)), "")
    deep = last.select("row.*", F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), "proof").alias("proof"))
    alone = named.where("height = 0").join(starts.select("place", "proof"), "place").select(*leaves.columns, "proof")
    return deep.unionByName(alone)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda below, step: digest(step["left"], below, step["right"]))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, from the leaf up, left to right."""
    return digest(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""))


def verified(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """Every requested leaf with its proof checked: ``folded_root`` from the leaf as it is now, ``verified`` if that is the root."""
    rows = prove(manifest, requests)
    subroots = manifest.groups.select(F.col("lang").alias("_l"), "subroot")
    rows = rows.join(subroots, rows["lang"].eqNullSafe(F.col("_l"))).drop("_l")
    rows = rows.withColumn("root", F.lit(manifest.root)).withColumn("folded_root", fold(F.col("changed"), F.col("proof")))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
