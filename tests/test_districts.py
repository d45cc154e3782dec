"""Districts, plans, candidates and point-in-polygon."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from civic_spark.operators import spatial
from civic_spark.operators.joins import product_join
from civic_spark.operators.spatial import points_in_polygons, polygons_from_vertices, with_bbox
from civic_spark.plans import districts

from .test_elections import SCHEMA, row

RINGS = {
    "notched": [[(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]],
    "holed": [[(5, 0), (9, 0), (9, 4), (5, 4)], [(6, 1), (6, 3), (8, 3), (8, 1)]],
    "triangle": [[(-3, -3), (-1, -3), (-2, -1)]],
}


@pytest.fixture()
def polygons(frame):
    rows = [(d, i, j, float(x), float(y)) for d, rings in RINGS.items() for i, ring in enumerate(rings) for j, (x, y) in enumerate(ring)]
    random.Random(3).shuffle(rows)
    return polygons_from_vertices(frame("district STRING, ring INT, seq INT, x DOUBLE, y DOUBLE", *rows), ["district"])


def brute(x, y, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


@pytest.mark.parametrize("cells", [1, 4, 40])
def test_points_match_brute_force(frame, polygons, cells, monkeypatch):
    monkeypatch.setattr(spatial, "CELLS_A_SIDE", cells)
    rng = random.Random(7)
    points = [(i, rng.uniform(-4, 10), rng.uniform(-4, 5)) for i in range(600)]
    points += [(9001, 7.0, 2.0), (9002, 2.0, 3.0), (9003, 5.5, 2.0), (9004, 2.0, 0.5)]  # hole, notch, ring, body
    got = {(r.id, r.district) for r in points_in_polygons(frame("id INT, x DOUBLE, y DOUBLE", *points), polygons, ["district"]).collect()}
    want = {(i, d) for i, x, y in points for d, rings in RINGS.items() if brute(x, y, rings)}
    assert got == want
    assert {i for i, _ in got if i > 9000} == {9003, 9004}


def test_a_very_large_polygon_has_few_tiles(frame):
    """One polygon a thousand times as wide as the others, points on its level and on theirs."""
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    shapes = {"large": [(x * 1000 - 500, y * 1000 - 500) for x, y in square]}
    shapes |= {f"small{i}": [(x + 2 * i, y) for x, y in square] for i in range(20)}
    shapes["flat"], shapes["dot"] = [(0.0, 5.0), (9.0, 5.0)], [(3.0, 3.0)]
    rows = [(d, 0, j, x, y) for d, ring in shapes.items() for j, (x, y) in enumerate(ring)]
    polygons = polygons_from_vertices(frame("district STRING, ring INT, seq INT, x DOUBLE, y DOUBLE", *rows), ["district"])
    boxed = spatial.with_level(with_bbox(polygons))
    tiles = {r.district: r["count"] for r in spatial.tiles_of(boxed, ["district"]).groupBy("district").count().collect()}
    assert tiles.keys() == shapes.keys() and max(tiles.values()) <= (spatial.CELLS_A_SIDE + 1) ** 2
    assert "rings" not in spatial.tiles_of(boxed, ["district"]).columns
    points = [(1, 0.5, 0.5), (2, 400.0, 400.0), (3, 1.5, 0.5), (4, 600.0, 0.0), (5, 38.5, 0.25)]
    got = {(r.id, r.district) for r in points_in_polygons(frame("id INT, x DOUBLE, y DOUBLE", *points), polygons, ["district"]).collect()}
    assert got == {(1, "large"), (1, "small0"), (2, "large"), (3, "large"), (5, "large"), (5, "small19")}
    nowhere = points_in_polygons(frame("id INT, x DOUBLE, y DOUBLE", *points), polygons.limit(0), ["district"])
    assert nowhere.count() == 0 and nowhere.columns == ["id", "x", "y", "district"]


def test_boxes(polygons):
    boxes = {r.district: (r.xmin, r.ymin, r.xmax, r.ymax) for r in with_bbox(polygons).collect()}
    assert boxes == {"notched": (0, 0, 4, 4), "holed": (5, 0, 9, 4), "triangle": (-3, -3, -1, -1)}


@pytest.fixture()
def sides(frame):
    return frame(
        "chamber STRING, district STRING, county STRING, precinct STRING",
        ("House", "District 10", "x", "A101"), ("House", "District 2", "y", "B101"), ("House", "District 2", "z", "C101"), ("Senate", "District 1", "x", "A101"),
    )


@pytest.fixture()
def results(frame):
    return frame(
        SCHEMA,
        row("x", "A101", "ANN", "REP", 5), row("x", "A101b", "ANN", "REP", 2), row("x", "A101", "BOB", "DEM", 7),
        row("x", "A101", "BOB", "DEM", 7),  # repeated rows are not removed here
        row("y", "B101", "ANN", "REP", None), row("y", "B101", "ANN", "REP", 4), row("q", "Q1", "ANN", "REP", 9),
        row("x", "A101", "PAM", "primary", 9, election="primary"),
    )


def test_reaggregation(results, sides):
    rows = districts.district_rows(results, sides)
    got = {(r.chamber, r.district, r.candidate): r.votes for r in districts.district_summary(rows).collect()}
    assert got == {
        ("House", "District 10", "ANN"): 7, ("House", "District 10", "BOB"): 14, ("House", "District 2", "ANN"): 4,
        ("Senate", "District 1", "ANN"): 7, ("Senate", "District 1", "BOB"): 14,
    }
    detail = {(r.chamber, r.unit): (r.winner, r.can1_votes) for r in districts.district_detail(rows).collect()}
    assert detail == {("House", "X - A101"): ("DEM", 7), ("Senate", "X - A101"): ("DEM", 7)}


def test_every_ballot_size_is_in_one_of_the_details(frame, sides):
    ballot = lambda race, n: [row("x", "A101", f"C{i}", "REP", 5, race=race) for i in range(n)]
    results = frame(SCHEMA, *ballot("one", 1), *ballot("two", 2), *ballot("four", 4), *ballot("five", 5))
    rows = districts.district_rows(results, sides)
    wide, listed = districts.district_detail(rows).collect(), districts.district_detail_listed(rows).collect()
    assert {(r.chamber, r.race, r.winner) for r in wide} == {(c, r, "Tie") for c in ("House", "Senate") for r in ("two", "four")}
    assert sorted((r.race, r.candidate) for r in listed if r.chamber == "House") == [("five", f"C{i}") for i in range(5)] + [("one", "C0")]


def test_lists_and_races(results, sides):
    assert [r.district for r in districts.district_list(sides).collect()] == ["District 2", "District 10", "District 1"]
    assert {(r.chamber, r.district) for r in districts.district_races(results, sides).collect()} == {
        ("House", "District 10"), ("House", "District 2"), ("Senate", "District 1"),
    }
    assert districts.precincts_of(sides, "House", "District 2").count() == 2


def test_overlay(frame, results, sides):
    shapes = frame("layer STRING, countyfp STRING, vtdst STRING", ("precincts", "001", "00A101"), ("precincts_22", "001", "00A101"))
    fips = frame("county STRING, fips BIGINT", ("x", 21001))
    got = districts.district_map(districts.district_rows(results, sides), fips, shapes).collect()
    assert {(r.chamber, r.winner, r.fill_col, r.label) for r in got} == {
        ("House", "DEM", "#6baed6", "ANN: 7<br>BOB: 14"), ("Senate", "DEM", "#6baed6", "ANN: 7<br>BOB: 14"),
    }


@pytest.fixture()
def people(frame):
    return frame(
        "office STRING, district INT, first_name STRING, middle_name STRING, last_name STRING, lrc_website STRING, political_website STRING, facebook STRING, twitter STRING, instagram STRING",
        ("State Representative", 1, "Ann", None, "Lee", "w", "p", "f", "t", "i"),
        ("State Representative", 1, "Ann", None, "Lee", "w", "p", "f", "t", "i"),
        ("State Representative", 1, "Bob", "M", "Ray", None, None, "f", "t", "i"),
        ("State Senator", 2, "Cy", None, "Fox", None, None, "f", "t", "i"),
    )


def test_candidates(frame, people):
    labels = {(r.label, r.fill) for r in districts.candidate_directory(people).collect()}
    assert labels == {("1-Ann Lee", "#08519c"), ("1-Bob M Ray", "#6baed6"), ("2-Cy Fox", "#6baed6")}
    plan = frame("district STRING", ("District 1",), ("District 2",), ("District 3",), ("District 4",))
    house = {(r.district, r.fill) for r in districts.district_candidates_map(plan, people, "House").collect()}
    assert house == {("1", "#08519c"), ("1", "#6baed6"), ("2", "white"), ("3", "white"), ("4", "white")}
    senate = {(r.district, r.fill) for r in districts.district_candidates_map(plan, people, "Senate").collect()}
    assert senate == {("1", "white"), ("2", "#6baed6"), ("3", "white"), ("4", "black")}


def test_candidates_at_point(frame, people):
    square = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]
    rows = [(d, 0, j, x + dx, y) for d, dx in (("District 1", 0), ("2", 2)) for j, (x, y) in enumerate(square[0])]
    plan = polygons_from_vertices(frame("district STRING, ring INT, seq INT, x DOUBLE, y DOUBLE", *rows), ["district"])
    points = frame("id INT, x DOUBLE, y DOUBLE", (1, 0.5, 0.5), (2, 2.5, 0.5), (3, 9.0, 9.0))
    plans = plan.withColumn("chamber", F.explode(F.array(F.lit("House"), F.lit("Senate"))))
    found = districts.candidates_at_point(points, plans, people).collect()
    house = {(r.id, r.name, r.district_label) for r in found if r.chamber == "House"}
    assert house == {(1, "Ann Lee", "District 1"), (1, "Bob M Ray", "District 1")}
    senate = {(r.id, r.name) for r in found if r.chamber == "Senate"}
    assert senate == {(2, "Cy Fox")}


def test_points_of_one_district_are_dealt_over_tasks(spark, frame):
    """Thousands of points and of candidates in one district: their pairs do not come out of one task."""
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    plan = polygons_from_vertices(frame("district STRING, ring INT, seq INT, x DOUBLE, y DOUBLE", *[("1", 0, j, x, y) for j, (x, y) in enumerate(square)]), ["district"])
    points = spark.range(5000).selectExpr("id", "0.5D AS x", "(id + 1) / 6000 AS y")
    copies = spark.range(4000).selectExpr(
        "'State Representative' AS office", "1 AS district", "'Ann' AS first_name", "cast(NULL AS string) AS middle_name", "'Lee' AS last_name",
        *[f"'w' AS {c}" for c in ("lrc_website", "political_website", "facebook", "twitter", "instagram")],
    )
    found = districts.candidates_at_point(points, plan.withColumn("chamber", F.lit("House")), copies)
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 5000 * 4000 and max(tasks) < sum(tasks) / 2
    assert found.groupBy("id").count().filter("count <> 4000").isEmpty()


def test_product_join_equals_a_plain_join(frame):
    rng = random.Random(11)
    keys = [("a", 1)] * 60 + [("a", 2)] * 9 + [("b", 1), ("b", None), (None, 2)]
    left = frame("k STRING, n INT, x INT", *[(*rng.choice(keys), rng.randrange(5)) for _ in range(400)])
    right = frame("k STRING, n INT, y INT", *[(*rng.choice(keys), rng.randrange(5)) for _ in range(90)], ("c", 7, 1))
    want = sorted(left.join(right, ["k", "n"]).collect())
    for block_rows, task_pairs in ((1, 500), (7, 1000), (1024, 2_000_000)):
        assert sorted(product_join(left, right, ["k", "n"], block_rows, task_pairs).collect()) == want
    assert product_join(left.limit(0), right, ["k", "n"]).count() == 0
    assert product_join(left, right.filter("k = 'c'"), ["k", "n"]).columns == ["k", "n", "x", "y"]


def test_product_join_unfolds_slices(spark, frame):
    """The join yields a row per right row and slice of the left; pairs only come out of the lists above it."""
    left = frame("k INT, x INT, t STRING", *[(i % 2, i, None if i % 3 else str(i)) for i in range(300)])
    right = frame("k INT, y INT", *[(i % 2, i) for i in range(50)], (None, 1), (5, 1))
    found = product_join(left, right, ["k"], block_rows=64)
    assert sorted(found.collect(), key=str) == sorted(left.join(right, "k").collect(), key=str) and found.count() == 2 * 150 * 25
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline(_rows") < plan.index("Join Inner, ")
    assert product_join(left.select("k"), right, ["k"]).columns == ["k", "y"] and product_join(left.select("k"), right.select("k"), ["k"]).count() == 2 * 150 * 25


def test_plan_layers(frame):
    new, old = frame("district STRING", ("District 1",)), frame("DISTRICT STRING", ("1",))
    layers = districts.plan_layers({"house_plan_hcs": new, "house_2014": old, "sen_plan": new})
    assert {(r.plan_label, r.chamber, r.district) for r in layers.collect()} == {
        ("2022 HCS", "House", "District 1"), ("2014", "House", "1"), ("2022", "Senate", "District 1"),
    }
    outline = districts.district_outline(layers).filter(F.col("district_num") == 1)
    assert {r.plan for r in outline.collect()} == {"house_plan_hcs", "sen_plan"}


def test_versions_have_shapes_of_their_own(frame):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    names = [*districts.PLAN_GROUPS, "draft"]
    rows = [(plan, "District 1" if k % 2 else "1", 0, j, x * (k + 1), y) for k, plan in enumerate(names) for j, (x, y) in enumerate(square)]
    rows += [("sen_plan", "1", 1, j, x / 2, y / 2) for j, (x, y) in enumerate(square)]
    table = polygons_from_vertices(frame("plan STRING, district STRING, ring INT, seq INT, x DOUBLE, y DOUBLE", *rows), ["plan", "district"])
    layers = districts.versioned_layers(table)
    got = {r.plan: (r.chamber, r.xmax, r.npoints) for r in layers.collect()}
    assert got.keys() == districts.PLAN_GROUPS.keys() and len({x for _, x, _ in got.values()}) == 7
    assert got["sen_plan"][2] == 8 and got["house_plan"][2] == 4
    shown = frame("chamber STRING, district STRING, precinct STRING", ("House", "District 1", "a"), ("Senate", "1", "b"), ("House", "District 2", "c"))
    outlined = {r.precinct: (r.outline_plan, r.outline_points) for r in districts.outlined_map(shown, layers).collect()}
    assert outlined == {"a": ("house_plan_hcs", 4), "b": ("sen_plan", 8), "c": (None, None)}
