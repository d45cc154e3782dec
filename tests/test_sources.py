"""Readers, writers, page extraction and incremental runs."""

from __future__ import annotations

from civic_spark.sources import pages, sinks, tables
from civic_spark.streaming.incremental import extract_new_pages

PAGE = """<html><ul><li><a title="No (Mayor, Kentucky, candidate 2026)">Outside</a> (R)</li></ul>
<div class="x widget-data-list"><p><b>Sheriff</b></p><ul>
<li><a href="/a" title="Ann (Sheriff of X, Kentucky, candidate 2026)">Ann &amp;amp; <i>Lee</i></a> (R)</li>
<li class="b"><a title="Bob (Jailer (old), Kentucky, candidate 2026)">Bob</a>
 (D)</li>
<li><a title="x">Cy</a></li><li>Di (R)</li>
<li><a href="/a" title="Ann (Sheriff of X, Kentucky, candidate 2026)">Ann &amp;amp; <i>Lee</i></a> (R)</li></ul></div></html>"""


def test_roster_items(frame):
    rows = pages.roster_items(frame("url STRING, html STRING", ("https://h/Le_Roy_County,_X", PAGE), ("/none", "<p>no list</p>"))).collect()
    assert {tuple(r) for r in rows} == {("Le Roy", "Sheriff of X", "Ann &amp; Lee", "REP"), ("Le Roy", None, "Bob", "DEM")}
    assert len(rows) == 2


def test_roster_blocks_end_at_their_own_closing_tag(frame):
    item = '<li><a href="/a" title="{0} (Jailer, Kentucky, candidate 2026)">{0}</a> (R)</li>'
    html = (
        '</div><div><div class="widget-data-list"><div>x<div></div></div>' + item.format("In") + "</div>" + item.format("Out")
        + '</div><divider><div id="q" class="a widget-data-list b">' + item.format("Open")
    )
    rows = frame("url STRING, html STRING", ("/A_County", html), ("/B_County", None), ("/C_County", ""))
    assert {r.candidate for r in pages.roster_items(rows).collect()} == {"In", "Open"}


def test_links(frame):
    hub = frame("html STRING", ('<a href="/A_County">x</a><a class="k" href="/B_County">y</a><a href="/other">z</a><a>n</a>',), ('<a href="/A_County">',))
    assert {r.url for r in pages.links(hub, r"_County$", "https://h").collect()} == {"https://h/A_County", "https://h/B_County"}
    assert [r.url for r in pages.links(hub, r"_County$", limit=1).collect()] == ["/A_County"]


def test_csv_round_trip_and_cleaning(spark, frame, tmp_path):
    raw = frame(tables.OVERRIDE_SCHEMA, (2020, 'R "q", x', None, " rep "), (2020, "R", "c", ""), (2020, "R", "d", None))
    sinks.write_csv(raw, str(tmp_path / "o"))
    got = tables.clean_overrides(tables.scan_csv(spark, str(tmp_path / "o"), tables.OVERRIDE_SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(2020, 'R "q", x', "", "REP")]
    assert tables.scan_csv(spark, None, tables.OVERRIDE_SCHEMA).count() == 0


def test_overwrite_append_and_jobs(spark, frame, tmp_path):
    path, rows = str(tmp_path / "t"), frame("k INT", (2,), (1,))
    assert sinks.run_job(rows, path).count() == 2 and not (tmp_path / "t").exists()
    assert sinks.run_job(rows, path, write=True, sort_by=["k"]).count() == 2
    sinks.append_table(rows, path)
    assert spark.read.parquet(path).count() == 4
    sinks.overwrite_table(rows, path)
    assert spark.read.parquet(path).count() == 2
    seed = str(tmp_path / "s")
    sinks.seed_csv(rows, seed)
    sinks.seed_csv(rows.filter("k = 1"), seed)
    assert tables.scan_csv(spark, seed, "k INT").count() == 2


def test_shared_folder_follows_the_session(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    folder = sinks.shared_folder(spark)
    assert folder.startswith(named.rstrip("/")) if named else folder
    assert folder != sinks.shared_folder(spark)


def test_scan_sql_and_codes(spark, frame):
    assert tables.scan_sql(spark, "SELECT DISTINCT k FROM {t}", t=frame("k INT", (1,), (1,))).count() == 1
    got = frame("fips BIGINT, p STRING", (21037, "A101")).select(tables.county_fips("fips"), tables.voting_district("p")).first()
    assert tuple(got) == ("037", "00A101")
    assert tables.zip_dimension(frame("zip_code INT, county STRING", (1, "a"))).schema["zip_code"].dataType.simpleString() == "string"


def test_incremental_reads_each_page_once(spark, frame, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("pages", "out", "cp"))
    schema = "url STRING, html STRING"
    run = lambda: extract_new_pages(spark, source, schema, out, checkpoint)
    frame(schema, ("/A_County", PAGE)).write.parquet(source)
    assert run().count() == 2
    frame(schema, ("/B_County", PAGE)).write.mode("append").parquet(source)
    assert {r.county for r in run().collect()} == {"A", "B"}
    assert run().count() == 4
    assert spark.read.parquet(out).count() == 4


def test_profile_reads_every_column_once(frame):
    rows = frame("a INT, b STRING, c ARRAY<INT>, d DATE, e DOUBLE", (3, "x", [1, 2], None, -0.0), (None, "a", [], None, 2.5), (7, None, None, None, None))
    got = {r.column_name: (r.n, r.nulls, r.smallest, r.largest, r.smallest_number, r.largest_number) for r in tables.profile(rows).collect()}
    assert got == {
        "a": (3, 1, None, None, 3.0, 7.0), "b": (3, 1, "a", "x", None, None), "c": (3, 1, None, None, 0.0, 2.0),
        "d": (3, 3, None, None, None, None), "e": (3, 1, None, None, 0.0, 2.5),
    }
    assert str(got["e"][4]) == "0.0"
    assert [(r.n, r.nulls) for r in tables.profile(rows.limit(0)).collect()] == [(0, 0)] * 5


def test_layer_of_vertices(frame):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]
    rows = [("A1", ring, j, x + 2 * ring, y) for ring in (0, 1) for j, (x, y) in enumerate(square)]
    (one,) = tables.scan_layer(tables.layer_shapes(frame("precinct STRING, ring INT, seq INT, x DOUBLE, y DOUBLE", *rows), ["precinct"]), "precinct").collect()
    assert (one.vtdst, one.npoints, len(one.rings), one.xmin, one.xmax, one.ymax) == ("00A1", 6, 2, 0.0, 3.0, 1.0)
