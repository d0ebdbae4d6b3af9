"""Configured listings, the source gate, file checksums and page parsing."""

import hashlib

from pyspark.sql import functions as F

from tidewatch.operators.snapshots import build_snapshots
from tidewatch.sources import csv_files, fixtures, pages, registry


def test_fixture_source_shows_only_active_fields(spark):
    listings = spark.createDataFrame(
        [("a1", "active", "One", 4.6, "100"), ("a2", "not_found", "Two", 3.9, "90"),
         ("a3", "active", "Three", 4.1, "80")],
        "external_id string, observation_status string, title string, rating double, price_amount string")
    seen = fixtures.fixture_observations(listings, "feed", "2025-03-03T00:00:00Z", ["a1", "a2"])
    built = {r.external_id: r for r in build_snapshots(seen).collect()}
    assert set(built) == {"a1", "a2"}
    assert built["a2"].title is None and not built["a2"].field_presence["title"]
    assert built["a1"].rating == 4.6 and built["a1"].field_presence["price"]


HEAD = "source_key,external_id,observed_at,observation_status"


def test_files_with_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"{HEAD},title\ns,1,t,active,One\ns,2,t,active,Two\n")
    (tmp_path / "b.csv").write_text("title,observation_status,observed_at,external_id,source_key,rating\n"
                                    "Three,active,t,3,s,4.5\n")
    (tmp_path / "c.csv").write_text(f'{HEAD},title\ns,4,t,active,"over\ntwo lines"\ns,5,t,active,Five\n')
    rows = csv_files.read_csv(spark, [str(tmp_path / f"{n}.csv") for n in "abc"]).collect()
    assert sorted((r.external_id, r.title, r.rating, r.row_number) for r in rows) == [
        ("1", "One", None, 1), ("2", "Two", None, 2), ("3", "Three", "4.5", 1),
        ("4", "over\ntwo lines", None, 1), ("5", "Five", None, 2)]


def test_gate(spark):
    rows = [("approved", True, ["title"], None, True, ["title"], None),
            ("pending_review", True, ["title"], None, True, ["title"], "not_approved"),
            ("approved", False, ["title"], None, True, ["title"], "automation_not_allowed"),
            ("approved", False, ["title"], None, False, ["title"], None),
            ("approved", True, ["title"], "2020-01-01", True, ["title"], "review_expired"),
            ("approved", True, ["title"], "soon", True, ["title"], "invalid_review_expiry"),
            ("approved", True, ["title"], None, True, ["price"], "capability_not_declared")]
    df = spark.createDataFrame(rows, "compliance_status string, automation_allowed boolean, "
                               "capabilities array<string>, review_expires_at string, "
                               "automated boolean, requested array<string>, want string")
    got = df.withColumn("got", registry.gate_reason(
        F.lit("2026-01-01").cast("timestamp"), F.col("automated"), F.col("requested")))
    assert got.filter(~F.col("got").eqNullSafe(F.col("want"))).count() == 0


def test_file_checksums(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x,y\n1,2\n")
    found = csv_files.file_checksums(spark, str(tmp_path / "a.csv"))
    digest = hashlib.sha256(b"x,y\n1,2\n").hexdigest()
    assert found.head().file_checksum == digest
    log = spark.createDataFrame([("o", "d", "s", digest)],
                                "organization_id string, dataset_id string, source_id string, file_checksum string")
    assert csv_files.new_files(found, log, "o", "d", "s").count() == 0
    assert csv_files.new_files(found, log, "o", "other", "s").count() == 1


def test_pages(spark):
    card = ('<article data-testid="listing-card" {0}><a href="{1}"> Villa <b>One</b></a></article>')
    html = {
        1: card.format('data-listing-id=" 7 " data-rating="4.5x" data-lat="-8.6"', "/x")
           + card.format("", "/rooms/plus/12?a=1") + card.format("", "/help"),
        2: "<html>nothing here</html>",
        3: '<meta name="page-state" content="captcha">' + card.format('data-listing-id="1"', "/x"),
        4: "No exact matches",
    }
    df = spark.createDataFrame(list(html.items()), "page_id long, html string")
    states = {r.page_id: (r.state, r.card_count, r.malformed_count)
              for r in pages.search_pages(df).collect()}
    assert states == {1: ("ok", 2, 1), 2: ("no_results", 0, 0), 3: ("captcha", 0, 0),
                      4: ("no_results", 0, 0)}
    found = pages.cards(df, "page_id").orderBy("position").collect()
    assert [(r.source_listing_id, r.title, r.rating) for r in found] == [
        ("7", "Villa One", 4.5), ("12", "Villa One", None)]
    links = spark.createDataFrame(
        [(1, '<a href="/rooms/5">A</a><a href="/rooms/5?x">B</a><a href="https://h.example/rooms/6">C</a>'
             '<a href="/rooms/none">D</a>')], "page_id long, html string")
    assert {(r.listing_id, r.url, r.label) for r in pages.listing_links(links, "https://h.example").collect()} == {
        ("5", "https://h.example/rooms/5", "A"), ("6", "https://h.example/rooms/6", "C")}
    assert pages.malformed_links(links).head().malformed == 1


def test_cards_and_states_cut_every_page_once(spark):
    """Odd blocks keep their meaning, and the plan works out the blocks of a page a single time."""
    card = '<article data-testid="listing-card"{}>{}</article>'
    html = {1: card.format(' data-listing-id=" 7 "', '<a href="">One <b>two</b></a>'),
            2: card.format(' data-canonical-url="/rooms/8?x"', "<p>none</p>"),
            3: card.format(' data-canonical-url="/rooms/9"', '<a href="/x?id=10"> </a><a>late</a>'),
            4: card.format(' data-title=" T " data-rating="4.9 stars"', '<i href="/rooms/a-b/11"></i>'),
            5: card.format("", '<a href="/help">x</a>'), 6: "you don&#39;t have permission", 7: "you don care",
            8: None, 9: "verify YOU're a human", 10: "<p>429</p>" + card.format(' data-listing-id="1"', "")}
    df = spark.createDataFrame(list(html.items()), "page_id long, html string")
    found = pages.cards(df, "page_id")
    got = {r.page_id: (r.source_listing_id, r.canonical_url, r.title, r.rating) for r in found.collect()}
    assert got == {1: ("7", "", "One two", None), 2: ("8", "/rooms/8?x", None, None),
                   3: ("10", "/x?id=10", None, None), 4: ("11", "/rooms/a-b/11", "T", 4.9)}
    states = {r.page_id: (r.state, r.card_count, r.malformed_count) for r in pages.search_pages(df).collect()}
    assert states[1] == ("ok", 1, 0) and states[5] == ("ok", 0, 1) and states[6][0] == "access_denied"
    assert states[7][0] == "no_results" and states[9][0] == "captcha" and states[10][0] == "blocked"
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("listing-card") == 1
