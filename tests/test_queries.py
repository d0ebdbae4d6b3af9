"""Registered queries against DuckDB on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import registry

FOLDER = "/root/testdata/sf0.001"
registry.load()

# Every family once; the driver compares all of them.
SAMPLE = (
    "lifecycle_transitions", "lifecycle_states", "run_health", "snapshots", "previous_snapshots",
    "field_diffs", "field_events", "creation_events", "import_outcomes", "import_metrics",
    "gated_runs", "visible_facts", "property_page_after", "map_clusters", "dataset_overview",
    "csv_cells", "merged_listings", "rolled_back_merge", "merge_candidates", "search_cells",
    "points_in_cells", "deduped_discoveries", "market_checksums", "collection_outcomes",
    "verified_listings", "search_page_cards", "detail_pages", "document_sets", "canonical_urls",
    "area_table", "extra_degradations",
)
HOT_SAMPLE = ("lifecycle_transitions", "previous_snapshots", "field_diffs", "import_outcomes",
              "merged_listings", "area_table", "verified_listings")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, int) and not isinstance(value, bool):
        return f"{float(value):.6g}" if abs(value) < 1000000 else str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def check(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(registry.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    check(spark, duck, name)


@pytest.mark.parametrize("name", HOT_SAMPLE)
def test_matches_sql_when_keys_are_hot(spark, duck, small_groups, name):
    check(spark, duck, name)


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) == set(registry.SQL)
