"""Standard reports, and rule versions side by side."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.plans.reprocess import Versions
from tidewatch.sinks import report_types

DAY = dt.datetime(2025, 3, 1)


def snapshots(spark):
    rows = [("d", "north", k, d, s) for k, d, s in (
        ("a", 0, "active"), ("a", 0, "active"), ("b", 0, "active"), ("a", 3, "not_found"), ("b", 5, "active"))]
    rows += [("d", None, "c", 2, "active"), ("e", "south", "z", 1, "active")]
    return spark.createDataFrame(
        [(x, r, k, DAY + dt.timedelta(days=d), s) for x, r, k, d, s in rows],
        "dataset_id string, region string, listing_id string, observed_at timestamp, observation_status string")


def test_region_change_fills_gaps(spark):
    got = sorted(((r.dataset_id, r.region or "", r.day.day, r.observed, r.active_listings, r.change)
                  for r in report_types.region_change(snapshots(spark)).collect()))
    assert got == [
        ("d", "", 1, False, 0, None), ("d", "", 2, False, 0, 0), ("d", "", 3, True, 1, 1), ("d", "", 4, False, 1, 0),
        ("d", "", 5, False, 1, 0), ("d", "", 6, False, 1, 0),
        ("d", "north", 1, True, 2, None), ("d", "north", 2, False, 2, 0), ("d", "north", 3, False, 2, 0),
        ("d", "north", 4, True, 0, -2), ("d", "north", 5, False, 0, 0), ("d", "north", 6, True, 1, 1),
        ("e", "south", 2, True, 1, None)]


def events(spark, n):
    return spark.range(n).select(
        F.lit("d").alias("dataset_id"), (F.col("id") % 2).alias("property_id"), F.col("id").cast("string").alias("event_id"),
        F.lit("price_changed").alias("event_type"), (F.lit(DAY).cast("timestamp") + F.make_dt_interval(days=F.col("id").cast(
            "int"))).alias("event_at"), F.lit("l").alias("listing_id"), F.concat(F.lit("=sum "), "id").alias("summary"),
        F.lit(None).cast("long").alias("previous_snapshot_id"), F.col("id").alias("current_snapshot_id"),
        F.lit("r").alias("run_id"), F.lit("diff").alias("evidence_type"), F.lit("{}").alias("metadata"))


@pytest.mark.parametrize("hot", [False, True])
def test_history_and_bounded_evidence(spark, hot, request):
    if hot:
        request.getfixturevalue("small_groups")
    some = events(spark, 25)
    history = {(r.property_id, r.number): (r.event_id, r.previous_type, r.days_since)
               for r in report_types.property_history(some).collect()}
    assert len(history) == 25 and history[(0, 1)] == ("0", None, None)
    assert all(v == (str(2 * n - 2 + p), "price_changed", 2) for (p, n), v in history.items() if n > 1)
    lines = {(r.property_id, r.line): r for r in report_types.event_evidence(some, bundle=5).collect()}
    assert {k: r.events for k, r in lines.items()} == {(0, 0): 5, (0, 1): 5, (0, 2): 3, (1, 0): 5, (1, 1): 5, (1, 2): 2}
    assert lines[(1, 2)].evidence == (
        "2025-03-22 00:00:00 | price_changed | diff | 21 | =sum 21\n2025-03-24 00:00:00 | price_changed | diff | 23 | =sum 23")


def test_reports_are_written_in_order_with_a_manifest(spark, tmp_path):
    path = str(tmp_path / "reports")
    reports = {"region_change": report_types.region_change(snapshots(spark)),
               "property_history": report_types.property_history(events(spark, 25))}
    first = report_types.write_reports(path, reports, {"region_change": {"until": "2025-03-06"}}).collect()
    assert sorted((r.report, r.dataset_id, r.lines) for r in first) == [
        ("property_history", "d", 25), ("region_change", "d", 12), ("region_change", "e", 1)]
    again = report_types.write_reports(path, reports, {"region_change": {"until": "2025-03-06"}}).collect()
    assert sorted(first) == sorted(again)  # entries keep their first batch
    batch = first[0].batch
    text = b"".join(f.read_bytes() for f in sorted(
        (tmp_path / f"reports/data/{batch}/report=property_history/dataset_id=d").glob("part-*")))
    lines = text.decode().split("\r\n")[:-1]
    assert len(lines) == 25 and lines[0].startswith("0,0,price_changed,") and ",'=sum 0," in lines[0]
    assert [int(x.split(",")[1]) for x in lines] == [*range(0, 25, 2), *range(1, 25, 2)]


def test_versions_stand_side_by_side(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "v"), "listing_id")
    keys = spark.range(20).select(F.col("id").alias("listing_id"))
    rows = lambda n, name: keys.filter(F.col("listing_id") < n).select("listing_id", F.lit(name).alias("kind"))
    versions.put("rules:v1", rows(15, "one"), keys, "ana", "2025-01-01", "first")
    files = {f: f.read_bytes() for f in (tmp_path / "v/rows").rglob("part-*")}
    # A rerun that broke after some rows is repeated, for fewer keys, and then once more without rows.
    versions.put("rules:v2", rows(20, "broken"), keys, "ana", "2025-01-02", "second")
    versions.put("rules:v2", rows(5, "two"), keys.filter("listing_id < 10"), "ana", "2025-01-02", "second")
    assert all(f.read_bytes() == b for f, b in files.items())
    assert versions.read("rules:v1").count() == 15 and versions.read("rules:v2").count() == 5
    current = {r.listing_id: r.kind for r in versions.current(["rules:v2", "rules:v1"]).collect()}
    assert current == {**{k: "two" for k in range(5)}, **{k: "one" for k in range(10, 15)}}
    assert versions.current(["rules:v1"]).count() == 15
    versions.put("rules:v2", rows(0, "none"), keys, "bo", "2025-01-03", "third")
    assert versions.read("rules:v2").count() == 0 and versions.current(["rules:v2", "rules:v1"]).count() == 0
    assert sorted((r.actor, r.rule_version, r["keys"]) for r in versions.audit.read().collect()) == [
        ("ana", "rules:v1", 20), ("ana", "rules:v2", 20), ("bo", "rules:v2", 20)]
