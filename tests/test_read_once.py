"""Branches of one plan read what they share once; tasks are sized by rows."""

import pytest
from pyspark.sql import functions as F

import registry
from registry import snapshots as registered
from registry.tables import Tables
from tidewatch.operators import scans
from tidewatch.operators.snapshots import VALUE_COLUMNS, build_snapshots, presence_map
from tidewatch.plans import reprocess
from tidewatch.sinks import report_types

FOLDER = "/root/testdata/sf0.001"
registry.load()


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_all_events_read_the_events_table_for_observations_once(spark):
    t = Tables(spark, FOLDER)
    assert "user_id" not in plan_of(registered.all_events(t))


@pytest.mark.parametrize("name", ["reviewed_events", "pending_price_events", "review_audit", "event_digest",
                                  "import_deltas", "property_history_report", "event_evidence_report"])
def test_events_are_not_worked_out_again_for_each_reader(spark, name):
    # A transition's fold ends in windows over misses; none is left once events are written down.
    assert "__reached" not in plan_of(registry.QUERIES[name](spark, FOLDER))


def test_versions_are_put_from_written_rows(spark, monkeypatch):
    plans = []
    put = reprocess.Versions.put
    monkeypatch.setattr(reprocess.Versions, "put", lambda self, version, rows, keys, *more: (
        plans.append(plan_of(rows) + plan_of(keys)), put(self, version, rows, keys, *more))[1])
    registry.QUERIES["current_events"](spark, FOLDER)
    assert len(plans) == 3 and not any("Window" in p or "user_id" in p for p in plans)


def test_evidence_is_not_joined_to_its_own_events(spark):
    some = registered.kept_events(Tables(spark, FOLDER)).withColumns(
        {"dataset_id": F.lit(1), "property_id": F.col("listing_id") % 20})
    assert " Join " not in plan_of(report_types.event_evidence(some))


def test_a_task_gets_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(scans, "ROWS_PER_TASK", 50)
    rows = spark.range(3000).select((F.col("id") % 300).alias("k"), "id")
    out = scans.by_key(rows, ["k"], ["id"], lambda part, segment: scans.running(
        part, ["k"], ["id"], [scans.Scan("n", "sum", F.lit(1))], segment=segment))
    sizes = [r.n for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert out.rdd.getNumPartitions() == 60 and max(sizes) < 300
    assert out.groupBy("k").agg(F.max("n").alias("n")).filter("n = 10").count() == 300


def test_columns_nobody_supplies_are_not_sent_to_python(spark):
    seen = spark.createDataFrame([(1, "active", "v1", "Café")],
                                 "listing_id long, observation_status string, parser_version string, title string")
    seen = seen.withColumn("field_presence", presence_map({"title": F.lit(True), "amenities": F.lit(True)}))
    lean = build_snapshots(seen)
    full = build_snapshots(seen.withColumns({
        c: F.lit(None).cast(k) for c, k in VALUE_COLUMNS.items() if c != "title"})).select(*lean.columns)
    assert lean.collect() == full.collect() and lean.first().title == "Café" and lean.first().amenities == []
    calls = lambda df: sum(plan_of(df).count(f"{n}(")
                           for n in ("_compose_members", "_normalize_rest"))
    assert calls(lean) == 0
