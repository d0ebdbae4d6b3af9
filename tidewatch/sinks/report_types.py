"""The standard reports: snapshot summary, region change, property history, event evidence.

Each is a DataFrame with one row per line and a ``dataset_id``.  ``write_reports`` writes any
number of them for all datasets in one job, each in order and in as many files as it needs, and
notes every report with its parameters in a manifest that never changes an entry.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.csvcells import csv_line
from tidewatch.operators.scans import Scan, by_key, micros, running
from tidewatch.sinks.keyed import KeyedTable
from tidewatch.sinks.reports import csv_header

BUNDLE = 50  # events in one line of the evidence report
DAY_MICROS = 86_400_000_000.0


def snapshot_summary(snapshots: DataFrame) -> DataFrame:
    """Per run: listings by how they were observed, priced ones, and the span of time."""
    status = F.col("observation_status")
    failed = status.isin("source_error", "blocked")
    return snapshots.groupBy("dataset_id", "run_id").agg(
        F.count(F.lit(1)).alias("snapshots"), F.count_if(status == "active").alias("active"),
        F.count_if(status == "not_found").alias("not_found"), F.count_if(failed).alias("failed"),
        F.count_if(F.col("price_amount").isNotNull()).alias("priced"),
        F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"))


def region_change(snapshots: DataFrame, region: str = "region") -> DataFrame:
    """Active listings per region and day without gaps, and the change to the day before.

    Days run from the dataset's first to its last for all of its regions.  A day on which a
    region was not observed carries the last count forward (0 before the first) and is marked.
    """
    seen = snapshots.select(
        "dataset_id", F.col(region).alias("region"), F.to_date("observed_at").alias("day"), "listing_id",
        (F.col("observation_status") == "active").cast("long").alias("active"))
    # A listing counts once a day; both steps combine map-side.
    daily = seen.groupBy("dataset_id", "region", "day", "listing_id").agg(F.max("active").alias("active")).groupBy(
        "dataset_id", "region", "day").agg(F.sum("active").alias("active"))
    regions = daily.select("dataset_id", "region").distinct()
    span = daily.groupBy("dataset_id").agg(F.min("day").alias("low"), F.max("day").alias("high"))
    days = regions.join(span, "dataset_id").select(
        "dataset_id", "region", F.explode(F.sequence("low", "high")).alias("day"))
    keyed = daily.withColumnsRenamed({c: f"__{c}" for c in daily.columns})
    filled = days.join(keyed, (days["dataset_id"] == keyed["__dataset_id"]) & days["region"].eqNullSafe(
        keyed["__region"]) & (days["day"] == keyed["__day"]), "left")
    # One row per day: a window holds as many rows as there are days.
    along = Window.partitionBy("dataset_id", "region").orderBy("day")
    active = F.coalesce(F.last("__active", ignorenulls=True).over(along), F.lit(0))
    return filled.select(
        "dataset_id", "region", "day", F.col("__active").isNotNull().alias("observed"), active.alias("active_listings")
    ).withColumn("change", F.col("active_listings") - F.lag("active_listings").over(along))


def property_history(events: DataFrame) -> DataFrame:
    """The events of every property in order: number, what came before and how many days ago."""
    return _numbered(events)


def _numbered(events: DataFrame, *more: str) -> DataFrame:
    """``property_history`` with further columns of the events."""
    order = ["__at", "event_id"]
    columns = ["dataset_id", "property_id", "event_id", "event_type", "event_at", "listing_id", "summary"]

    def body(part: DataFrame, segment: str | None) -> DataFrame:
        return running(part, ["dataset_id", "property_id"], order, [
            Scan("number", "sum", F.lit(1).cast("long")),
            Scan("previous_type", "last", F.col("event_type"), before=True),
            Scan("__before", "last", F.col("__at"), before=True),
        ], segment=segment)

    numbered = by_key(events.select(*columns, *more).withColumn("__at", micros("event_at")),
                      ["dataset_id", "property_id"], order, body)
    return numbered.withColumn("days_since", F.floor((F.col("__at") - F.col("__before")) / DAY_MICROS)).drop(
        "__at", "__before")


def event_evidence(events: DataFrame, bundle: int = BUNDLE) -> DataFrame:
    """Evidence of a property's events, at most ``bundle`` events a line, however many it has.

    An event has one evidence row, made from its own columns, so these go along instead of being joined.
    """
    numbered = _numbered(events, "evidence_type", "current_snapshot_id").withColumn(
        "line", F.floor((F.col("number") - 1) / bundle))
    entry = F.struct("number", F.concat_ws(
        " | ", F.date_format("event_at", "yyyy-MM-dd HH:mm:ss"), "event_type", "evidence_type",
        F.col("current_snapshot_id").cast("string"), "summary").alias("text"))
    return numbered.groupBy("dataset_id", "property_id", "line").agg(
        F.count(F.lit(1)).alias("events"), F.min("event_at").alias("first_at"), F.max("event_at").alias("last_at"),
        F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["text"]), "\n").alias("evidence"))


# How the lines of a report are ordered, as text that sorts alike.
def _padded(name: str) -> Column:
    return F.lpad(F.col(name).cast("string"), 20, "0")


ORDERS = {
    "snapshot_summary": lambda: F.col("run_id").cast("string"),
    "region_change": lambda: F.concat_ws("\u0001", "region", F.col("day").cast("string")),
    "property_history": lambda: F.concat_ws("\u0001", F.col("property_id").cast("string"), _padded("number")),
    "event_evidence": lambda: F.concat_ws("\u0001", F.col("property_id").cast("string"), _padded("line")),
}


def write_reports(path: str, reports: Mapping[str, DataFrame], parameters: Mapping[str, dict] | None = None
                  ) -> DataFrame:
    """Write reports (kind to DataFrame) of all datasets under ``path``; returns their manifest rows.

    One job writes all lines, ranged by report, dataset and order, so a large report is many
    files and many small ones share tasks.  A report with known parameters keeps its first entry.
    """
    some = next(iter(reports.values()))
    spark = some.sparkSession
    lines = None
    for kind, df in reports.items():
        columns = [c for c in df.columns if c != "dataset_id"]
        part = df.select(F.lit(kind).alias("report"), F.col("dataset_id").cast("string"),
                         ORDERS[kind]().alias("order"), csv_line(*columns).alias("value"))
        lines = part if lines is None else lines.unionByName(part)
    batch = uuid.uuid4().hex
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(tasks, "report", "dataset_id", "order").sortWithinPartitions(
        "report", "dataset_id", "order").select("report", "dataset_id", "value").write.partitionBy(
        "report", "dataset_id").option("lineSep", "\r\n").text(f"{path}/data/{batch}")
    facts = spark.createDataFrame(
        [(kind, json.dumps((parameters or {}).get(kind, {}), sort_keys=True),
          csv_header([c for c in df.columns if c != "dataset_id"])) for kind, df in reports.items()],
        "report string, parameters string, header string")
    # A cell may hold line ends, but never a carriage return before them outside quotes.
    written = spark.read.option("lineSep", "\r\n").schema("value string, report string, dataset_id string").text(
        f"{path}/data/{batch}").groupBy("report", "dataset_id").agg(F.count(F.lit(1)).alias("lines"))
    entries = written.join(F.broadcast(facts), "report").withColumns({
        "batch": F.lit(batch), "report_id": F.sha2(F.concat_ws("\u0001", "report", "dataset_id", "parameters"), 256)})
    manifest = KeyedTable(spark, f"{path}/manifest", ["report_id"], buckets=4)
    manifest.append(entries)
    return manifest.rows_for(entries)
