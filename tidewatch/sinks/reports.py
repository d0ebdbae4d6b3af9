"""CSV exports and reports, safe to open in a spreadsheet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.csvcells import csv_line
from tidewatch.functions.times import iso_utc

SYNC_EXPORT_LIMIT = 10_000
PROPERTY_COLUMNS = ("id", "canonical_name", "region_id", "lifecycle_status", "property_type",
                    "last_observed_at")


class TooLarge(ValueError):
    """The result exceeds what a direct download may hold; use the batch export."""


def csv_lines(df: DataFrame) -> DataFrame:
    """Each row as one escaped CSV line, order kept."""
    return df.select(csv_line(*df.columns).alias("value"))


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Write header and rows with CRLF line ends.

    The header is the first part file, with or without rows after it, so the part files
    in order are one document.  ``single_file`` is for reports of at most
    ``SYNC_EXPORT_LIMIT`` rows; larger ones are refused and stay in many part files.
    """
    lines = csv_lines(df)
    first = df.sparkSession.range(0, 1, 1, 1).select(F.lit(csv_header(df.columns)).alias("value"))
    out = first.unionAll(lines)
    if single_file:
        if lines.limit(SYNC_EXPORT_LIMIT + 1).count() > SYNC_EXPORT_LIMIT:
            raise TooLarge(f"more than {SYNC_EXPORT_LIMIT} rows")
        out = out.coalesce(1)
    # csv() would quote by its own rules, so finished lines are written as text.
    out.write.option("lineSep", "\r\n").mode("overwrite").text(path)


def csv_header(columns: Sequence[str]) -> str:
    cells = []
    for c in columns:
        cell = f"'{c}" if c[:1] in ("=", "+", "-", "@", "\t", "\r") else c
        cells.append('"' + cell.replace('"', '""') + '"'
                     if any(ch in cell for ch in '",\n\r') else cell)
    return ",".join(cells)


def csv_document(df: DataFrame, limit: int = SYNC_EXPORT_LIMIT) -> str:
    """The whole document as text, for downloads of at most ``limit`` rows."""
    rows = csv_lines(df.limit(limit + 1)).collect()
    if len(rows) > limit:
        raise TooLarge(f"more than {limit} rows")
    return "\r\n".join([csv_header(df.columns), *[r.value for r in rows]])


def _property_columns(properties: DataFrame) -> DataFrame:
    last = F.col("last_observed_at")
    if properties.schema["last_observed_at"].dataType.typeName().startswith("timestamp"):
        last = iso_utc("last_observed_at")
    return properties.select(
        F.col("property_id").alias("id"), "canonical_name",
        F.coalesce(F.col("region_id").cast("string"), F.lit("")).alias("region_id"),
        F.coalesce("lifecycle_status", F.lit("")).alias("lifecycle_status"),
        F.coalesce("property_type", F.lit("")).alias("property_type"),
        F.coalesce(last, F.lit("")).alias("last_observed_at"))


def property_export(properties: DataFrame, dataset_id, region_id=None, status=None) -> DataFrame:
    """Batch export: live properties of a dataset by name."""
    df = properties.filter((F.col("dataset_id") == dataset_id) & F.col("archived_at").isNull())
    if region_id is not None:
        df = df.filter(F.col("region_id") == region_id)
    if status is not None:
        df = df.filter(F.col("lifecycle_status") == status)
    return _property_columns(df).orderBy("canonical_name", "id")


def property_download(properties: DataFrame, dataset_id, region_id=None, status=None) -> str:
    """Direct download, archived properties included, newest first; at most 10 000 rows."""
    df = properties.filter(F.col("dataset_id") == dataset_id)
    if region_id is not None:
        df = df.filter(F.col("region_id") == region_id)
    if status is not None:
        df = df.filter(F.col("lifecycle_status") == status)
    return csv_document(_property_columns(
        df.orderBy(F.desc_nulls_last("last_observed_at"), F.desc("property_id"))))


def watchlist_summary(items: DataFrame, properties: DataFrame, watchlist_id) -> DataFrame:
    listed = items.filter(F.col("watchlist_id") == watchlist_id).select("property_id")
    return listed.join(properties, "property_id").select(
        F.col("property_id").alias("id"), "canonical_name",
        F.coalesce("lifecycle_status", F.lit("")).alias("lifecycle_status"),
        "last_observed_at").orderBy("canonical_name", "id")


def _cut(df: DataFrame, limit: int | None) -> DataFrame:
    """All rows, or the first ``limit`` with the full count beside them."""
    if limit is None:
        return df
    return df.limit(limit).withColumn("total_rows", F.lit(df.count()).cast("bigint"))


def event_digest(events: DataFrame, dataset_id, limit: int | None = None) -> DataFrame:
    """The events that were not dismissed, newest first."""
    return _cut(events.filter(
        (F.col("dataset_id") == dataset_id) & F.col("dismissed_at").isNull()
    ).select("event_type", "title", "event_at", "confidence", "event_id").orderBy(
        F.desc("event_at"), F.desc("event_id")), limit).drop("event_id")


def rejection_report(rejections: DataFrame, limit: int | None = None) -> DataFrame:
    return _cut(rejections.select("row_number", "position", "code", "message").orderBy(
        "row_number", "position"), limit).drop("position")


def output_record(spark: SparkSession, output_id: str, row_count: int,
                  failure: str | None = None) -> DataFrame:
    """Manifest entry of a finished (or failed) output; it expires after seven days."""
    return spark.range(1).select(
        F.lit(output_id).alias("output_id"),
        F.lit("failed" if failure else "ready").alias("status"),
        F.lit(row_count).cast("bigint").alias("row_count"),
        F.lit(failure).cast("string").alias("failure"),
        F.current_timestamp().alias("ready_at"),
        (F.current_timestamp() + F.make_dt_interval(days=F.lit(7))).alias("expires_at"))
