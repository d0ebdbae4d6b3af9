"""CSV observation files: scan, header contract, row numbers, file checksums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.constants import CSV_COLUMNS, CSV_PARSER_VERSION, REQUIRED_CSV_COLUMNS
from tidewatch.functions.text import strip

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in CSV_COLUMNS])


def file_shapes(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, bool, list[str]]]:
    """(header line, cells run over lines, files): files that can be read alike.

    A line with an odd number of quotes belongs to such a cell.  One row per file reaches
    the driver, which lists the files anyway.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    lines = spark.read.text(list(paths)).select(
        "value", (quotes % 2 == 1).alias("odd"), F.col("_metadata.file_path").alias("file"),
        F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("place"))
    shapes: dict[tuple[str, bool], list[str]] = {}
    for row in lines.groupBy("file").agg(
            F.min_by("value", "place").alias("header"), F.max("odd").alias("odd")).collect():
        shapes.setdefault((row.header, row.odd), []).append(row.file)
    return [(header, odd, sorted(files)) for (header, odd), files in sorted(shapes.items())]


def read_csv(spark: SparkSession, path: str | Sequence[str],
             multiline: bool | None = None) -> DataFrame:
    """All cells as trimmed text, header keyed, with file and 1-based row number.

    Every file is keyed by its own header; columns a file lacks are NULL.  Only files with
    cells that run over lines are read whole, all others are split across tasks, unless
    ``multiline`` settles it for all.
    """
    paths = [path] if isinstance(path, str) else list(path)
    tables = [_read_alike(spark, files, odd if multiline is None else multiline)
              for _, odd, files in file_shapes(spark, paths)]
    if not tables:
        assert_required_headers([])
    table = tables[0]
    for more in tables[1:]:
        table = table.unionByName(more, allowMissingColumns=True)
    return number_rows(table)


def _read_alike(spark: SparkSession, paths: list[str], multiline: bool) -> DataFrame:
    reader = (
        spark.read.option("header", True).option("multiLine", multiline).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        .option("mode", "PERMISSIVE").option("inferSchema", False).option("enforceSchema", False)
    )
    header = reader.csv(paths).columns
    names = [h.lstrip("﻿").strip() for h in header]
    assert_required_headers(names)
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header])
    scanned = reader.schema(schema).csv(paths)
    return scanned.select(
        *[strip(F.col(f"`{h}`")).alias(n) for h, n in zip(header, names)],
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__id"),
    )


def number_rows(table: DataFrame) -> DataFrame:
    """Consecutive row numbers per file, from per-block counts (one row per scan split)."""
    blocks = table.groupBy("file_path", "__block").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = Window.partitionBy("file_path").orderBy("__block").rowsBetween(
        Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return (
        table.join(blocks.drop("__n"), ["file_path", "__block"])
        .withColumn("row_number", F.col("__id") - F.col("__first") + F.col("__before") + 1)
        .drop("__id", "__block", "__first", "__before")
    )


def assert_required_headers(names: Sequence[str]) -> None:
    present = {n.strip() for n in names}
    missing = [c for c in REQUIRED_CSV_COLUMNS if c not in present]
    if missing:
        raise ValueError(f"missing required CSV header(s): {', '.join(missing)}")


def assert_has_rows(table: DataFrame) -> None:
    """A file without data rows carries no header keys and fails the same check."""
    if table.isEmpty():
        assert_required_headers([])


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of each file's bytes, for import idempotency."""
    return spark.read.format("binaryFile").load(path).select(
        F.col("path"), F.sha2(F.col("content"), 256).alias("file_checksum"))


def new_files(checksums: DataFrame, import_log: DataFrame, org: str, dataset: str,
              source: str) -> DataFrame:
    """Files not imported before into this (organisation, dataset, source)."""
    scope = import_log.filter(
        (F.col("organization_id") == org) & (F.col("dataset_id") == dataset)
        & (F.col("source_id") == source) & F.col("file_checksum").isNotNull())
    return checksums.dropDuplicates(["file_checksum"]).join(
        scope.select("file_checksum"), "file_checksum", "left_anti")


def payload_checksum(table: DataFrame) -> DataFrame:
    """Add the sha256 of the whole row, used to drop repeated raw evidence."""
    return table.withColumn("payload_checksum", F.sha2(F.to_json(F.struct(*table.columns)), 256))


def raw_observations(rows: DataFrame, run_id: str, method: str = "manual_import") -> DataFrame:
    """Accepted rows as raw evidence, unique per (run, source, listing, checksum)."""
    payload = [c for c in rows.columns if c not in ("row_number", "file_path")]
    return (
        rows.withColumn("payload_checksum", F.sha2(F.to_json(F.struct(*payload)), 256))
        .select(F.lit(run_id).alias("run_id"), "source_key", "external_id", "observed_at",
                "observation_status", "payload_checksum",
                F.to_json(F.struct(F.lit(method).alias("method"))).alias("request_metadata"))
        .dropDuplicates(["run_id", "source_key", "external_id", "payload_checksum"])
    )


def csv_observations(table: DataFrame, source_key: str, requested_at: str) -> DataFrame:
    """Manual CSV adapter: raw observation envelope of every row."""
    payload = [c for c in table.columns if c not in ("row_number", "file_path")]

    def cell(name: str, default):
        return F.coalesce(F.col(name), default) if name in table.columns else default

    return table.select(
        F.lit(source_key).alias("source_key"), cell("external_id", F.lit("")).alias("external_id"),
        cell("observed_at", F.lit(requested_at)).alias("observed_at"),
        cell("observation_status", F.lit("unknown")).alias("observation_status"),
        F.nullif(cell("source_url", F.lit("")), F.lit("")).alias("source_url"),
        F.to_json(F.struct(*payload)).alias("payload"),
        F.struct(F.lit("manual_csv").alias("method")).alias("evidence"),
        F.lit(CSV_PARSER_VERSION).alias("parser_version"),
        F.concat_ws(":", F.lit(source_key), cell("external_id", F.lit("")))
        .alias("content_fingerprint"),
    )
