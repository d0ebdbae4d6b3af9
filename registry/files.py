"""Operators on files and envelopes: the given tables go out as files and come back."""

import uuid

from pyspark.sql import functions as F

from registry import query
from registry.imports import RAW_SQL, raw_rows
from registry.tables import VALUES_SQL
from registry.markets import _UNIQUE_SQL, _unique
from registry.snapshots import _DIFF_COLUMNS, _diff_view, _diffs, diff_sql
from tidewatch.operators import diffs, market, snapshots, validation
from tidewatch.session import checkpoint_dir
from tidewatch.sinks import reports
from tidewatch.sources import csv_files, fixtures

_CELLS = ["source_key", "external_id", "source_url", "title", "observed_at", "observation_status", "region"]


def _folder(t) -> str:
    return f"{checkpoint_dir(t.spark).rstrip('/')}/files-{uuid.uuid4().hex}"


@query("csv_observations", f"""WITH {RAW_SQL}
SELECT source_key, trim(external_id) AS external_id, observed_at, observation_status, nullif(source_url, '') AS source_url,
  'csv-adapter:v1' AS parser_version, source_key || ':' || trim(external_id) AS content_fingerprint, region
FROM raw""")
def csv_observations(t):
    """Even and odd orders as two sets of CSV files with other columns in another order."""
    folder, rows = _folder(t), raw_rows(t)
    even = (F.col("row_number") - 1) % 2 == 0
    rows.filter(even).select(*_CELLS).write.csv(f"{folder}/a", header=True, emptyValue="")
    rows.filter(~even).select(*reversed(_CELLS), "rating").write.csv(
        f"{folder}/b", header=True, emptyValue="")
    table = csv_files.read_csv(t.spark, [f"{folder}/a", f"{folder}/b"])
    # The adapter takes one source; the column of the files names it here.
    seen = csv_files.csv_observations(table, "market", "2025-03-03T00:00:00Z")
    cells = F.from_json("payload", "source_key string, region string")
    return seen.withColumn("cells", cells).select(
        F.col("cells.source_key").alias("source_key"), "external_id", "observed_at",
        "observation_status", "source_url", "parser_version",
        F.concat_ws(":", F.col("cells.source_key"), F.split("content_fingerprint", ":")[1]).alias("content_fingerprint"),
        F.col("cells.region").alias("region"))


@query("csv_export_lines", f"""WITH {RAW_SQL}
SELECT concat_ws(',', source_key, external_id, title, rating) AS line FROM raw
UNION ALL SELECT 'source_key,external_id,title,rating'""")
def csv_export_lines(t):
    """An export written as part files: one header, then every row, escaped."""
    folder = _folder(t)
    reports.write_csv(raw_rows(t).select("source_key", "external_id", "title", "rating"), folder)
    return t.spark.read.option("lineSep", "\r\n").text(folder).select(F.col("value").alias("line"))


@query("diff_list", "WITH " + diff_sql(False) + f"""SELECT * FROM ({_DIFF_COLUMNS})
WHERE snapshot_id = (SELECT min(snapshot_id) FROM ({_DIFF_COLUMNS}))""")
def diff_list(t):
    found = _diffs(t)
    first = found.agg(F.min("snapshot_id")).first()[0]
    return _diff_view(diffs.diff_list(found, first))


@query("market_snapshot_rows", f"""WITH {_UNIQUE_SQL}
SELECT 's1' AS snapshot_id, source_listing_id, title, area, rating, review_count, displayed_price, currency,
  false AS detail_collected FROM uniq""")
def market_snapshot_rows(t):
    """Deduplicated cards as stored observations, and those as rows of a market snapshot."""
    unique = _unique(t)
    missing = [c for c in ("canonical_url", "guest_capacity", "bedrooms", "latitude", "longitude")
               if c not in unique.columns]
    cards = unique.withColumns({c: F.lit(None).cast("string") for c in missing})
    stored = market.observation_rows(cards, "c1")
    listed = market.snapshot_listings(stored, F.lit("s1"))
    flags = stored.select("source_listing_id", "detail_collected")
    return listed.join(flags, "source_listing_id").select(
        "snapshot_id", "source_listing_id", "title", "area", "rating", "review_count",
        "displayed_price", "currency", "detail_collected")


@query("raw_observation_problems", f"""WITH {RAW_SQL}
SELECT row_number, concat_ws(',',
  CASE WHEN external_id = '' THEN 'external_id' END,
  CASE WHEN observed_at = 'bad-date' THEN 'observed_at' END,
  CASE WHEN observation_status = 'deleted' THEN 'observation_status' END,
  CASE WHEN source_url LIKE 'ftp%' THEN 'source_url' END) AS problems
FROM (SELECT * REPLACE (trim(external_id) AS external_id) FROM raw)""")
def raw_observation_problems(t):
    rows = raw_rows(t).withColumns({
        "external_id": F.trim("external_id"),
        "source_url": F.nullif("source_url", F.lit("")),
        "evidence": F.struct(F.lit("manual_csv").alias("method"))})
    return rows.select("row_number", F.array_join(
        validation.raw_observation_problems(), ",").alias("problems"))


@query("adapter_rows", f"""WITH {VALUES_SQL}
SELECT snapshot_id, 'region ' || (listing_id % 5) AS region, price_amount AS observed_price_amount,
  price_currency AS observed_price_currency, price_unit AS observed_price_unit FROM vals""")
def adapter_rows(t):
    """Adapter output with a price struct, in the shape of import rows."""
    seen = t.valued.select(
        "snapshot_id", F.col("region").alias("region_name"), F.struct(
            F.col("price_amount").alias("amount"), F.col("price_currency").alias("currency"),
            F.col("price_unit").alias("unit")).alias("observed_price"))
    return snapshots.import_rows_from_adapter(seen).select(
        "snapshot_id", "region", "observed_price_amount", "observed_price_currency",
        "observed_price_unit")


@query("fixture_observations", """SELECT CAST(p_partkey AS VARCHAR) AS external_id,
  CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS title,
  CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_retailprice AS VARCHAR) END AS price_amount,
  p_partkey % 3 <> 0 AS has_price, 'fixture' AS method FROM part""")
def fixture_observations(t):
    """Parts as configured listings; every third is not active and shows no values."""
    k = F.col("p_partkey")
    listings = t.read("part").select(
        k.cast("string").alias("external_id"),
        F.when(k % 3 == 0, "not_found").otherwise("active").alias("observation_status"),
        F.col("p_name").alias("title"), F.col("p_retailprice").cast("string").alias("price_amount"))
    seen = fixtures.fixture_observations(listings, "feed", "2025-03-03T00:00:00Z")
    return seen.select("external_id", "title", "price_amount",
                       F.col("field_presence")["price"].alias("has_price"),
                       F.col("evidence.method").alias("method"))
