"""The given tables seen as observations, properties, imports, collections.

Every view is a deterministic projection of a whole table; the SQL twin of each
stands beside it as a CTE.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import snapshots
from tidewatch.session import prepare, written

STATUS_SQL = """CASE event_type WHEN 'view' THEN 'active' WHEN 'purchase' THEN 'active'
  WHEN 'click' THEN 'unavailable' WHEN 'signup' THEN 'not_found' ELSE 'source_error' END"""

# First event of a user on a day is that listing's snapshot of that run.
OBS_SQL = f"""obs AS (
  SELECT user_id AS listing_id, event_id AS snapshot_id, strftime(ts, '%Y-%m-%d') AS run_id,
    ts AS observed_at, {STATUS_SQL} AS observation_status,
    (event_type = 'signup' AND event_id % 2 = 0) AS high,
    (day(ts) % 10 = 0) AS degraded, value
  FROM (SELECT *, row_number() OVER (
      PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS rn FROM events)
  WHERE rn = 1)"""

VALUES_SQL = OBS_SQL + """,
vals AS (
  SELECT *,
    'v' || CASE WHEN snapshot_id % 11 = 0 THEN '1' ELSE '0' END AS parser_version,
    'Villa ' || (listing_id % 50) || CASE WHEN snapshot_id % 23 = 0 THEN ' Deluxe' ELSE '' END
      || CASE WHEN listing_id % 7 = 0 THEN ' Caf' || chr(233) ELSE '' END AS title,
    3 + (snapshot_id % 20) / 10.0 AS rating,
    snapshot_id % 500 AS review_count,
    CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS price_amount,
    CASE WHEN snapshot_id % 5 = 0 THEN 'USD' ELSE 'IDR' END AS price_currency,
    CASE WHEN snapshot_id % 7 = 0 THEN 'stay' ELSE 'night' END AS price_unit,
    'h' || (snapshot_id % 9) AS host_external_id,
    CASE WHEN snapshot_id % 4 = 0 THEN NULL
      WHEN snapshot_id % 19 = 3 THEN 'https://xn--exmple-cua.com/b%20c?q=a+b'
      ELSE 'https://site' || (listing_id % 13) || '.example/stay' END AS official_website,
    (listing_id % 2 = 0) AS is_superhost,
    snapshot_id % 13 <> 0 AS p_title, snapshot_id % 3 <> 0 AS p_rating,
    snapshot_id % 6 <> 1 AS p_review_count, snapshot_id % 8 <> 3 AS p_price,
    snapshot_id % 10 <> 7 AS p_host
  FROM obs)"""

PROPERTIES_SQL = """props AS (
  SELECT p_partkey AS property_id, 1 AS dataset_id, p_name AS canonical_name, p_name AS name,
    CAST(-8.2 - (p_partkey % 100) / 250.0 AS DOUBLE) AS lat0,
    CAST(114.6 + (p_partkey % 97) / 90.0 AS DOUBLE) AS lng0,
    CASE WHEN p_partkey % 17 = 0 THEN NULL
      ELSE CAST(-8.2 - (p_partkey % 100) / 250.0 AS DOUBLE) END AS latitude,
    CASE WHEN p_partkey % 17 = 0 THEN NULL
      ELSE CAST(114.6 + (p_partkey % 97) / 90.0 AS DOUBLE) END AS longitude,
    CAST(p_partkey % 25 AS INTEGER) AS region_id,
    CASE p_partkey % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'first_miss'
      WHEN 2 THEN 'suspected_inactive' WHEN 3 THEN 'confirmed_inactive'
      ELSE 'reactivated' END AS lifecycle_status,
    p_type AS property_type, p_brand AS brand, p_size AS bedrooms, p_retailprice AS price,
    CASE WHEN p_partkey % 29 = 0 THEN NULL
      ELSE TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 211 AS INTEGER)) END
      AS last_observed_at,
    p_partkey % 31 = 0 AS archived
  FROM part)"""

LISTINGS_SQL = """listings AS (
  SELECT user_id AS listing_id, user_id % (SELECT count(*) FROM part) AS property_id,
    min(ts) AS first_seen_at, max(ts) AS last_observed_at
  FROM events GROUP BY user_id)"""

DISCOVERIES_SQL = """disc AS (
  SELECT CAST(l_partkey AS VARCHAR) AS source_listing_id, l_suppkey AS cell_id,
    l_orderkey * 10 + l_linenumber AS seq,
    CASE WHEN l_orderkey % 3 = 0 THEN 'Listing ' || l_partkey END AS title,
    CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'Area ' || (l_suppkey % 17) END AS area,
    CASE WHEN l_orderkey % 4 <> 0 THEN 3 + (l_orderkey % 20) / 10.0 END AS rating,
    CASE WHEN l_orderkey % 5 <> 0 THEN CAST(l_quantity AS BIGINT) END AS review_count,
    CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) AS displayed_price,
    CASE WHEN l_returnflag = 'A' THEN 'IDR' END AS currency
  FROM lineitem)"""


class Tables:
    """Lazy views over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder
        self._kept = False

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        raw = self.read("events")
        return raw.withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def event_keys(self) -> DataFrame:
        """Two columns that bound the rows per listing; cheap to scan."""
        return self.events.select(F.col("user_id").alias("listing_id"),
                                  F.col("ts").alias("observed_at"))

    @cached_property
    def observations(self) -> DataFrame:
        kind = F.col("event_type")
        status = F.when(kind.isin("view", "purchase"), "active").when(
            kind == "click", "unavailable").when(kind == "signup", "not_found").otherwise(
            "source_error")
        rows = self.events.select(
            F.col("user_id").alias("listing_id"), F.col("event_id").alias("snapshot_id"),
            F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("ts").alias("observed_at"),
            status.alias("observation_status"),
            ((kind == "signup") & (F.col("event_id") % 2 == 0)).alias("high_confidence_not_found"),
            (F.dayofmonth("ts") % 10 == 0).alias("run_degraded"), "value")
        return snapshots.one_per_run(rows)

    def keep_observations(self) -> None:
        """Write the observations down, for queries in which several branches read them;
        call it before views are built on them."""
        if not self._kept:
            self.observations = written(self.observations, "observations")
            self._kept = True

    @cached_property
    def valued(self) -> DataFrame:
        """Observations with field values and presence."""
        n, listing = F.col("snapshot_id"), F.col("listing_id")
        present = {
            "title": n % 13 != 0, "rating": n % 3 != 0, "review_count": n % 6 != 1,
            "price": n % 8 != 3, "host_external_id": n % 10 != 7,
            "official_website": F.lit(True), "is_superhost": F.lit(True),
        }
        return self.observations.withColumns({
            "dataset_id": F.lit(1), "source_key": F.lit("events"),
            "region": F.concat(F.lit("region "), (listing % 5).cast("string")),
            "parser_version": F.concat(F.lit("v"), F.when(n % 11 == 0, "1").otherwise("0")),
            "title": F.concat(F.lit("Villa "), (listing % 50).cast("string"),
                              F.when(n % 23 == 0, " Deluxe").otherwise(""),
                              # Decomposed: the accent is a character of its own.
                              F.when(listing % 7 == 0, " Cafe\u0301").otherwise("")),
            "rating": F.lit(3) + (n % 20) / F.lit(10.0),
            "review_count": n % 500,
            "price_amount": F.round(F.col("value") * 100).cast("bigint").cast("string"),
            "price_currency": F.when(n % 5 == 0, "USD").otherwise("IDR"),
            "price_unit": F.when(n % 7 == 0, "stay").otherwise("night"),
            "host_external_id": F.concat(F.lit("h"), (n % 9).cast("string")),
            "official_website": F.when(n % 4 == 0, None).when(
                n % 19 == 3, "https://exämple.com/b%20c/?q=a+b&utm_source=x#top").otherwise(F.concat(
                    F.lit("https://site"), (listing % 13).cast("string"), F.lit(".example/stay"))),
            "is_superhost": listing % 2 == 0,
            "field_presence": snapshots.presence_map(present),
        })

    @cached_property
    def snapshots(self) -> DataFrame:
        return snapshots.build_snapshots(self.valued)

    @cached_property
    def properties(self) -> DataFrame:
        k = F.col("p_partkey")
        lat, lng = F.lit(-8.2) - (k % 100) / F.lit(250.0), F.lit(114.6) + (k % 97) / F.lit(90.0)
        status = F.when(k % 5 == 0, "active").when(k % 5 == 1, "first_miss").when(
            k % 5 == 2, "suspected_inactive").when(k % 5 == 3, "confirmed_inactive").otherwise(
            "reactivated")
        day = F.lit("2024-01-01").cast("timestamp")
        return self.read("part").select(
            k.alias("property_id"), F.lit(1).alias("dataset_id"),
            F.col("p_name").alias("canonical_name"), F.col("p_name").alias("name"),
            F.when(k % 17 != 0, lat).alias("latitude"), F.when(k % 17 != 0, lng).alias("longitude"),
            (k % 25).cast("int").alias("region_id"), status.alias("lifecycle_status"),
            F.col("p_type").alias("property_type"), F.col("p_brand").alias("brand"),
            F.col("p_size").alias("bedrooms"), F.col("p_retailprice").alias("price"),
            F.when(k % 29 != 0, day + F.make_dt_interval(days=(k % 211).cast("int")))
            .alias("last_observed_at"),
            F.when(k % 31 == 0, day).alias("archived_at"),
        )

    @cached_property
    def listings(self) -> DataFrame:
        parts = self.read("part").count()  # from parquet metadata
        return self.events.groupBy(F.col("user_id").alias("listing_id")).agg(
            F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_observed_at")
        ).withColumn("property_id", F.col("listing_id") % parts)

    @cached_property
    def discoveries(self) -> DataFrame:
        order, line = F.col("l_orderkey"), F.col("l_linenumber")
        return self.read("lineitem").select(
            F.col("l_partkey").cast("string").alias("source_listing_id"),
            F.col("l_suppkey").alias("cell_id"), (order * 10 + line).alias("seq"),
            F.when(order % 3 == 0, F.concat(F.lit("Listing "), F.col("l_partkey").cast("string")))
            .alias("title"),
            F.when(line % 2 == 0, "").otherwise(F.concat(
                F.lit("Area "), (F.col("l_suppkey") % 17).cast("string"))).alias("area"),
            F.when(order % 4 != 0, F.lit(3) + (order % 20) / F.lit(10.0)).alias("rating"),
            F.when(order % 5 != 0, F.col("l_quantity").cast("bigint")).alias("review_count"),
            F.floor("l_extendedprice").cast("bigint").cast("string").alias("displayed_price"),
            F.when(F.col("l_returnflag") == "A", "IDR").alias("currency"),
        )


def stamp(c):
    """Timestamps leave as text with microseconds."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


STAMP_SQL = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def stamp_sql(c: str) -> str:
    return STAMP_SQL.format(c)
