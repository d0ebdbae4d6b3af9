"""CSV-shaped import rows, made from orders and customers with known defects."""

from pyspark.sql import functions as F

from registry import query
from registry.tables import stamp, stamp_sql
from tidewatch.operators import resolution, validation
from tidewatch.operators import snapshots as snaps
from tidewatch.sources import csv_files, registry as source_registry
from tidewatch.sinks import reports

APPROVED = ["market", "partner"]

# k is the order key; the defects below are the ones the validator knows.
RAW_SQL = """raw AS (
  SELECT o_orderkey + 1 AS row_number,
    CASE WHEN k % 53 = 0 THEN 'nowhere' WHEN k % 2 = 0 THEN 'market' ELSE 'partner' END AS source_key,
    CASE WHEN k % 41 = 0 THEN '  ' ELSE 'c' || o_custkey END AS external_id,
    CASE WHEN k % 47 = 0 THEN 'ftp://files.example/x' WHEN k % 3 = 0
      THEN 'HTTPS://Shop.Example:443/item/' || o_custkey || '?ref=a' ELSE '' END AS source_url,
    CASE WHEN k % 5 = 0 THEN '' ELSE ' ' || c_name || ' ' END AS title,
    CASE WHEN k % 43 = 0 THEN 'bad-date' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS observed_at,
    CASE WHEN k % 59 = 0 THEN 'deleted' WHEN o_orderstatus = 'O' THEN 'active'
      WHEN o_orderstatus = 'F' THEN 'not_found' ELSE 'unavailable' END AS observation_status,
    'nation ' || c_nationkey AS region,
    CASE WHEN k % 61 = 0 THEN '200' WHEN k % 67 = 0 THEN '-7.5' WHEN k % 4 = 0 THEN ''
      ELSE CAST(-8.1 - (k % 100) / 100.0 AS DECIMAL(6, 3)) || '' END AS latitude,
    CASE WHEN k % 61 = 0 THEN '500' WHEN k % 4 = 0 THEN '' ELSE '115.1' END AS longitude,
    CASE WHEN k % 37 = 0 THEN '7.2' WHEN k % 71 = 0 THEN 'five' ELSE '4.' || (k % 10) END AS rating,
    CASE WHEN k % 73 = 0 THEN '-1' ELSE CAST(k % 300 AS VARCHAR) END AS review_count,
    CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS observed_price_amount,
    CASE WHEN k % 31 = 0 THEN 'rupiah' WHEN k % 2 = 0 THEN 'idr' ELSE 'USD' END AS observed_price_currency,
    CASE WHEN k % 6 = 0 THEN 'week' ELSE 'night' END AS observed_price_unit,
    CASE WHEN k % 8 = 0 THEN 'many' ELSE '2.5' END AS bedrooms,
    CASE WHEN k % 9 = 0 THEN 'Yes' WHEN k % 9 = 1 THEN '0' WHEN k % 9 = 2 THEN 'maybe' ELSE '' END AS is_superhost,
    CASE WHEN k % 10 < 3 THEN 'key-' || (o_custkey % 40) ELSE '' END AS canonical_property_key
  FROM (SELECT *, o_orderkey AS k FROM orders) o JOIN customer ON o_custkey = c_custkey)"""

CHECKED_SQL = RAW_SQL + """,
checked AS (
  SELECT *, trim(external_id) AS ext, upper(observed_price_currency) AS cur,
    concat_ws(',',
      CASE WHEN source_key = 'nowhere' THEN 'unknown_source' END,
      CASE WHEN trim(external_id) = '' THEN 'missing_external_id' END,
      CASE WHEN observed_at = 'bad-date' THEN 'invalid_timestamp' END,
      CASE WHEN observation_status = 'deleted' THEN 'invalid_status' END,
      CASE WHEN rating IN ('7.2', 'five') THEN 'rating_out_of_range' END,
      CASE WHEN review_count = '-1' THEN 'negative_review_count' END,
      CASE WHEN latitude = '200' OR (latitude = '') <> (longitude = '') THEN 'invalid_coordinates' END,
      CASE WHEN longitude <> '' AND latitude NOT IN ('', '200') AND (
          CAST(latitude AS DOUBLE) > -8.0 OR CAST(latitude AS DOUBLE) < -9.2)
        THEN 'coordinates_outside_coverage' END,
      CASE WHEN observed_price_currency = 'rupiah' THEN 'unknown_currency' END,
      CASE WHEN source_url LIKE 'ftp%' THEN 'invalid_url' END) AS codes,
    concat_ws('|', source_key, external_id, source_url, trim(title), observed_at, observation_status,
      region, latitude, longitude, rating, review_count, observed_price_amount,
      observed_price_currency, observed_price_unit, bedrooms, is_superhost,
      canonical_property_key) AS signature
  FROM raw),
judged AS (
  SELECT *, first_value(CASE WHEN codes = '' THEN row_number END IGNORE NULLS) OVER w AS first_row,
    first_value(CASE WHEN codes = '' THEN signature END IGNORE NULLS) OVER w AS first_signature
  FROM checked WINDOW w AS (PARTITION BY source_key, ext ORDER BY row_number
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
outcomes AS (
  SELECT *, CASE WHEN codes <> '' THEN 'rejected' WHEN row_number = first_row THEN 'accepted'
      WHEN signature = first_signature THEN 'duplicate' ELSE 'conflict' END AS outcome
  FROM judged)"""


def raw_rows(t):
    k, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    text = lambda c: F.col(c).cast("string")
    status = F.col("o_orderstatus")
    joined = t.read("orders").join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        (k + 1).alias("row_number"),
        F.when(k % 53 == 0, "nowhere").when(k % 2 == 0, "market").otherwise("partner")
        .alias("source_key"),
        F.when(k % 41 == 0, "  ").otherwise(F.concat(F.lit("c"), cust)).alias("external_id"),
        F.when(k % 47 == 0, "ftp://files.example/x").when(k % 3 == 0, F.concat(
            F.lit("HTTPS://Shop.Example:443/item/"), cust, F.lit("?ref=a"))).otherwise("")
        .alias("source_url"),
        F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("title"),
        F.when(k % 43 == 0, "bad-date").otherwise(F.date_format(
            "o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("observed_at"),
        F.when(k % 59 == 0, "deleted").when(status == "O", "active").when(
            status == "F", "not_found").otherwise("unavailable").alias("observation_status"),
        F.concat(F.lit("nation "), text("c_nationkey")).alias("region"),
        F.when(k % 61 == 0, "200").when(k % 67 == 0, "-7.5").when(k % 4 == 0, "").otherwise(
            (F.lit(-8.1) - (k % 100) / F.lit(100.0)).cast("decimal(6,3)").cast("string"))
        .alias("latitude"),
        F.when(k % 61 == 0, "500").when(k % 4 == 0, "").otherwise("115.1").alias("longitude"),
        F.when(k % 37 == 0, "7.2").when(k % 71 == 0, "five").otherwise(
            F.concat(F.lit("4."), (k % 10).cast("string"))).alias("rating"),
        F.when(k % 73 == 0, "-1").otherwise((k % 300).cast("string")).alias("review_count"),
        F.floor("o_totalprice").cast("bigint").cast("string").alias("observed_price_amount"),
        F.when(k % 31 == 0, "rupiah").when(k % 2 == 0, "idr").otherwise("USD")
        .alias("observed_price_currency"),
        F.when(k % 6 == 0, "week").otherwise("night").alias("observed_price_unit"),
        F.when(k % 8 == 0, "many").otherwise("2.5").alias("bedrooms"),
        F.when(k % 9 == 0, "Yes").when(k % 9 == 1, "0").when(k % 9 == 2, "maybe").otherwise("")
        .alias("is_superhost"),
        F.when(k % 10 < 3, F.concat(F.lit("key-"), (F.col("o_custkey") % 40).cast("string")))
        .otherwise("").alias("canonical_property_key"),
    )


def classified(t):
    raw = raw_rows(t)
    cells = [c for c in raw.columns if c != "row_number"]
    # Cells arrive trimmed, as the CSV scan delivers them.
    trimmed = raw.withColumn("title", F.trim("title"))
    checked = validation.validate_rows(trimmed, APPROVED)
    return validation.classify_rows(checked, cells)


def accepted(t):
    return validation.accepted_rows(classified(t))


@query("import_outcomes", f"""WITH {CHECKED_SQL}
SELECT row_number, outcome, CASE outcome WHEN 'conflict' THEN 'duplicate_conflict' ELSE codes END
  AS codes FROM outcomes""")
def import_outcomes(t):
    codes = F.array_join(F.transform("rejections", lambda r: r["code"]), ",")
    return classified(t).select("row_number", "outcome", codes.alias("codes"))


@query("import_rejections", f"""WITH {CHECKED_SQL}, opened AS (
  SELECT row_number, observed_at, ext, source_key, unnest(string_split(
    CASE outcome WHEN 'conflict' THEN 'duplicate_conflict' ELSE codes END, ',')) AS code
  FROM outcomes WHERE codes <> '' OR outcome = 'conflict')
SELECT row_number, code, CASE code
    WHEN 'unknown_source' THEN 'unknown or unapproved source "nowhere"'
    WHEN 'missing_external_id' THEN 'external_id is required'
    WHEN 'invalid_timestamp' THEN 'invalid observed_at "bad-date"'
    WHEN 'invalid_status' THEN 'invalid observation_status "deleted"'
    WHEN 'rating_out_of_range' THEN 'rating must be within 0..5'
    WHEN 'negative_review_count' THEN 'review_count must be >= 0'
    WHEN 'invalid_coordinates' THEN 'latitude/longitude are not valid coordinates'
    WHEN 'coordinates_outside_coverage' THEN 'coordinates fall outside the configured coverage'
    WHEN 'unknown_currency' THEN 'invalid currency "RUPIAH"'
    WHEN 'invalid_url' THEN 'invalid URL in source_url'
    ELSE 'conflicting duplicate for (' || source_key || ', ' || ext || ')' END AS message FROM opened""")
def import_rejections(t):
    return validation.rejection_rows(classified(t)).select("row_number", "code", "message")


_COUNTS = """count(*) AS total, count(*) FILTER (outcome = 'accepted') AS accepted,
  CAST(sum(CASE WHEN outcome = 'conflict' THEN 1 WHEN codes = '' THEN 0
    ELSE len(string_split(codes, ',')) END) AS BIGINT) AS rejected,
  count(*) FILTER (outcome = 'duplicate') AS duplicates"""


@query("import_metrics", f"""WITH {CHECKED_SQL}
SELECT {_COUNTS}, 'completed_with_errors' AS status FROM outcomes""")
def import_metrics(t):
    return validation.import_metrics(classified(t))


_ACCEPTED_SQL = """accepted AS (
  SELECT row_number, source_key, ext AS external_id,
    CASE WHEN source_url <> '' THEN replace(source_url, 'HTTPS://Shop.Example:443', 'https://shop.example') END AS source_url,
    nullif(trim(title), '') AS title, CAST(strptime(observed_at, '%Y-%m-%dT%H:%M:%SZ') AS TIMESTAMP) AS observed_at,
    observation_status, region, CAST(nullif(latitude, '') AS DOUBLE) AS latitude,
    CAST(nullif(longitude, '') AS DOUBLE) AS longitude, CAST(rating AS DOUBLE) AS rating,
    CAST(review_count AS BIGINT) AS review_count, observed_price_amount, cur AS observed_price_currency,
    observed_price_unit, TRY_CAST(bedrooms AS DOUBLE) AS bedrooms,
    CASE is_superhost WHEN 'Yes' THEN true WHEN '0' THEN false END AS is_superhost,
    nullif(canonical_property_key, '') AS canonical_property_key
  FROM outcomes WHERE outcome = 'accepted')"""


@query("import_accepted", f"""WITH {CHECKED_SQL}, {_ACCEPTED_SQL}
SELECT * REPLACE ({stamp_sql('observed_at')} AS observed_at) FROM accepted""")
def import_accepted(t):
    return accepted(t).select(
        "row_number", "source_key", "external_id", "source_url", "title",
        stamp("observed_at").alias("observed_at"), "observation_status", "region", "latitude",
        "longitude", "rating", "review_count", "observed_price_amount", "observed_price_currency",
        "observed_price_unit", "bedrooms", "is_superhost", "canonical_property_key")


@query("import_presence", f"""WITH {CHECKED_SQL}, {_ACCEPTED_SQL}
SELECT row_number, title IS NOT NULL AS title, latitude IS NOT NULL AS location, true AS price,
  bedrooms IS NOT NULL AS bedrooms, is_superhost IS NOT NULL AS is_superhost,
  CASE observed_price_unit WHEN 'week' THEN 'unknown' ELSE observed_price_unit END AS price_unit
FROM accepted""")
def import_presence(t):
    seen = snaps.observations_from_import(accepted(t))
    flag = lambda n: F.col("field_presence")[n].alias(n)
    return seen.select("row_number", flag("title"), flag("location"), flag("price"),
                       flag("bedrooms"), flag("is_superhost"), "price_unit")


@query("raw_evidence", f"""WITH {CHECKED_SQL}, {_ACCEPTED_SQL}
SELECT source_key, external_id, {stamp_sql('observed_at')} AS observed_at, observation_status,
  '{{"method":"manual_import"}}' AS request_metadata FROM accepted""")
def raw_evidence(t):
    return csv_files.raw_observations(accepted(t), "run-1").select(
        "source_key", "external_id", stamp("observed_at").alias("observed_at"),
        "observation_status", "request_metadata")


@query("listing_resolution", f"""WITH {CHECKED_SQL}, {_ACCEPTED_SQL}
SELECT sha256(concat_ws(chr(1), 'd1', source_key, external_id)) AS listing_id, external_id,
  row_number FROM accepted WHERE CAST(substr(external_id, 2) AS BIGINT) % 3 <> 0""")
def listing_resolution(t):
    """Listings not known yet; every third customer's listing is."""
    keyed = resolution.listing_keys(accepted(t), "d1")
    known = resolution.listing_keys(
        t.read("customer").filter("c_custkey % 3 = 0").select(
            F.explode(F.array(*[F.lit(s) for s in APPROVED])).alias("source_key"),
            F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("external_id")), "d1")
    return resolution.new_listings(keyed, known).select("listing_id", "external_id", "row_number")


@query("property_resolution", f"""WITH {CHECKED_SQL}, {_ACCEPTED_SQL},
keyed AS (SELECT *, sha256(concat_ws(chr(1), 'd1', source_key, external_id)) AS listing_id FROM accepted)
SELECT listing_id, CASE
    WHEN CAST(substr(canonical_property_key, 5) AS BIGINT) % 2 = 0 THEN 'known-' || canonical_property_key
    WHEN canonical_property_key IS NOT NULL THEN sha256(concat_ws(chr(1), 'key', 'd1', canonical_property_key))
    ELSE sha256(concat_ws(chr(1), 'listing', listing_id)) END AS property_id,
  coalesce(CAST(substr(canonical_property_key, 5) AS BIGINT) % 2 <> 0, true) AS is_new_property
FROM keyed""")
def property_resolution(t):
    return _resolved(t).select("listing_id", "property_id", "is_new_property")


def _resolved(t):
    aliases = t.read("customer").select((F.col("c_custkey") % 40).alias("n")).distinct().filter(
        "n % 2 = 0").select(
        F.lit("d1").alias("dataset_id"),
        F.concat(F.lit("key-"), F.col("n").cast("string")).alias("alias"),
        F.concat(F.lit("known-key-"), F.col("n").cast("string")).alias("property_id"))
    listings = resolution.first_rows(resolution.listing_keys(accepted(t), "d1"))
    return resolution.resolve_properties(listings, aliases)


@query("new_properties", f"""WITH {CHECKED_SQL}, {_ACCEPTED_SQL},
keyed AS (SELECT *, sha256(concat_ws(chr(1), 'd1', source_key, external_id)) AS listing_id FROM accepted),
owned AS (SELECT *, CASE
    WHEN canonical_property_key IS NOT NULL THEN sha256(concat_ws(chr(1), 'key', 'd1', canonical_property_key))
    ELSE sha256(concat_ws(chr(1), 'listing', listing_id)) END AS property_id FROM keyed
  WHERE coalesce(CAST(substr(canonical_property_key, 5) AS BIGINT) % 2 <> 0, true))
SELECT property_id, coalesce(title, 'Listing ' || external_id) AS canonical_name,
  canonical_property_key, {stamp_sql('observed_at')} AS first_observed_at FROM (
    SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY observed_at, listing_id) AS k
    FROM owned) WHERE k = 1""")
def new_properties(t):
    return resolution.new_properties(_resolved(t)).select(
        "property_id", "canonical_name", "canonical_property_key",
        stamp("first_observed_at").alias("first_observed_at"))


# --- sources -----------------------------------------------------------------

SOURCES_SQL = """sources AS (
  SELECT c_custkey AS id, 'source-' || c_custkey AS key, c_name AS display_name,
    CASE c_custkey % 4 WHEN 0 THEN 'manual_import' WHEN 1 THEN 'licensed_api'
      WHEN 2 THEN 'browser_automation' ELSE 'demo_fixture' END AS access_mode,
    CASE WHEN c_custkey % 5 = 0 THEN 'pending_review' ELSE 'approved' END AS compliance_status,
    c_custkey % 3 <> 0 AS automation_allowed,
    CASE WHEN c_custkey % 7 = 0 THEN TIMESTAMP '1997-01-01' END AS review_expires_at,
    c_custkey % 6 AS missing
  FROM customer)"""


def _sources(t):
    k = F.col("c_custkey")
    mode = F.when(k % 4 == 0, "manual_import").when(k % 4 == 1, "licensed_api").when(
        k % 4 == 2, "browser_automation").otherwise("demo_fixture")
    caps = F.when(k % 6 == 0, F.array(F.lit("title"))).otherwise(
        F.array(F.lit("title"), F.lit("price"), F.lit("rating")))
    return t.read("customer").select(
        k.alias("id"), F.concat(F.lit("source-"), k.cast("string")).alias("key"),
        F.col("c_name").alias("display_name"), mode.alias("access_mode"),
        F.when(k % 5 == 0, "pending_review").otherwise("approved").alias("compliance_status"),
        (k % 3 != 0).alias("automation_allowed"), caps.alias("capabilities"),
        F.when(k % 7 == 0, "1997-01-01T00:00:00Z").alias("review_expires_at"))


@query("import_sources", f"""WITH {SOURCES_SQL}
SELECT id, key, display_name, access_mode FROM sources
WHERE compliance_status = 'approved' AND access_mode IN ('manual_import', 'demo_fixture', 'owner_supplied')""")
def import_sources(t):
    return source_registry.import_sources(_sources(t))


@query("source_catalogue", f"""WITH {SOURCES_SQL}
SELECT id, key, access_mode, compliance_status, automation_allowed FROM sources""")
def source_catalogue(t):
    return source_registry.source_catalogue(_sources(t)).select(
        "id", "key", "access_mode", "compliance_status", "automation_allowed")


@query("browser_sources", f"""WITH {SOURCES_SQL}
SELECT id, key, display_name, compliance_status FROM sources WHERE access_mode = 'browser_automation'""")
def browser_sources(t):
    return source_registry.browser_sources(_sources(t))


@query("gated_runs", f"""WITH {SOURCES_SQL}
SELECT o_orderkey AS run_id, CASE
    WHEN compliance_status <> 'approved' THEN 'not_approved'
    WHEN o_orderkey % 2 = 0 AND NOT automation_allowed THEN 'automation_not_allowed'
    WHEN review_expires_at < o_orderdate THEN 'review_expired'
    WHEN missing = 0 AND o_orderkey % 4 <> 0 THEN 'capability_not_declared' END AS refusal
FROM orders JOIN sources ON id = o_custkey""")
def gated_runs(t):
    key = F.col("o_orderkey")
    runs = t.read("orders").select(
        key.alias("run_id"), F.col("o_custkey").alias("source_id"), (key % 2 == 0).alias("automated"),
        F.when(key % 4 == 0, F.array(F.lit("title"))).otherwise(
            F.array(F.lit("title"), F.lit("price"))).alias("requested_capabilities"),
        F.col("o_orderdate").cast("timestamp").alias("at"))
    return source_registry.gated_runs(runs, _sources(t), F.col("at")).select("run_id", "refusal")


@query("due_schedules", f"""WITH {SOURCES_SQL}
SELECT o_orderkey AS schedule_id FROM orders JOIN sources ON id = o_custkey
WHERE o_orderkey % 10 <> 0 AND compliance_status = 'approved' AND automation_allowed
  AND (o_orderkey % 9 = 0 OR o_orderdate < TIMESTAMP '1998-06-01' - to_minutes(CAST((o_orderkey % 50 + 1) * 1440 AS INTEGER)))""")
def due_schedules(t):
    key = F.col("o_orderkey")
    schedules = t.read("orders").select(
        key.alias("schedule_id"), F.col("o_custkey").alias("source_id"),
        (key % 10 != 0).alias("enabled"), ((key % 50 + 1) * 1440).cast("int").alias("cadence_minutes"),
        F.when(key % 9 != 0, F.col("o_orderdate").cast("timestamp")).alias("last_enqueued_at"))
    return source_registry.due_schedules(
        schedules, _sources(t), F.lit("1998-06-01").cast("timestamp")).select("schedule_id")


@query("rejection_report", f"""WITH {CHECKED_SQL}, opened AS (
  SELECT row_number, unnest(string_split(
    CASE outcome WHEN 'conflict' THEN 'duplicate_conflict' ELSE codes END, ',')) AS code,
    generate_subscripts(string_split(CASE outcome WHEN 'conflict' THEN 'duplicate_conflict' ELSE codes END, ','), 1) AS pos
  FROM outcomes WHERE codes <> '' OR outcome = 'conflict')
SELECT row_number || ',' || code AS value FROM opened""")
def rejection_report(t):
    rows = validation.rejection_rows(classified(t))
    return reports.csv_lines(reports.rejection_report(rows).select("row_number", "code"))


@query("constraint_report", """SELECT 'rating_range' AS constraint_name,
  count(*) FILTER (NOT (o_totalprice / 100000 BETWEEN 0 AND 5)) AS violations FROM orders
UNION ALL SELECT 'review_count_not_negative', count(*) FILTER (o_custkey % 100 - 1 < 0) FROM orders
UNION ALL SELECT 'one_target', count(*) FILTER (o_orderkey % 3 <> 1) FROM orders""")
def constraint_report(t):
    key = F.col("o_orderkey")
    rows = t.read("orders").select(
        (F.col("o_totalprice") / 100000).alias("rating"),
        (F.col("o_custkey") % 100 - 1).alias("review_count"),
        F.when(key % 3 != 0, key).alias("property_id"), F.when(key % 3 == 2, key).alias("listing_id"))
    checks = validation.observation_constraints()
    checks["one_target"] = validation.exactly_one("property_id", "listing_id")
    return validation.constraint_report(rows, checks)


@query("money_problems", """SELECT o_orderkey AS id, concat_ws(',',
  CASE WHEN o_orderkey % 7 = 0 THEN 'amount' END, CASE WHEN o_orderkey % 5 = 0 THEN 'currency' END,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'unit' END) AS problems FROM orders""")
def money_problems(t):
    key = F.col("o_orderkey")
    amount = F.when(key % 7 == 0, "1,5").otherwise(F.col("o_totalprice").cast("decimal(14,2)").cast("string"))
    currency = F.when(key % 5 == 0, "RP").otherwise("IDR")
    unit = F.when(F.col("o_orderpriority") == "1-URGENT", "week").otherwise("night")
    return t.read("orders").select(key.alias("id"), F.array_join(
        validation.money_problems(amount, currency, unit), ",").alias("problems"))
