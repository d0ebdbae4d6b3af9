"""Snapshots, predecessors, differences and events."""

import uuid

from pyspark.sql import functions as F

from registry import query
from registry.lifecycle import fold_sql, life_rows
from registry.tables import OBS_SQL, VALUES_SQL, stamp, stamp_sql
from tidewatch.config import Materiality
from tidewatch.operators import catalogue, diffs, events
from tidewatch.operators import snapshots as snaps
from tidewatch.session import checkpoint_dir, written
from tidewatch.sinks.keyed import KeyedTable

NUM_TEXT = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
RATING_TEXT = NUM_TEXT.format("rating")

BUILT_SQL = VALUES_SQL + f""",
built AS (
  SELECT *, sha256(title) AS title_hash,
    round(rating, 2) AS rating2,
    sha256(concat_ws(chr(10), 'status=' || observation_status, 'title=' || sha256(title),
      'description=', 'photos=', 'amenities=', 'property_type=', 'lat=', 'lng=',
      'rating=' || {RATING_TEXT}, 'review_count=' || review_count,
      'price=' || price_amount || '|' || price_currency || '|' || price_unit,
      'bedrooms=', 'bathrooms=', 'guest_capacity=', 'is_superhost=' || is_superhost,
      'host=' || host_external_id, 'official_website=' || coalesce(official_website, ''),
      'business_whatsapp=', 'direct_booking_url=')) AS content_fingerprint
  FROM vals)"""


@query("snapshots", f"""WITH {BUILT_SQL}
SELECT listing_id, run_id, snapshot_id, {stamp_sql('observed_at')} AS observed_at,
  observation_status, parser_version, title, rating2 AS rating, review_count, price_amount,
  price_currency, price_unit, host_external_id, official_website, is_superhost, title_hash,
  content_fingerprint,
  concat_ws(',', CASE WHEN p_host THEN 'host_external_id' END, 'is_superhost',
    'official_website', CASE WHEN p_price THEN 'price' END, CASE WHEN p_rating THEN 'rating' END,
    CASE WHEN p_review_count THEN 'review_count' END, CASE WHEN p_title THEN 'title' END) AS collected
FROM built""")
def snapshots(t):
    seen = F.array_sort(F.map_keys(F.map_filter("field_presence", lambda k, v: v)))
    return t.snapshots.select(
        "listing_id", "run_id", "snapshot_id", stamp("observed_at").alias("observed_at"),
        "observation_status", "parser_version", "title", "rating", "review_count", "price_amount",
        "price_currency", "price_unit", "host_external_id", "official_website", "is_superhost",
        "title_hash", "content_fingerprint", F.array_join(seen, ",").alias("collected"))


@query("snapshot_quality_flags", f"""WITH {VALUES_SQL}, bent AS (
  SELECT snapshot_id, CASE WHEN snapshot_id % 37 = 0 THEN 7.5 ELSE rating END AS rating,
    CASE WHEN snapshot_id % 41 = 0 THEN -1 ELSE review_count END AS review_count,
    CASE WHEN snapshot_id % 43 = 0 THEN 'Rp' ELSE price_currency END AS price_currency,
    CASE WHEN snapshot_id % 47 = 0 THEN 'ftp://x.example/a' ELSE official_website END AS site
  FROM vals)
SELECT snapshot_id, concat_ws(',', CASE WHEN site LIKE 'ftp%' THEN 'invalid_url' END,
  CASE WHEN review_count < 0 THEN 'negative_review_count' END,
  CASE WHEN rating > 5 THEN 'rating_out_of_range' END,
  CASE WHEN price_currency = 'Rp' THEN 'unknown_currency' END) AS quality_flags FROM bent""")
def snapshot_quality_flags(t):
    n = F.col("snapshot_id")
    bent = t.valued.withColumns({
        "rating": F.when(n % 37 == 0, 7.5).otherwise(F.col("rating")),
        "review_count": F.when(n % 41 == 0, -1).otherwise(F.col("review_count")),
        "price_currency": F.when(n % 43 == 0, "Rp").otherwise(F.col("price_currency")),
        "official_website": F.when(n % 47 == 0, "ftp://x.example/a").otherwise(
            F.col("official_website")),
    })
    return snaps.build_snapshots(bent).select(
        "snapshot_id", F.array_join("quality_flags", ",").alias("quality_flags"))


@query("previous_snapshots", f"""WITH {VALUES_SQL}
SELECT snapshot_id, max(CASE WHEN NOT degraded THEN struct_pack(a := epoch_us(observed_at), s := snapshot_id) END)
  OVER (PARTITION BY listing_id, parser_version ORDER BY epoch_us(observed_at)
    RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING).s AS previous_snapshot_id FROM vals""")
def previous_snapshots(t):
    return diffs.with_previous(t.snapshots, sized_by=t.event_keys).select(
        "snapshot_id", F.col("__prev.snapshot_id").alias("previous_snapshot_id"))


_FIELD_PREVIOUS = """max(CASE WHEN NOT degraded AND p_{0} THEN struct_pack(a := epoch_us(observed_at), s := snapshot_id) END)
  OVER (PARTITION BY listing_id, parser_version ORDER BY epoch_us(observed_at)
    RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING).s"""


@query("previous_snapshots_by_field", f"""WITH {VALUES_SQL}
SELECT snapshot_id, {_FIELD_PREVIOUS.format('rating')} AS previous_rating,
  {_FIELD_PREVIOUS.format('price')} AS previous_price,
  {_FIELD_PREVIOUS.format('host')} AS previous_host FROM vals""")
def previous_snapshots_by_field(t):
    paired = diffs.with_previous(t.snapshots, "field", sized_by=t.event_keys)
    return paired.select(
        "snapshot_id", F.col("__prev_rating.snapshot_id").alias("previous_rating"),
        F.col("__prev_price.snapshot_id").alias("previous_price"),
        F.col("__prev_host_external_id.snapshot_id").alias("previous_host"))


# (field, order, kind, presence, json text of the value) of the fields the tables carry.
_FIELDS = (
    ("title", 0, "hash", "p_title", "'\"' || sha256(title) || '\"'"),
    ("rating", 6, "scalar_number", "p_rating", RATING_TEXT.replace("rating", "rating2")),
    ("review_count", 7, "scalar_number", "p_review_count", "CAST(review_count AS VARCHAR)"),
    ("price", 8, "money", "p_price",
     "'{\"amount\":\"' || price_amount || '\",\"currency\":\"' || price_currency || '\",\"unit\":\"' || price_unit || '\"}'"),
    ("is_superhost", 12, "boolean", "true", "CAST(is_superhost AS VARCHAR)"),
    ("host_external_id", 13, "scalar_text", "p_host", "'\"' || host_external_id || '\"'"),
    ("official_website", 14, "scalar_text", "true", "'\"' || official_website || '\"'"),
)
_NUMBER = {"rating": "rating2", "review_count": "CAST(review_count AS DOUBLE)",
           "price": "CAST(price_amount AS DOUBLE)"}


def diff_sql(by_field: bool, price_percent: float = 0.05, rating: float = 0.05, reviews: float = 1,
             version: str = "field-diff:v1") -> str:
    """CTE ``diffs`` over the snapshots, one UNION arm per field."""
    arms = []
    for name, order, kind, present, text in _FIELDS:
        number = _NUMBER.get(name, "CAST(NULL AS DOUBLE)")
        key = "price_currency || price_unit" if kind == "money" else text
        need = f" AND {present}" if by_field else ""
        arms.append(f"""SELECT listing_id, snapshot_id, run_id, observed_at, '{name}' AS field_name,
    {order} AS field_order, '{kind}' AS field_kind, {present} AS here, {text} AS now_text,
    {key} AS now_key, {number} AS now_num,
    max(CASE WHEN NOT degraded{need} THEN struct_pack(a := epoch_us(observed_at), s := snapshot_id,
        p := {present}, t := {text}, k := {key}, n := {number}) END)
      OVER (PARTITION BY listing_id, parser_version ORDER BY epoch_us(observed_at)
        RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM built""")
    return BUILT_SQL + ",\nsides AS (" + "\nUNION ALL ".join(arms) + f"""),
changes AS (
  SELECT *, now_num - prev.n AS delta,
    CASE WHEN prev.n <> 0 THEN (now_num - prev.n) / prev.n END AS pct,
    prev.k IS NULL AS was_absent, now_key IS NULL AS is_absent
  FROM sides WHERE here AND prev.p),
diffs AS (
  SELECT *, CASE WHEN was_absent THEN 'added' WHEN is_absent THEN 'removed'
      WHEN delta > 0 THEN 'increased' WHEN delta < 0 THEN 'decreased' ELSE 'changed' END
      AS change_kind,
    CASE WHEN field_name = 'price' THEN (was_absent OR is_absent
          OR coalesce(abs(pct) + 1e-9 >= {price_percent}, false))
      WHEN field_name = 'rating' THEN coalesce(abs(delta) + 1e-9 >= {rating}, false)
      WHEN field_name = 'review_count' THEN coalesce(delta + 1e-9 >= {reviews}, false)
      ELSE true END AS is_material, '{version}' AS rule_version
  FROM changes
  WHERE CASE WHEN field_kind = 'money' THEN (was_absent <> is_absent)
        OR (NOT was_absent AND NOT is_absent AND prev.k = now_key AND delta <> 0)
      WHEN field_kind = 'scalar_number' THEN delta <> 0
      ELSE prev.k IS DISTINCT FROM now_key END)"""


_DIFF_COLUMNS = """
SELECT snapshot_id, prev.s AS previous_snapshot_id, field_name, field_kind, change_kind,
  prev.t AS previous_value, now_text AS current_value, round(delta, 6) AS absolute_delta,
  round(pct, 6) AS percent_delta, is_material, rule_version FROM diffs"""


def _diffs(t, mode="snapshot", rules=Materiality(), **more):
    return diffs.field_diffs(diffs.with_previous(t.snapshots, mode, sized_by=t.event_keys),
                             rules, **more)


def _diff_view(df):
    return df.select(
        "snapshot_id", "previous_snapshot_id", "field_name", "field_kind", "change_kind",
        "previous_value", "current_value", F.round("absolute_delta", 6).alias("absolute_delta"),
        F.round("percent_delta", 6).alias("percent_delta"), "is_material", "rule_version")


@query("field_diffs", "WITH " + diff_sql(False) + _DIFF_COLUMNS)
def field_diffs(t):
    return _diff_view(_diffs(t))


@query("field_diffs_by_field", "WITH " + diff_sql(True) + _DIFF_COLUMNS)
def field_diffs_by_field(t):
    return _diff_view(_diffs(t, "field"))


@query("field_diffs_source_rules",
       "WITH " + diff_sql(False, 0.5, 0.3, 5, "demo-lifecycle-v1") + _DIFF_COLUMNS)
def field_diffs_source_rules(t):
    """Rules per source come from a table keyed by source (here derived from the events)."""
    rules = t.snapshots.select("source_key").distinct().select(
        "source_key", F.lit("demo-lifecycle-v1").alias("version"),
        F.lit(0.5).alias("price_percent"), F.lit(None).cast("double").alias("price_absolute"),
        F.lit(0.3).alias("rating"), F.lit(5.0).alias("review_count"))
    return _diff_view(_diffs(t, rules_table=rules))


@query("diff_summary", "WITH " + diff_sql(False) + """
SELECT snapshot_id, count(*) AS n_diffs, count(*) FILTER (is_material) AS n_material
FROM diffs GROUP BY snapshot_id""")
def diff_summary(t):
    return diffs.diff_summary(_diffs(t))


FIELD_EVENTS_SQL = """field_events AS (
  SELECT *, CASE field_name WHEN 'price' THEN 'price_changed' WHEN 'rating' THEN 'rating_changed'
      WHEN 'review_count' THEN 'review_count_changed' WHEN 'host_external_id' THEN 'host_changed'
      ELSE 'direct_channel_added' END AS event_type
  FROM diffs WHERE is_material AND (field_name IN ('price', 'rating', 'review_count',
    'host_external_id') OR (field_name = 'official_website' AND change_kind = 'added')))"""

_EXPLAIN = """CASE event_type
    WHEN 'price_changed' THEN 'Observed price changed under comparable observation conditions.'
    WHEN 'rating_changed' THEN 'Observed rating changed between comparable snapshots.'
    WHEN 'review_count_changed' THEN 'Observed review count increased between comparable snapshots.'
    WHEN 'host_changed' THEN 'Observed host identifier changed; this does not assert a property sale or management change.'
    ELSE 'A direct channel (' || field_name || ') was observed; source attribution required.' END"""


@query("field_events", "WITH " + diff_sql(False) + ", " + FIELD_EVENTS_SQL + f"""
SELECT listing_id, event_type, {stamp_sql('observed_at')} AS event_at, 'high' AS confidence,
  sha256(concat_ws('|', listing_id, event_type, run_id, rule_version)) AS dedupe_key,
  {_EXPLAIN} AS summary, prev.t AS previous_value, now_text AS current_value,
  prev.s AS previous_snapshot_id, snapshot_id AS current_snapshot_id,
  '{{"field":"' || field_name || '"}}' AS metadata FROM field_events""")
def field_events(t):
    return events.field_events(_diffs(t)).select(
        "listing_id", "event_type", stamp("event_at").alias("event_at"), "confidence",
        "dedupe_key", "summary", "previous_value", "current_value", "previous_snapshot_id",
        "current_snapshot_id", "metadata")


@query("extended_field_events", "WITH " + diff_sql(False, version="field-diff:v2") + """
SELECT CASE WHEN field_name = 'official_website' THEN
      CASE change_kind WHEN 'added' THEN 'direct_channel_added' ELSE 'direct_channel_removed' END
    WHEN field_name = 'host_external_id' THEN 'host_changed'
    WHEN field_name = 'is_superhost' THEN 'superhost_changed'
    ELSE field_name || '_changed' END AS event_type, count(*) AS n
FROM diffs WHERE is_material AND NOT (field_name = 'official_website' AND change_kind = 'changed')
GROUP BY 1""")
def extended_field_events(t):
    changes = _diffs(t, rules=Materiality(version="field-diff:v2"))
    return events.field_events(changes, extended=True).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"))


_FIRST_SQL = """first AS (SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY listing_id ORDER BY observed_at, snapshot_id) AS k FROM obs) WHERE k = 1)"""


@query("creation_events", f"""WITH {OBS_SQL}, {_FIRST_SQL}
SELECT listing_id, {stamp_sql('observed_at')} AS event_at,
  'listing_created:' || listing_id || ':' || strftime(observed_at, '%Y-%m-%d') || ':field-diff:v1'
    AS dedupe_key, snapshot_id AS current_snapshot_id, run_id FROM first
WHERE listing_id % 7 <> 0""")
def creation_events(t):
    known = t.event_keys.filter(F.col("listing_id") % 7 == 0).select("listing_id").distinct()
    return events.creation_events(t.observations, known).select(
        "listing_id", stamp("event_at").alias("event_at"), "dedupe_key", "current_snapshot_id",
        "run_id")


def all_events(t):
    """Creations, differences and transitions read the observations, which are worked out once."""
    t.keep_observations()
    return events.all_events(
        events.creation_events(t.observations), events.field_events(_diffs(t)),
        events.transition_events(life_rows(t)))


def kept_events(t):
    """``all_events`` written down, for queries that read them more than once."""
    return written(all_events(t), "events")


def all_events_sql() -> str:
    """CTE ``evts``: every event with type, time, key, run and snapshot."""
    life = fold_sql("obs2 AS (SELECT 1)")
    life = life[life.index("flags AS"):]
    return diff_sql(False) + ", " + FIELD_EVENTS_SQL + ", " + life + ", " + _FIRST_SQL + """,
evts AS (
  SELECT listing_id, 'listing_created' AS event_type, observed_at AS event_at, 'high' AS confidence,
    'listing_created:' || listing_id || ':' || strftime(observed_at, '%Y-%m-%d') || ':field-diff:v1'
      AS dedupe_key, run_id, snapshot_id, 'snapshot' AS evidence_type, CAST(NULL AS BIGINT) AS previous_snapshot_id
  FROM first
  UNION ALL
  SELECT listing_id, event_type, observed_at, 'high',
    sha256(concat_ws('|', listing_id, event_type, run_id, rule_version)), run_id, snapshot_id, 'diff', prev.s
  FROM field_events
  UNION ALL
  SELECT listing_id, CASE event_type WHEN 'source_error_observed' THEN 'source_error'
      ELSE 'listing_' || event_type END, observed_at,
    CASE event_type WHEN 'reactivated' THEN 'high' WHEN 'confirmed_inactive' THEN 'high'
      WHEN 'suspected_inactive' THEN 'medium' ELSE 'low' END,
    dedupe_key, run_id, snapshot_id, 'lifecycle', CAST(NULL AS BIGINT)
  FROM transitions)"""


TITLE_SQL = """CASE event_type WHEN 'listing_created' THEN 'Listing first observed'
    WHEN 'price_changed' THEN 'Observed price changed' WHEN 'rating_changed' THEN 'Observed rating changed'
    WHEN 'review_count_changed' THEN 'Observed review count changed'
    WHEN 'host_changed' THEN 'Observed host identifier changed'
    WHEN 'direct_channel_added' THEN 'Direct channel observed'
    WHEN 'listing_first_miss' THEN 'First qualifying miss'
    WHEN 'listing_suspected_inactive' THEN 'Suspected inactive'
    WHEN 'listing_confirmed_inactive' THEN 'Likely inactive'
    WHEN 'listing_reactivated' THEN 'Reactivated' ELSE 'Source error observed' END"""


@query("all_events", "WITH " + all_events_sql() + f"""
SELECT md5(dedupe_key) AS event_id, 'd1' AS dataset_id, listing_id % 20 AS property_id, listing_id, event_type,
  {stamp_sql('event_at')} AS event_at, confidence, {TITLE_SQL} AS title, dedupe_key FROM evts""")
def all_events_query(t):
    found = all_events(t)
    owners = t.observations.select("listing_id").distinct().withColumn(
        "property_id", F.col("listing_id") % 20)
    return events.event_table(found, "d1", owners).select(
        "event_id", "dataset_id", "property_id", "listing_id", "event_type", stamp("event_at").alias("event_at"), "confidence",
        "title", "dedupe_key")


@query("event_evidence", "WITH " + all_events_sql() + """
SELECT md5(dedupe_key) AS event_id, previous_snapshot_id, snapshot_id AS current_snapshot_id,
  run_id, evidence_type FROM evts""")
def event_evidence(t):
    return events.evidence_table(all_events(t)).select(
        "event_id", "previous_snapshot_id", "current_snapshot_id", "run_id", "evidence_type")


@query("latest_snapshots", f"""WITH {BUILT_SQL}
SELECT listing_id, snapshot_id AS latest_snapshot_id, title AS current_title,
  observation_status AS current_observation_status, {stamp_sql('observed_at')} AS last_observed_at
FROM (SELECT *, row_number() OVER (PARTITION BY listing_id
  ORDER BY observed_at DESC, snapshot_id DESC) AS k FROM built) WHERE k = 1""")
def latest_snapshots(t):
    return catalogue.latest_snapshots(t.snapshots).withColumn(
        "last_observed_at", stamp("last_observed_at"))


def _snapshot_store(t, runs):
    """A store that holds the runs up to a day, written in two commits."""
    folder = f"{checkpoint_dir(t.spark).rstrip('/')}/snapshots-{uuid.uuid4().hex}"
    table = KeyedTable(t.spark, folder, ["listing_id", "run_id"], ["listing_id"], buckets=8)
    for part in ("run_id <= '2024-01-10'", f"run_id <= '{runs}'"):  # the second repeats the first
        table.append(t.observations.filter(part).select("listing_id", "run_id", "snapshot_id"))
    return table


@query("replayed_snapshots", f"""WITH {OBS_SQL}
SELECT listing_id, run_id, snapshot_id FROM obs WHERE run_id > '2024-01-20'""")
def replayed_snapshots(t):
    """A replay against a store that already holds the runs up to a day."""
    return _snapshot_store(t, "2024-01-20").only_new(t.observations).select("listing_id", "run_id", "snapshot_id")


@query("appended_snapshots", f"""WITH {OBS_SQL}
SELECT listing_id, run_id, snapshot_id FROM obs""")
def appended_snapshots(t):
    table = _snapshot_store(t, "2024-01-20")
    table.append(t.observations.select("listing_id", "run_id", "snapshot_id"))
    return table.read()
