"""Life cycle, run health and observation classes."""

import uuid

from pyspark.sql import functions as F

from registry import query
from registry.tables import OBS_SQL, stamp, stamp_sql
from tidewatch.config import LifecycleRules
from tidewatch.operators import health, lifecycle
from tidewatch.plans.reprocess import Versions
from tidewatch.session import checkpoint_dir, written

HEALTH_SQL = """counts AS (
  SELECT run_id, min(observed_at) AS started_at, count(*) AS total,
    count(*) FILTER (observation_status NOT IN ('source_error', 'blocked', 'unknown')) AS valid,
    count(*) FILTER (observation_status = 'source_error') AS errors,
    count(*) FILTER (observation_status = 'blocked') AS blocked
  FROM obs GROUP BY run_id),
rates AS (
  SELECT *, errors / CAST(total AS DOUBLE) AS error_rate,
    blocked / CAST(total AS DOUBLE) AS blocked_rate,
    CASE WHEN lag(valid) OVER w > 0 THEN valid / CAST(lag(valid) OVER w AS DOUBLE) END
      AS valid_ratio
  FROM counts WINDOW w AS (ORDER BY started_at, run_id)),
health AS (
  SELECT *, concat_ws(',',
      CASE WHEN valid_ratio < 0.7 THEN 'valid_observation_drop' END,
      CASE WHEN error_rate > 0.15 THEN 'source_error_spike' END,
      CASE WHEN blocked_rate > 0.05 THEN 'blocked_spike' END) AS reasons
  FROM rates)"""


def fold_sql(obs: str, misses: int = 3, days: float = 7, counted: str = "'not_found', 'unavailable'",
             high: str = "high", version: str = "lifecycle-state:v1") -> str:
    """The life cycle as window SQL over ``obs``; ends in CTE ``life``."""
    order = "ORDER BY observed_at, snapshot_id"
    return f"""{obs},
flags AS (
  SELECT *, (NOT degraded AND observation_status = 'active') AS act,
    (NOT degraded AND observation_status IN ({counted})) AS miss,
    (NOT degraded AND observation_status = 'not_found' AND {high}) AS strong
  FROM obs),
islands AS (
  SELECT *, sum(CASE WHEN act THEN 1 ELSE 0 END) OVER (
    PARTITION BY listing_id {order} ROWS UNBOUNDED PRECEDING) AS isl FROM flags),
m1 AS (
  SELECT *, sum(CASE WHEN miss THEN 1 ELSE 0 END) OVER w AS m,
    min(CASE WHEN miss THEN observed_at END) OVER w AS start,
    max(CASE WHEN strong THEN 1 ELSE 0 END) OVER w AS hc,
    last_value(CASE WHEN miss THEN run_id END IGNORE NULLS) OVER (
      PARTITION BY listing_id, isl {order}
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_run
  FROM islands WINDOW w AS (PARTITION BY listing_id, isl {order} ROWS UNBOUNDED PRECEDING)),
m2 AS (
  SELECT *, sum(CASE WHEN miss AND prev_run IS DISTINCT FROM run_id THEN 1 ELSE 0 END) OVER (
      PARTITION BY listing_id, isl {order} ROWS UNBOUNDED PRECEDING) AS runs,
    (epoch_us(observed_at) - epoch_us(start)) / 3600000000.0 AS hours
  FROM m1),
m3 AS (
  SELECT *, min(CASE WHEN miss AND m >= {misses} AND hours >= {days} * 24 AND hc = 1
        AND observation_status = 'not_found' THEN m END) OVER v AS c_at,
    min(CASE WHEN miss AND m >= 2 AND hours >= 24 AND runs >= 2 THEN m END) OVER v AS s_at
  FROM m2 WINDOW v AS (PARTITION BY listing_id, isl)),
m4 AS (
  SELECT *, CASE WHEN m = 0 THEN 0 WHEN m >= c_at THEN 3 WHEN m >= s_at THEN 2 ELSE 1 END AS level
  FROM m3),
m5 AS (
  SELECT *, coalesce(last_value(CASE WHEN act OR miss THEN level END IGNORE NULLS) OVER (
      PARTITION BY listing_id {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS prev_level
  FROM m4),
m6 AS (
  SELECT *, CASE
      WHEN act AND prev_level >= 2 THEN 'reactivated'
      WHEN miss AND m = c_at THEN 'confirmed_inactive'
      WHEN miss AND m = s_at AND (c_at IS NULL OR s_at < c_at) THEN 'suspected_inactive'
      WHEN miss AND m = 1 AND level = 1 THEN 'first_miss'
      WHEN NOT degraded AND observation_status = 'source_error' THEN 'source_error_observed'
    END AS event_type,
    CASE WHEN act AND prev_level >= 2 THEN 'reactivated' WHEN act THEN 'active'
      WHEN miss AND level = 1 THEN 'first_miss' WHEN miss AND level = 2 THEN 'suspected_inactive'
      WHEN miss AND level = 3 THEN 'confirmed_inactive' END AS own
  FROM m5),
life AS (
  SELECT *, coalesce(last_value(own IGNORE NULLS) OVER w, 'active') AS status,
    coalesce(last_value(own IGNORE NULLS) OVER (
      PARTITION BY listing_id {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'active')
      AS previous_status,
    CAST(sum(CASE WHEN event_type IN ('reactivated', 'confirmed_inactive', 'suspected_inactive')
      THEN 1 ELSE 0 END) OVER w AS BIGINT) AS seq,
    min(CASE WHEN miss THEN observed_at END) OVER w AS first_miss_at,
    coalesce(max(CASE WHEN act THEN observed_at END) OVER w, min(observed_at) OVER w)
      AS last_seen_active_at,
    max(CASE WHEN event_type = 'suspected_inactive' THEN observed_at END) OVER w AS suspected_at,
    max(CASE WHEN event_type = 'confirmed_inactive' THEN observed_at END) OVER w AS confirmed_at,
    max(CASE WHEN event_type = 'reactivated' THEN observed_at END) OVER w AS reactivated_at
  FROM m6 WINDOW w AS (PARTITION BY listing_id {order} ROWS UNBOUNDED PRECEDING)),
transitions AS (
  SELECT *, CASE event_type
      WHEN 'first_miss' THEN 'listing_first_miss:' || listing_id || ':' || snapshot_id
      WHEN 'suspected_inactive' THEN 'listing_suspected_inactive:' || listing_id || ':' || seq
      WHEN 'confirmed_inactive' THEN 'listing_confirmed_inactive:' || listing_id || ':' || seq
      WHEN 'reactivated' THEN 'listing_reactivated:' || listing_id || ':' || snapshot_id
      ELSE 'source_error:' || listing_id || ':' || run_id END || ':{version}' AS dedupe_key
  FROM life WHERE event_type IS NOT NULL)"""


def life_rows(t, rules=LifecycleRules()):
    return lifecycle.lifecycle_rows(t.observations, rules, sized_by=t.event_keys)


def _transitions(t, rules=LifecycleRules()):
    return lifecycle.lifecycle_events(life_rows(t, rules), rules).select(
        "listing_id", "event_type", stamp("event_at").alias("event_at"), "confidence",
        "dedupe_key", "previous_status", "current_status", "snapshot_id", "run_id", "explanation")


_TRANSITION_COLUMNS = f"""SELECT listing_id, event_type, {stamp_sql('observed_at')} AS event_at,
  CASE event_type WHEN 'reactivated' THEN 'high' WHEN 'confirmed_inactive' THEN 'high'
    WHEN 'suspected_inactive' THEN 'medium' ELSE 'low' END AS confidence,
  dedupe_key, previous_status, status AS current_status, snapshot_id, run_id,
  CASE event_type
    WHEN 'first_miss' THEN 'The listing returned its first qualifying direct miss; recorded for review, not yet inactive.'
    WHEN 'suspected_inactive' THEN 'The listing returned ' || m || ' qualifying misses across at least 24h in ' || runs || ' runs; it is suspected inactive.'
    WHEN 'confirmed_inactive' THEN 'The listing returned qualifying direct misses across at least DAYS days including a high-confidence not-found; it is likely inactive.'
    WHEN 'reactivated' THEN 'A direct active observation followed a period of suspected/confirmed inactivity; the listing is reactivated.'
    ELSE 'The collection run reported a source error for this listing; this is not evidence of inactivity.'
  END AS explanation
FROM transitions"""


@query("lifecycle_transitions",
       "WITH " + fold_sql(OBS_SQL) + _TRANSITION_COLUMNS.replace("DAYS", "7"))
def lifecycle_transitions(t):
    return _transitions(t)


@query("lifecycle_transitions_own_rules",
       "WITH " + fold_sql(OBS_SQL, misses=2, days=3, counted="'not_found'", high="true",
                          version="lifecycle-state:v2")
       + _TRANSITION_COLUMNS.replace("DAYS", "3"))
def lifecycle_transitions_own_rules(t):
    return _transitions(t, LifecycleRules(
        version="lifecycle-state:v2", confirmed_min_misses=2, confirmed_min_days=3,
        count_unavailable=False, direct_not_found_is_high_confidence=True))


_V2_SQL = fold_sql(OBS_SQL, misses=2, days=3, counted="'not_found'", high="true", version="lifecycle-state:v2")
_V2 = LifecycleRules(version="lifecycle-state:v2", confirmed_min_misses=2, confirmed_min_days=3,
                     count_unavailable=False, direct_not_found_is_high_confidence=True)
_ROWS_SQL = "SELECT DISTINCT '{0}' AS rule_version, dedupe_key, event_type, listing_id FROM transitions"


def _versions(t, second):
    """Transitions under two rule versions, the second run for some listings and run twice."""
    folder = f"{checkpoint_dir(t.spark).rstrip('/')}/versions-{uuid.uuid4().hex}"
    versions = Versions(t.spark, folder, "listing_id")
    t.keep_observations()
    for rules, chosen, part in ((LifecycleRules(), "true", "true"), (_V2, second, "listing_id % 3 = 0"), (_V2, second, "true")):
        seen = t.observations.filter(chosen).filter(part)
        rows = lifecycle.lifecycle_rows(seen, rules).filter(F.col("event_type").isNotNull())
        # A version is written from its rows and from the keys that have none.
        found = written(rows.select("listing_id", "dedupe_key", "event_type"), "transitions")
        versions.put(rules.version, found, seen, "ana", "2025-01-01", "rules")
    return versions


@query("reprocessed_events", f"""SELECT * FROM (WITH {fold_sql(OBS_SQL)} {_ROWS_SQL.format('lifecycle-state:v1')})
UNION ALL SELECT * FROM (WITH {_V2_SQL} {_ROWS_SQL.format('lifecycle-state:v2')})""")
def reprocessed_events(t):
    return _versions(t, "true").read().select("rule_version", "dedupe_key", "event_type", "listing_id")


@query("current_events", f"""SELECT * FROM (WITH {fold_sql(OBS_SQL)} {_ROWS_SQL.format('lifecycle-state:v1')}) WHERE listing_id % 2 = 1
UNION ALL SELECT * FROM (WITH {_V2_SQL} {_ROWS_SQL.format('lifecycle-state:v2')}) WHERE listing_id % 2 = 0""")
def current_events(t):
    return _versions(t, "listing_id % 2 = 0").current(["lifecycle-state:v2", "lifecycle-state:v1"]).select(
        "rule_version", "dedupe_key", "event_type", "listing_id")


@query("lifecycle_states", "WITH " + fold_sql(OBS_SQL) + f"""
SELECT listing_id, status, CASE status WHEN 'suspected_inactive' THEN 'medium'
    WHEN 'first_miss' THEN 'low' WHEN 'active' THEN CASE WHEN any_own THEN 'high' ELSE 'low' END
    ELSE 'high' END AS confidence,
  CAST(m AS BIGINT) AS consecutive_misses, {stamp_sql('last_seen_active_at')} AS last_seen_active_at,
  {stamp_sql('observed_at')} AS last_observed_at, {stamp_sql('first_miss_at')} AS first_miss_at,
  {stamp_sql('suspected_at')} AS suspected_inactive_at,
  {stamp_sql('confirmed_at')} AS confirmed_inactive_at,
  {stamp_sql('reactivated_at')} AS reactivated_at,
  {stamp_sql('start')} AS miss_sequence_start_at, CAST(runs AS BIGINT) AS distinct_miss_runs,
  hc = 1 AS high_confidence_in_sequence, seq AS transition_sequence
FROM (SELECT *, row_number() OVER (PARTITION BY listing_id
        ORDER BY observed_at DESC, snapshot_id DESC) AS back,
      bool_or(own IS NOT NULL) OVER (PARTITION BY listing_id) AS any_own FROM life)
WHERE back = 1""")
def lifecycle_states(t):
    times = ("last_seen_active_at", "last_observed_at", "first_miss_at", "suspected_inactive_at",
             "confirmed_inactive_at", "reactivated_at", "miss_sequence_start_at")
    return lifecycle.lifecycle_state(life_rows(t)).drop("last_miss_run_id").withColumns(
        {c: stamp(c) for c in times})


@query("lifecycle_row_states", "WITH " + fold_sql(OBS_SQL) + """
SELECT listing_id, snapshot_id, status, previous_status, CAST(m AS BIGINT) AS consecutive_misses,
  CAST(runs AS BIGINT) AS distinct_miss_runs, seq AS transition_sequence FROM life""")
def lifecycle_row_states(t):
    return life_rows(t).select(
        "listing_id", "snapshot_id", "status", "previous_status", "consecutive_misses",
        "distinct_miss_runs", "transition_sequence")


def run_health(t):
    tagged = t.observations.withColumns({"dataset_id": F.lit(1), "source_key": F.lit("events")})
    return health.assess(health.run_counts(tagged))


@query("run_health", f"WITH {OBS_SQL}, {HEALTH_SQL}" + f"""
SELECT run_id, {stamp_sql('started_at')} AS started_at, total, valid, errors, blocked,
  round(error_rate, 6) AS error_rate, round(blocked_rate, 6) AS blocked_rate,
  round(valid_ratio, 6) AS valid_ratio, reasons, reasons <> '' AS degraded FROM health""")
def run_health_query(t):
    return run_health(t).select(
        "run_id", stamp("started_at").alias("started_at"), "total", "valid", "errors", "blocked",
        F.round("error_rate", 6).alias("error_rate"), F.round("blocked_rate", 6).alias("blocked_rate"),
        F.round("valid_ratio", 6).alias("valid_ratio"),
        F.array_join("reasons", ",").alias("reasons"), "degraded")


_MARKED = f"""{OBS_SQL.replace('obs AS', 'raw AS', 1)}, {HEALTH_SQL.replace('FROM obs', 'FROM raw')},
obs AS (SELECT raw.* EXCLUDE (degraded), (h.valid_ratio < 0.9 OR h.error_rate > 0.2
      OR h.blocked_rate > 0.05) IS TRUE AS degraded
  FROM raw LEFT JOIN health h USING (run_id))"""


@query("lifecycle_with_run_health", "WITH " + fold_sql(_MARKED) + """
SELECT listing_id, snapshot_id, degraded AS run_degraded, status, event_type,
  seq AS transition_sequence FROM life""")
def lifecycle_with_run_health(t):
    from tidewatch.config import RunHealth

    tagged = t.observations.withColumns({"dataset_id": F.lit(1), "source_key": F.lit("events")})
    judged = health.assess(health.run_counts(tagged), RunHealth(
        version="run-health:strict", min_valid_ratio=0.9, max_error_rate=0.2))
    rows = lifecycle.lifecycle_rows(health.mark_degraded(t.observations, judged),
                                    sized_by=t.event_keys)
    return rows.select("listing_id", "snapshot_id", "run_degraded", "status", "event_type",
                       "transition_sequence")


@query("observation_classes", f"""WITH {OBS_SQL}
SELECT observation_status, observation_status IN ('blocked', 'source_error') AS is_source_failure,
  observation_status = 'search_not_observed' AS is_search_absence,
  observation_status IN ('search_not_observed', 'blocked', 'source_error', 'unknown')
    AS is_non_qualifying, count(*) AS n FROM obs GROUP BY ALL""")
def observation_classes(t):
    return lifecycle.observation_classes(t.observations).groupBy(
        "observation_status", "is_source_failure", "is_search_absence", "is_non_qualifying"
    ).agg(F.count(F.lit(1)).alias("n"))
