"""The standard reports and what their manifest says."""

import uuid

from pyspark.sql import functions as F

from registry import query
from registry.figures import _tagged_events
from registry.snapshots import all_events_sql
from registry.tables import stamp, stamp_sql
from tidewatch.session import checkpoint_dir, written
from tidewatch.sinks import report_types

_SUMMARY = f"""summary AS (SELECT 1 AS dataset_id, run_id, count(*) AS snapshots,
  count(*) FILTER (observation_status = 'active') AS active, count(*) FILTER (observation_status = 'not_found') AS not_found,
  count(*) FILTER (observation_status IN ('source_error', 'blocked')) AS failed, count(price_amount) AS priced,
  {stamp_sql('min(observed_at)')} AS first_at, {stamp_sql('max(observed_at)')} AS last_at FROM built GROUP BY run_id)"""

_CHANGE = """daily AS (SELECT 'region ' || (listing_id % 5) AS region, CAST(observed_at AS DATE) AS day,
    count(DISTINCT CASE WHEN observation_status = 'active' THEN listing_id END) AS active FROM built GROUP BY 1, 2),
spine AS (SELECT region, CAST(unnest(generate_series((SELECT min(day) FROM daily), (SELECT max(day) FROM daily),
    INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT region FROM daily)),
filled AS (SELECT region, day, active IS NOT NULL AS observed, coalesce(last_value(active IGNORE NULLS) OVER (
    PARTITION BY region ORDER BY day ROWS UNBOUNDED PRECEDING), 0) AS active_listings FROM spine LEFT JOIN daily USING (region, day)),
change AS (SELECT 1 AS dataset_id, region, strftime(day, '%Y-%m-%d') AS day, observed, active_listings,
    active_listings - lag(active_listings) OVER (PARTITION BY region ORDER BY day) AS change FROM filled)"""

_HISTORY = """history AS (SELECT *, row_number() OVER w AS number, lag(event_type) OVER w AS previous_type,
    CAST(floor((epoch_us(event_at) - lag(epoch_us(event_at)) OVER w) / 86400000000.0) AS BIGINT) AS days_since
  FROM (SELECT *, listing_id % 20 AS property_id, md5(dedupe_key) AS event_id FROM evts)
  WINDOW w AS (PARTITION BY property_id ORDER BY event_at, event_id))"""


@query("snapshot_summary_report", f"WITH {all_events_sql()}, {_SUMMARY} SELECT * FROM summary")
def snapshot_summary_report(t):
    return report_types.snapshot_summary(_snapshots(t)).withColumns({
        c: stamp(c) for c in ("first_at", "last_at")})


def _snapshots(t):
    return t.snapshots.withColumn("dataset_id", F.lit(1))


def _events(t):
    # Counted, numbered and written: three readers, one of them while the plan is built.
    return written(_tagged_events(t), "events")


@query("region_change_report", f"WITH {all_events_sql()}, {_CHANGE} SELECT * FROM change")
def region_change_report(t):
    return report_types.region_change(_snapshots(t)).withColumn("day", F.col("day").cast("string"))


@query("property_history_report", f"""WITH {all_events_sql()}, {_HISTORY}
SELECT 1 AS dataset_id, property_id, event_id, event_type, {stamp_sql('event_at')} AS event_at, listing_id, number,
  previous_type, days_since FROM history""")
def property_history_report(t):
    return report_types.property_history(_events(t)).withColumn("event_at", stamp("event_at")).drop("summary")


@query("event_evidence_report", f"""WITH {all_events_sql()}, {_HISTORY}
SELECT 1 AS dataset_id, property_id, CAST((number - 1) // 50 AS BIGINT) AS line, count(*) AS events,
  {stamp_sql('min(event_at)')} AS first_at, {stamp_sql('max(event_at)')} AS last_at,
  CAST(sum(length(event_type)) AS BIGINT) AS type_letters FROM history GROUP BY property_id, line""")
def event_evidence_report(t):
    # The twin counts the letters of all event types named in the text.
    kinds = F.transform(F.split("evidence", "\n"), lambda e: F.length(F.split(e, r" \| ")[1]))
    return report_types.event_evidence(_events(t)).select(
        "dataset_id", "property_id", "line", "events", stamp("first_at").alias("first_at"),
        stamp("last_at").alias("last_at"),
        F.aggregate(kinds, F.lit(0).cast("long"), lambda a, b: a + b).alias("type_letters"))


@query("written_reports", f"""WITH {all_events_sql()}, {_SUMMARY}, {_CHANGE}, {_HISTORY}
SELECT 'snapshot_summary' AS report, '1' AS dataset_id, count(*) AS lines FROM summary
UNION ALL SELECT 'region_change', '1', count(*) FROM change
UNION ALL SELECT 'property_history', '1', count(*) FROM history
UNION ALL SELECT 'event_evidence', '1', count(DISTINCT (property_id, (number - 1) // 50)) FROM history""")
def written_reports(t):
    folder = f"{checkpoint_dir(t.spark).rstrip('/')}/reports-{uuid.uuid4().hex}"
    found = _events(t)
    return report_types.write_reports(folder, {
        "snapshot_summary": report_types.snapshot_summary(_snapshots(t)),
        "region_change": report_types.region_change(_snapshots(t)),
        "property_history": report_types.property_history(found),
        "event_evidence": report_types.event_evidence(found)}).select("report", "dataset_id", "lines")
