"""Trends, summaries, daily views, notifications and further run checks."""

from pyspark.sql import functions as F

from registry import query
from registry.lifecycle import HEALTH_SQL, run_health
from registry.snapshots import _diffs, all_events, all_events_sql, kept_events
from registry.tables import stamp, stamp_sql
from tidewatch.operators import insights
from tidewatch.session import written

_ACTIVE = "observation_status = 'active'"
_REGION = "'region ' || (listing_id % 5)"


def _tagged_events(t):
    return all_events(t).withColumns({
        "dataset_id": F.lit(1), "property_id": F.col("listing_id") % 20})


@query("overview_kpis", f"""WITH {all_events_sql()}, {HEALTH_SQL.replace('FROM obs', 'FROM built')}
SELECT 1 AS dataset_id, count(*) FILTER (event_type = 'listing_created') AS new_listings,
  count(*) FILTER (event_type = 'listing_reactivated') AS reactivated,
  count(*) FILTER (event_type IN ('price_changed', 'rating_changed', 'review_count_changed', 'host_changed',
    'direct_channel_added')) AS material_changes,
  (SELECT {stamp_sql('max(started_at)')} FROM health WHERE valid_ratio > 0.9 AND error_rate < 0.22) AS last_successful_run,
  (SELECT round((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(started_at))) / 3600000000.0, 6) FROM health
    WHERE valid_ratio > 0.9 AND error_rate < 0.22) AS freshness_hours
FROM evts""")
def overview_kpis(t):
    judged = run_health(t).withColumn("degraded", ~F.coalesce(
        (F.col("valid_ratio") > 0.9) & (F.col("error_rate") < 0.22), F.lit(False)))
    now = F.lit("2024-02-01").cast("timestamp")
    return insights.overview_kpis(_tagged_events(t), judged, now).withColumn(
        "last_successful_run", stamp("last_successful_run")).withColumn("freshness_hours", F.round("freshness_hours", 6))


@query("active_trend", f"""WITH {all_events_sql()}, daily AS (
  SELECT strftime(observed_at, '%Y-%m-%d') AS day, {_REGION} AS region, count(DISTINCT listing_id) AS active_listings
  FROM built WHERE {_ACTIVE} GROUP BY 1, 2)
SELECT * FROM daily UNION ALL SELECT day, NULL, CAST(sum(active_listings) AS BIGINT) FROM daily GROUP BY 1""")
def active_trend(t):
    return insights.active_trend(t.snapshots).withColumn("day", F.col("day").cast("string"))


@query("area_table", f"""WITH {all_events_sql()}
SELECT {_REGION} AS region, count(*) AS listings, count(*) FILTER ({_ACTIVE}) AS active,
  median(CASE WHEN {_ACTIVE} THEN CAST(price_amount AS DOUBLE) END) AS median_price,
  median(CASE WHEN {_ACTIVE} THEN rating2 END) AS median_rating,
  round(count(*) FILTER ({_ACTIVE}) / CAST(count(*) AS DOUBLE), 6) AS coverage
FROM built GROUP BY 1""")
def area_table(t):
    return insights.area_table(t.snapshots).withColumn("coverage", F.round("coverage", 6))


@query("run_summary", f"""WITH {all_events_sql()}, seen AS (
  SELECT run_id, count(*) AS observed, count(*) FILTER ({_ACTIVE}) AS active,
    count(*) FILTER (observation_status IN ('source_error', 'blocked')) AS errors,
    (epoch_us(max(observed_at)) - epoch_us(min(observed_at))) / 1000000.0 AS duration_seconds FROM built GROUP BY 1),
raised AS (SELECT run_id, count(*) FILTER (event_type = 'listing_created') AS new,
    count(*) FILTER (event_type LIKE '%\\_changed' ESCAPE '\\') AS changed,
    count(*) FILTER (event_type = 'listing_suspected_inactive') AS suspected,
    count(*) FILTER (event_type = 'listing_confirmed_inactive') AS confirmed FROM evts GROUP BY 1)
SELECT run_id, observed, active, errors, round(duration_seconds, 3) AS duration_seconds,
  coalesce(new, 0) AS new, coalesce(changed, 0) AS changed, coalesce(suspected, 0) AS suspected,
  coalesce(confirmed, 0) AS confirmed FROM seen LEFT JOIN raised USING (run_id)""")
def run_summary(t):
    found = all_events(t)  # before the snapshots, which read the observations it keeps
    return insights.run_summary(t.snapshots, found).withColumn(
        "duration_seconds", F.round("duration_seconds", 3))


@query("event_counts_daily", f"""WITH {all_events_sql()}
SELECT strftime(event_at, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM evts GROUP BY 1, 2""")
def event_counts_daily(t):
    return insights.event_counts_daily(all_events(t)).withColumn("day", F.col("day").cast("string"))


@query("region_summary", f"""WITH {all_events_sql()}
SELECT {_REGION} AS region, strftime(observed_at, '%Y-%m-%d') AS day, count(*) AS snapshots,
  count(*) FILTER ({_ACTIVE}) AS active,
  round(avg(CASE WHEN {_ACTIVE} THEN CAST(price_amount AS DOUBLE) END), 4) AS average_price,
  round(avg(CASE WHEN {_ACTIVE} THEN rating2 END), 4) AS average_rating FROM built GROUP BY 1, 2""")
def region_summary(t):
    return insights.region_summary(t.snapshots).select(
        "region", F.col("day").cast("string").alias("day"), "snapshots", "active",
        F.round("average_price", 4).alias("average_price"),
        F.round("average_rating", 4).alias("average_rating"))


@query("overview_daily", f"""WITH {all_events_sql()},
a AS (SELECT strftime(observed_at, '%Y-%m-%d') AS day, count(*) AS snapshots, count(*) FILTER ({_ACTIVE}) AS active
  FROM built GROUP BY 1),
b AS (SELECT strftime(event_at, '%Y-%m-%d') AS day, count(*) AS events FROM evts GROUP BY 1)
SELECT 1 AS dataset_id, day, coalesce(snapshots, 0) AS snapshots, coalesce(active, 0) AS active,
  coalesce(events, 0) AS events FROM a FULL JOIN b USING (day)""")
def overview_daily(t):
    found = _tagged_events(t)
    return insights.overview_daily(t.snapshots, found).withColumn(
        "day", F.col("day").cast("string"))


@query("import_deltas", f"""WITH {all_events_sql()},
touched AS (SELECT DISTINCT snapshot_id FROM diffs),
made AS (SELECT snapshot_id FROM evts WHERE event_type = 'listing_created'),
raised AS (SELECT run_id, count(*) AS events FROM evts GROUP BY 1),
marked AS (SELECT run_id, snapshot_id IN (SELECT snapshot_id FROM made) AS is_new,
    snapshot_id IN (SELECT snapshot_id FROM touched) AS is_changed FROM built)
SELECT run_id, count(*) FILTER (is_new) AS created, count(*) FILTER (NOT is_new AND is_changed) AS updated,
  count(*) FILTER (NOT is_new AND NOT is_changed) AS unchanged, coalesce(any_value(events), 0) AS events
FROM marked LEFT JOIN raised USING (run_id) GROUP BY run_id""")
def import_deltas(t):
    found = kept_events(t)
    return insights.import_deltas(t.snapshots, _diffs(t), found)


@query("notifications", f"""WITH {all_events_sql()}, rules AS (
  SELECT c_custkey AS rule_id, CASE c_custkey % 3 WHEN 0 THEN ['price_changed', 'listing_created']
      WHEN 1 THEN ['listing_suspected_inactive', 'listing_confirmed_inactive'] ELSE ['source_error'] END AS event_types,
    c_custkey % 3 + 1 AS minimum, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 10 END AS watchlist_id
  FROM customer),
items AS (SELECT DISTINCT p_partkey % 10 AS watchlist_id, p_partkey % 20 AS property_id FROM part),
opened AS (SELECT rule_id, minimum, watchlist_id, unnest(event_types) AS event_type FROM rules)
SELECT rule_id, count(*) AS hits FROM opened o JOIN evts e USING (event_type)
WHERE CASE confidence WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END >= minimum
  AND (watchlist_id IS NULL OR (watchlist_id, listing_id % 20) IN (SELECT (watchlist_id, property_id) FROM items))
GROUP BY 1""")
def notifications(t):
    k = F.col("c_custkey")
    kinds = F.when(k % 3 == 0, F.array(F.lit("price_changed"), F.lit("listing_created"))).when(
        k % 3 == 1, F.array(F.lit("listing_suspected_inactive"), F.lit("listing_confirmed_inactive"))
    ).otherwise(F.array(F.lit("source_error")))
    rules = t.read("customer").select(
        k.alias("rule_id"), F.lit(1).alias("dataset_id"), kinds.alias("event_types"),
        F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (k % 3 + 1).cast("int"))
        .alias("minimum_confidence"),
        F.when(k % 2 == 0, k % 10).alias("watchlist_id"), F.lit(True).alias("enabled"))
    p = F.col("p_partkey")
    items = t.read("part").select(
        (p % 10).alias("watchlist_id"), (p % 20).alias("property_id"))
    found = written(_tagged_events(t).select("dataset_id", "event_type", "confidence", "property_id"), "events")
    return insights.notification_counts(found, rules, items)


@query("extra_degradations", f"""WITH {all_events_sql()}, runs AS (
  SELECT run_id, min(observed_at) AS started_at, count(*) AS n, max(parser_version) AS parser,
    count(*) FILTER (p_rating) AS r, count(*) FILTER (p_price) AS p FROM built GROUP BY 1),
chained AS (SELECT *, lag(run_id) OVER w AS before, lag(parser) OVER w AS parser_before,
    lag(r / CAST(n AS DOUBLE)) OVER w AS r_before, lag(p / CAST(n AS DOUBLE)) OVER w AS p_before
  FROM runs WINDOW w AS (ORDER BY started_at, run_id)),
regions AS (SELECT run_id, {_REGION} AS region, count(*) AS c FROM built GROUP BY 1, 2)
SELECT run_id, 'parser_changed' AS reason, parser AS subject FROM chained WHERE parser <> parser_before
UNION ALL SELECT run_id, 'required_field_disappeared', 'rating' FROM chained WHERE r / CAST(n AS DOUBLE) < r_before * 0.95
UNION ALL SELECT run_id, 'required_field_disappeared', 'price' FROM chained WHERE p / CAST(n AS DOUBLE) < p_before * 0.95
UNION ALL SELECT c.run_id, 'region_coverage_collapse', e.region FROM chained c JOIN regions e ON e.run_id = c.before
  LEFT JOIN regions now ON now.run_id = c.run_id AND now.region = e.region WHERE coalesce(now.c, 0) < e.c * 0.9""")
def extra_degradations(t):
    return insights.extra_degradations(t.snapshots, ("rating", "price"), 0.9, 0.95).select(
        "run_id", "reason", "subject")


@query("import_health", """SELECT l_suppkey AS import_id, count(*) AS total,
  count(*) FILTER (l_returnflag = 'R') AS rejected,
  round(count(*) FILTER (l_returnflag = 'R') / CAST(count(*) AS DOUBLE), 6) AS rejection_rate FROM lineitem GROUP BY 1""")
def import_health(t):
    metrics = t.read("lineitem").groupBy(F.col("l_suppkey").alias("import_id")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("rejected"))
    return insights.import_health(metrics).withColumn(
        "rejection_rate", F.round("rejection_rate", 6))
