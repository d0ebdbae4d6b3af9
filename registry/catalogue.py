"""Catalogue lists, pages, access, overview, reports."""

import uuid

from pyspark.sql import functions as F

from registry import query
from registry.snapshots import TITLE_SQL, all_events_sql, kept_events
from registry.tables import LISTINGS_SQL, PROPERTIES_SQL, stamp, stamp_sql
from tidewatch.operators import access, catalogue, clusters, events, search
from tidewatch.session import checkpoint_dir
from tidewatch.sinks import reports

# Tenancy: nations are organisations, customers members, suppliers datasets' grants.
MEMBERS_SQL = """members AS (
  SELECT c_custkey % 200 AS user_id, c_nationkey AS organization_id,
    CASE c_custkey % 7 WHEN 0 THEN 'owner' WHEN 1 THEN 'admin' WHEN 2 THEN 'analyst' ELSE 'viewer' END AS role
  FROM customer)"""
ACCESS_SQL = """access AS (
  SELECT s_nationkey AS organization_id, s_suppkey % 40 AS dataset_id,
    CASE WHEN s_suppkey % 3 = 0 THEN 'manage' ELSE 'read' END AS access_level FROM supplier)"""


def _members(t):
    k = F.col("c_custkey")
    role = F.when(k % 7 == 0, "owner").when(k % 7 == 1, "admin").when(
        k % 7 == 2, "analyst").otherwise("viewer")
    return t.read("customer").select((k % 200).alias("user_id"),
                                     F.col("c_nationkey").alias("organization_id"),
                                     role.alias("role"))


def _access(t):
    return t.read("supplier").select(
        F.col("s_nationkey").alias("organization_id"),
        (F.col("s_suppkey") % 40).alias("dataset_id"),
        F.when(F.col("s_suppkey") % 3 == 0, "manage").otherwise("read").alias("access_level"))


def _facts(t):
    return t.read("lineitem").select(
        (F.col("l_suppkey") % 40).alias("dataset_id"), "l_orderkey", "l_linenumber")


@query("visible_facts", f"""WITH {MEMBERS_SQL}, {ACCESS_SQL}
SELECT l_suppkey % 40 AS dataset_id, count(*) AS n FROM lineitem WHERE l_suppkey % 40 IN (
  SELECT dataset_id FROM members JOIN access USING (organization_id) WHERE user_id = 7) GROUP BY 1""")
def visible_facts(t):
    allowed = access.visible_datasets(_members(t), _access(t), 7)
    return access.restrict(_facts(t), allowed).groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("n"))


@query("manageable_datasets", f"""WITH {MEMBERS_SQL}, {ACCESS_SQL}
SELECT DISTINCT dataset_id FROM members JOIN access USING (organization_id)
WHERE user_id = 7 AND role IN ('owner', 'admin') AND access_level = 'manage'""")
def manageable_datasets(t):
    return access.visible_datasets(_members(t), _access(t), 7, manage=True)


@query("administered_datasets", f"""WITH {MEMBERS_SQL}
SELECT s_suppkey AS dataset_id FROM supplier WHERE s_nationkey IN (
  SELECT organization_id FROM members WHERE user_id = 8 AND role IN ('owner', 'admin'))""")
def administered_datasets(t):
    owned = t.read("supplier").select(F.col("s_suppkey").alias("dataset_id"),
                                      F.col("s_nationkey").alias("owner_organization_id"))
    return access.administered_datasets(_members(t), owned, 8)


@query("importable_datasets", f"""WITH {MEMBERS_SQL}, {ACCESS_SQL}
SELECT DISTINCT dataset_id FROM members JOIN access USING (organization_id)
WHERE user_id = 11 AND role <> 'viewer'""")
def importable_datasets(t):
    return access.importable_datasets(_members(t), _access(t), 11)


@query("private_facts", f"""WITH {MEMBERS_SQL}
SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey
WHERE c_nationkey IN (SELECT organization_id FROM members WHERE user_id = 3)""")
def private_facts(t):
    facts = t.read("orders").join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    facts = facts.select("o_orderkey", F.col("c_nationkey").alias("organization_id"))
    return access.restrict_to_organisation(facts, _members(t), 3).select("o_orderkey")


@query("user_organisations", f"""WITH {MEMBERS_SQL}
SELECT organization_id, n_name AS name, role FROM members JOIN nation ON n_nationkey = organization_id
WHERE user_id = 7""")
def user_organisations(t):
    named = t.read("nation").select(F.col("n_nationkey").alias("organization_id"),
                                    F.col("n_name").alias("name"))
    return access.organisations_of(_members(t), named, 7)


@query("accessible_datasets", f"""WITH {MEMBERS_SQL}, {ACCESS_SQL}
SELECT a.dataset_id, s_name AS name,
  CASE WHEN bool_or(access_level = 'manage') THEN 'manage' ELSE 'read' END AS access_level
FROM access a JOIN supplier ON s_suppkey = a.dataset_id
WHERE organization_id IN (SELECT organization_id FROM members WHERE user_id = 7) GROUP BY 1, 2""")
def accessible_datasets(t):
    named = t.read("supplier").select(F.col("s_suppkey").alias("dataset_id"),
                                      F.col("s_name").alias("name"))
    return access.accessible_datasets(_members(t), _access(t), named, 7)


# --- property lists ----------------------------------------------------------

_PAGE = f"""SELECT property_id, canonical_name, lifecycle_status,
  {stamp_sql('last_observed_at')} AS last_observed_at FROM props"""


def _page(df):
    return df.select("property_id", "canonical_name", "lifecycle_status",
                     stamp("last_observed_at").alias("last_observed_at"))


@query("property_page", f"""WITH {PROPERTIES_SQL}
{_PAGE} ORDER BY props.last_observed_at DESC NULLS LAST, property_id DESC LIMIT 26""")
def property_page(t):
    return _page(catalogue.keyset_page(
        catalogue.properties_of(t.properties, 1), "last_observed_at", "property_id", 25))


@query("property_page_after", f"""WITH {PROPERTIES_SQL}
{_PAGE} WHERE props.last_observed_at < TIMESTAMP '2024-05-01'
  OR (props.last_observed_at = TIMESTAMP '2024-05-01' AND property_id < 500)
ORDER BY props.last_observed_at DESC NULLS LAST, property_id DESC LIMIT 26""")
def property_page_after(t):
    after = catalogue.Cursor("2024-05-01 00:00:00", "500")
    return _page(catalogue.keyset_page(t.properties, "last_observed_at", "property_id", 25, after))


@query("property_list", f"""WITH {PROPERTIES_SQL}
SELECT property_id, canonical_name, n_name AS region_name FROM props
LEFT JOIN nation ON n_nationkey = region_id WHERE region_id = 3 AND lifecycle_status = 'confirmed_inactive'""")
def property_list(t):
    regions = t.read("nation").select(F.col("n_nationkey").alias("region_id"),
                                      F.col("n_name").alias("name"))
    found = catalogue.properties_of(t.properties, 1, region_id=3, status="confirmed_inactive")
    return catalogue.with_region_name(found, regions).select(
        "property_id", "canonical_name", "region_name")


@query("property_lookup", f"""WITH {PROPERTIES_SQL}
SELECT property_id, canonical_name, lifecycle_status FROM props WHERE property_id = 42""")
def property_lookup(t):
    return catalogue.by_id(t.properties, "property_id", 42).select(
        "property_id", "canonical_name", "lifecycle_status")


ROUND3 = "floor({0} * 1000.0 + 0.5) / 1000.0"


@query("map_points", f"""WITH {PROPERTIES_SQL}
SELECT property_id, {ROUND3.format('latitude')} AS latitude, {ROUND3.format('longitude')} AS longitude,
  lifecycle_status FROM props WHERE latitude IS NOT NULL""")
def map_points(t):
    return catalogue.map_points(t.properties).select(
        "property_id", "latitude", "longitude", "lifecycle_status")


@query("map_clusters", f"""WITH {PROPERTIES_SQL}
SELECT CAST(floor({ROUND3.format('latitude')} / 0.05) AS BIGINT) AS cell_lat,
  CAST(floor({ROUND3.format('longitude')} / 0.05) AS BIGINT) AS cell_lng, lifecycle_status, count(*) AS points
FROM props WHERE latitude IS NOT NULL GROUP BY ALL""")
def map_clusters(t):
    return catalogue.map_clusters(catalogue.map_points(t.properties), 0.05)


@query("map_radius_clusters")
def map_radius_clusters(t):
    """From the closest zoom to the one the map opens with; tests compare with the plain loop."""
    return clusters.radius_clusters(t.properties, range(9, clusters.TOP_ZOOM + 1))


@query("rich_property_filter", f"""WITH {PROPERTIES_SQL}
SELECT property_id FROM props WHERE lifecycle_status IN ('suspected_inactive', 'reactivated')
  AND price BETWEEN 900.5 AND 1500 AND bedrooms >= 10 AND region_id IN (
    SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""")
def rich_property_filter(t):
    from tidewatch.operators import insights

    nations = t.read("nation").select(
        (F.col("n_nationkey")).alias("region_id"), (F.col("n_regionkey") + 100).alias("parent_id"))
    roots = t.read("region").select((F.col("r_regionkey") + 100).alias("region_id"),
                                    F.lit(None).cast("int").alias("parent_id"))
    below = catalogue.region_closure(nations.unionByName(roots)).filter("ancestor_id = 102")
    return insights.rich_filter(
        t.properties, status=("suspected_inactive", "reactivated"), min_price=900.5, max_price=1500,
        min_bedrooms=10, regions=below).select("property_id")


@query("global_search", f"""WITH {PROPERTIES_SQL}
SELECT 'property' AS entity, CAST(property_id AS VARCHAR) AS id, name AS label FROM props
  WHERE contains(lower(name), 'ring')
UNION ALL SELECT 'source', CAST(s_suppkey AS VARCHAR), s_name FROM supplier WHERE contains(lower(s_name), 'ring')
UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), url FROM pages WHERE contains(lower(url), 'ring')
UNION ALL SELECT 'region', CAST(n_nationkey AS VARCHAR), n_name FROM nation WHERE contains(lower(n_name), 'ring')""")
def global_search(t):
    return catalogue.global_search("Ring", **_searched(t))


def _searched(t):
    return {"property": (t.properties, "property_id", ["name"]),
            "source": (t.read("supplier"), "s_suppkey", ["s_name"]),
            "page": (t.read("pages"), "page_id", ["url"]),
            "region": (t.read("nation"), "n_nationkey", ["n_name"])}


@query("indexed_search", f"""WITH {PROPERTIES_SQL}
SELECT 'property' AS entity, CAST(property_id AS VARCHAR) AS id, name AS label FROM props
  WHERE contains(lower(name), 'l ring')
UNION ALL SELECT 'source', CAST(s_suppkey AS VARCHAR), s_name FROM supplier WHERE contains(lower(s_name), 'l ring')
UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), url FROM pages WHERE contains(lower(url), 'l ring')
UNION ALL SELECT 'region', CAST(n_nationkey AS VARCHAR), n_name FROM nation WHERE contains(lower(n_name), 'l ring')""")
def indexed_search(t):
    folder = f"{checkpoint_dir(t.spark).rstrip('/')}/search-{uuid.uuid4().hex}"
    return search.SearchIndex(t.spark, folder, buckets=16).build(**_searched(t)).find("L ring")


@query("dataset_overview", f"""WITH {PROPERTIES_SQL}
SELECT dataset_id, count(*) AS properties, count(*) FILTER (lifecycle_status = 'active') AS active,
  count(*) FILTER (lifecycle_status = 'suspected_inactive') AS suspected,
  count(*) FILTER (lifecycle_status = 'confirmed_inactive') AS confirmed,
  (SELECT count(*) FROM events) AS events FROM props GROUP BY dataset_id""")
def dataset_overview(t):
    raised = t.events.select(F.lit(1).alias("dataset_id"))
    return catalogue.dataset_overview(t.properties, raised)


@query("watchlist_sizes", """SELECT c_custkey AS watchlist_id, count(o_orderkey) AS items FROM customer
LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def watchlist_sizes(t):
    lists = t.read("customer").select(F.col("c_custkey").alias("watchlist_id"))
    items = t.read("orders").select(F.col("o_custkey").alias("watchlist_id"))
    return catalogue.watchlist_sizes(lists, items)


@query("property_status", f"""WITH {LISTINGS_SQL}, marked AS (
  SELECT *, CASE listing_id % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'first_miss' WHEN 2 THEN 'suspected_inactive'
    WHEN 3 THEN 'confirmed_inactive' ELSE 'reactivated' END AS status FROM listings)
SELECT property_id % 20 AS property_id, count(*) AS listings,
  count(*) FILTER (status IN ('active', 'reactivated')) AS active_listings,
  CASE WHEN count(*) FILTER (status IN ('active', 'reactivated')) > 0 THEN 'active'
    ELSE max_by(status, (last_observed_at, listing_id)) END AS lifecycle_status,
  {stamp_sql('min(first_seen_at)')} AS first_observed_at, {stamp_sql('max(last_observed_at)')} AS last_observed_at
FROM marked GROUP BY 1""")
def property_status(t):
    k = F.col("listing_id")
    status = F.when(k % 5 == 0, "active").when(k % 5 == 1, "first_miss").when(
        k % 5 == 2, "suspected_inactive").when(k % 5 == 3, "confirmed_inactive").otherwise(
        "reactivated")
    marked = t.listings.withColumns({"status": status, "property_id": F.col("property_id") % 20})
    return catalogue.property_status(marked).withColumns({
        "first_observed_at": stamp("first_observed_at"),
        "last_observed_at": stamp("last_observed_at")})


# --- events ------------------------------------------------------------------

def stored_events(t):
    """All events with dataset, property and the review state of a review table."""
    rows = kept_events(t).withColumns({
        "dataset_id": F.lit(1), "property_id": F.col("listing_id") % 20})
    day = F.lit("2024-03-01").cast("timestamp")
    kind = F.col("listing_id") % 4
    reviews = rows.filter(kind != 0).select(
        "event_id", "dataset_id",
        F.explode(F.when(kind == 1, F.array(F.lit("reviewed"))).when(
            kind == 2, F.array(F.lit("dismissed"))).otherwise(
            F.array(F.lit("reviewed"), F.lit("dismissed")))).alias("action"),
        F.lit("u1").alias("actor"), day.alias("at"), F.lit("noise").alias("note"))
    return events.apply_reviews(rows, reviews), reviews


_REVIEWED_SQL = all_events_sql() + f""", reviewed AS (
  SELECT md5(dedupe_key) AS event_id, listing_id % 20 AS property_id, event_type, event_at, confidence,
    {TITLE_SQL} AS title, listing_id % 4 IN (1, 3) AS is_reviewed, listing_id % 4 IN (2, 3) AS dismissed,
    evidence_type, run_id, snapshot_id FROM evts)"""


@query("reviewed_events", f"""WITH {_REVIEWED_SQL}
SELECT event_id, is_reviewed, CASE WHEN dismissed THEN 'noise' END AS dismissal_reason FROM reviewed""")
def reviewed_events(t):
    return stored_events(t)[0].select("event_id", "is_reviewed", "dismissal_reason")


@query("pending_price_events", f"""WITH {_REVIEWED_SQL}
SELECT event_id, {stamp_sql('event_at')} AS event_at FROM reviewed
WHERE event_type = 'price_changed' AND NOT is_reviewed AND NOT dismissed
ORDER BY reviewed.event_at DESC, event_id DESC LIMIT 101""")
def pending_price_events(t):
    found = catalogue.events_of(stored_events(t)[0], 1, "price_changed", review="pending")
    return catalogue.keyset_page(found, "event_at", "event_id", 100).select(
        "event_id", stamp("event_at").alias("event_at"))


@query("review_audit", f"""WITH {_REVIEWED_SQL}
SELECT action, count(*) AS n FROM (
  SELECT 'event.reviewed' AS action FROM reviewed WHERE is_reviewed
  UNION ALL SELECT 'event.dismissed' FROM reviewed WHERE dismissed) GROUP BY 1""")
def review_audit(t):
    rows, reviews = stored_events(t)
    return events.review_audit(rows, reviews).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("property_timeline", f"""WITH {_REVIEWED_SQL}
SELECT event_id, event_type, {stamp_sql('event_at')} AS event_at, evidence_type, run_id,
  snapshot_id AS current_snapshot_id FROM reviewed WHERE property_id = 5""")
def property_timeline(t):
    rows = kept_events(t).withColumn("property_id", F.col("listing_id") % 20)
    evidence = events.evidence_table(rows)
    owners = rows.select("listing_id", "property_id").distinct()
    plain = events.event_table(rows.drop("property_id"), "d1", owners)
    return catalogue.timeline(plain, evidence, 5).select(
        "event_id", "event_type", stamp("event_at").alias("event_at"), "evidence_type", "run_id",
        "current_snapshot_id")


@query("newest_events", """SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500""")
def newest_events(t):
    return catalogue.newest(t.events, "ts", 500, "event_id").select("event_id", "event_type")


@query("organisation_leads", """SELECT o_orderkey AS lead_id FROM orders
WHERE o_custkey % 25 = 4 AND o_orderstatus = 'O'""")
def organisation_leads(t):
    leads = t.read("orders").select(
        F.col("o_orderkey").alias("lead_id"), (F.col("o_custkey") % 25).alias("organization_id"),
        F.col("o_orderstatus").alias("stage"), F.col("o_orderdate").alias("created_at"))
    return catalogue.leads_of(leads, 4, "O").select("lead_id")


@query("organisation_reports", """SELECT o_orderkey AS report_id FROM orders
WHERE o_custkey % 25 = 4 AND o_orderkey % 5 = 1""")
def organisation_reports(t):
    rows = t.read("orders").select(
        F.col("o_orderkey").alias("report_id"), (F.col("o_custkey") % 25).alias("organization_id"),
        (F.col("o_orderkey") % 5).alias("dataset_id"), F.col("o_orderdate").alias("created_at"))
    return catalogue.reports_of(rows, 4, 1).select("report_id")


@query("created_leads", """WITH asked AS (
  SELECT c_nationkey AS organization_id, l_partkey AS property_id, l_shipdate, l_orderkey * 10 + l_linenumber AS ev
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
firsts AS (SELECT organization_id, property_id, min_by(ev, (l_shipdate, ev)) AS source_event_id FROM asked GROUP BY 1, 2)
SELECT organization_id, property_id, source_event_id, property_id % 3 <> 0 AS created,
  CASE WHEN property_id % 3 = 0 THEN 'lead-' || organization_id || '-' || property_id
    ELSE sha256(concat_ws(chr(1), organization_id, property_id)) END AS lead_id FROM firsts""")
def created_leads(t):
    asked = t.read("lineitem").join(
        t.read("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(
        t.read("customer"), F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_nationkey").alias("organization_id"), F.col("l_partkey").alias("property_id"),
        F.col("l_shipdate").alias("requested_at"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_event_id"))
    known = asked.filter("property_id % 3 = 0").select("organization_id", "property_id").distinct(
    ).select(
        "organization_id", "property_id",
        F.concat_ws("-", F.lit("lead"), "organization_id", "property_id").alias("lead_id"))
    return catalogue.create_leads(asked, known).select(
        "organization_id", "property_id", "source_event_id", "created", "lead_id")


# --- reports -----------------------------------------------------------------

_CELL = ("CASE WHEN regexp_matches({0}, '^[=+\\-@\\t\\r]') THEN '''' || {0} ELSE {0} END")


@query("property_export", f"""WITH {PROPERTIES_SQL}
SELECT concat_ws(',', property_id, canonical_name, region_id, lifecycle_status, property_type,
  coalesce(strftime(last_observed_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z', '')) AS value
FROM props WHERE NOT archived AND region_id = 4""")
def property_export(t):
    return reports.csv_lines(reports.property_export(t.properties, 1, region_id=4))


@query("csv_cells", """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber % 3 = 0 THEN '''=1+' || l_partkey
    WHEN l_linenumber % 3 = 1 THEN '"say ""' || l_shipdate_text || '"", please"' ELSE '''-' || l_suppkey END
  || ',' || CASE WHEN l_discount = 0 THEN '' ELSE l_returnflag END AS value
FROM (SELECT *, strftime(l_shipdate, '%Y') AS l_shipdate_text FROM lineitem)""")
def csv_cells(t):
    from tidewatch.functions.csvcells import csv_line

    line = F.col("l_linenumber")
    cell = F.when(line % 3 == 0, F.concat(F.lit("=1+"), F.col("l_partkey").cast("string"))).when(
        line % 3 == 1, F.concat(F.lit('say "'), F.date_format("l_shipdate", "yyyy"),
                                F.lit('", please'))).otherwise(
        (F.lit(0) - F.col("l_suppkey")).cast("string"))
    # -0 prints as 0, so a zero key keeps its sign by text.
    cell = F.when((line % 3 == 2) & (F.col("l_suppkey") == 0), "-0").otherwise(cell)
    flag = F.when(F.col("l_discount") != 0, F.col("l_returnflag"))
    return t.read("lineitem").select("l_orderkey", "l_linenumber",
                                     csv_line(cell, flag).alias("value"))


@query("watchlist_summary", f"""WITH {PROPERTIES_SQL}
SELECT property_id AS id, canonical_name, lifecycle_status FROM props
JOIN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 3) ON l_partkey = property_id""")
def watchlist_summary(t):
    items = t.read("lineitem").select(F.col("l_suppkey").alias("watchlist_id"),
                                      F.col("l_partkey").alias("property_id"))
    return reports.watchlist_summary(items, t.properties, 3).drop("last_observed_at")


@query("event_digest", f"""WITH {_REVIEWED_SQL}
SELECT event_type, title, {stamp_sql('event_at')} AS event_at, confidence FROM reviewed
WHERE NOT dismissed""")
def event_digest(t):
    return reports.event_digest(stored_events(t)[0], 1).withColumn("event_at", stamp("event_at"))
