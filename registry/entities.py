"""Merging, splitting, rolling back and ranking properties."""

from pyspark.sql import functions as F

from registry import query
from registry.tables import PROPERTIES_SQL, stamp, stamp_sql
from tidewatch.operators import matching, resolution

# Every even property merges into its right-hand neighbour.
MERGES_SQL = """merges AS (SELECT p_partkey AS from_property_id, p_partkey + 1 AS to_property_id FROM part
  WHERE p_partkey % 2 = 0 AND p_partkey + 1 < (SELECT count(*) FROM part))"""


def _merges(t):
    k = F.col("p_partkey")
    parts = t.read("part")
    return parts.filter((k % 2 == 0) & (k + 1 < parts.count())).select(
        k.alias("from_property_id"), (k + 1).alias("to_property_id"), F.lit("same").alias("reason"))


def _listings(t):
    """One listing per order: property, times, title."""
    k = F.col("o_orderkey")
    parts = t.read("part").count()
    day = F.col("o_orderdate").cast("timestamp")
    return t.read("orders").select(
        k.alias("listing_id"), (k % parts).alias("property_id"), F.lit(1).alias("dataset_id"),
        day.alias("first_seen_at"), (day + F.make_dt_interval(days=(k % 30).cast("int")))
        .alias("last_observed_at"),
        F.when(k % 3 != 0, F.concat(F.lit("Order "), k.cast("string"))).alias("current_title"),
        F.concat(F.lit("x"), k.cast("string")).alias("external_id"))


LISTINGS_OF_ORDERS_SQL = """listings AS (
  SELECT o_orderkey AS listing_id, o_orderkey % (SELECT count(*) FROM part) AS property_id,
    o_orderdate AS first_seen_at, o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) AS last_observed_at,
    CASE WHEN o_orderkey % 3 <> 0 THEN 'Order ' || o_orderkey END AS current_title,
    'x' || o_orderkey AS external_id FROM orders)"""


# One request per part, of every kind: into itself, into nothing, into another dataset, twice from one
# source, into a property that is merged away, and sound ones.
@query("merge_problems", f"""WITH {PROPERTIES_SQL},
sets AS (SELECT property_id, CASE WHEN property_id % 16 = 6 THEN 2 ELSE 1 END AS dataset FROM props),
asked AS (SELECT CASE WHEN p_partkey % 8 = 5 THEN p_partkey - 1 ELSE p_partkey END AS from_property_id,
  CASE p_partkey % 8 WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey + 1000000 WHEN 2 THEN p_partkey - p_partkey % 16 + 6
    WHEN 3 THEN p_partkey - 1 WHEN 6 THEN p_partkey - 1 WHEN 7 THEN p_partkey - 2 ELSE p_partkey + 1 END AS to_property_id FROM part),
sources AS (SELECT from_property_id, count(*) AS times FROM asked GROUP BY 1)
SELECT a.from_property_id, a.to_property_id, CASE
    WHEN a.from_property_id = a.to_property_id THEN 'cannot merge a property into itself'
    WHEN f.property_id IS NULL OR t.property_id IS NULL THEN 'both properties must exist'
    WHEN f.dataset <> t.dataset THEN 'properties belong to different datasets'
    WHEN times > 1 THEN 'property merged twice in one batch'
    WHEN a.to_property_id IN (SELECT from_property_id FROM asked) THEN 'merge target is itself merged in this batch'
  END AS problem
FROM asked a JOIN sources USING (from_property_id) LEFT JOIN sets f ON f.property_id = a.from_property_id
LEFT JOIN sets t ON t.property_id = a.to_property_id""")
def merge_problems(t):
    k = F.col("p_partkey")
    kind = k % 8
    target = (F.when(kind == 0, k).when(kind == 1, k + 1000000).when(kind == 2, k - k % 16 + 6).when(kind == 3, k - 1)
              .when(kind == 6, k - 1).when(kind == 7, k - 2).otherwise(k + 1))
    asked = t.read("part").select(F.when(kind == 5, k - 1).otherwise(k).alias("from_property_id"),
                                  target.alias("to_property_id"))
    properties = t.properties.withColumn("dataset_id", F.when(F.col("property_id") % 16 == 6, 2).otherwise(1))
    return resolution.check_merges(asked, properties).select(
        "from_property_id", "to_property_id", "problem")


@query("merged_listings", f"""WITH {LISTINGS_OF_ORDERS_SQL}, {MERGES_SQL}
SELECT listing_id, coalesce(to_property_id, property_id) AS property_id
FROM listings LEFT JOIN merges ON from_property_id = property_id""")
def merged_listings(t):
    return resolution.redirect_facts(_listings(t), _merges(t)).select("listing_id", "property_id")


@query("merge_redirects", f"""WITH {LISTINGS_OF_ORDERS_SQL}, {MERGES_SQL}
SELECT from_property_id, to_property_id, 'merge' AS kind, count(listing_id) AS moved_count,
  '{{"to_property_id":' || to_property_id || ',"reason":"same","moved_count":' || count(listing_id) || '}}' AS audit
FROM merges LEFT JOIN listings ON property_id = from_property_id GROUP BY 1, 2""")
def merge_redirects(t):
    merges = _merges(t)
    redirects = resolution.merge_redirects(merges, resolution.merge_moves(merges, _listings(t)))
    audit = resolution.merge_audit(redirects).select(
        F.col("target_id").cast("bigint").alias("from_property_id"),
        F.col("metadata").alias("audit"))
    return redirects.select("from_property_id", "to_property_id", "kind", "moved_count").join(
        audit, "from_property_id")


@query("merged_windows", f"""WITH {LISTINGS_OF_ORDERS_SQL}, {MERGES_SQL}, {PROPERTIES_SQL},
moved AS (SELECT coalesce(to_property_id, property_id) AS property_id, first_seen_at, last_observed_at
  FROM listings LEFT JOIN merges ON from_property_id = property_id),
spans AS (SELECT property_id, min(first_seen_at) AS f, max(last_observed_at) AS l FROM moved
  WHERE property_id IN (SELECT to_property_id FROM merges) GROUP BY 1)
SELECT property_id, {stamp_sql("least(TIMESTAMP '2024-01-01', f)")} AS first_observed_at,
  {stamp_sql('greatest(last_observed_at, l)')} AS last_observed_at,
  property_id IN (SELECT from_property_id FROM merges) AS archived
FROM props LEFT JOIN spans USING (property_id)""")
def merged_windows(t):
    merges = _merges(t)
    moved = resolution.redirect_facts(_listings(t), merges)
    start = F.lit("2024-01-01").cast("timestamp")
    properties = t.properties.withColumns({
        "first_observed_at": start, "archived_at": F.lit(None).cast("timestamp")})
    refreshed = resolution.refresh_windows(properties, moved, merges)
    return resolution.archive_sources(refreshed, merges, start).select(
        "property_id", stamp("first_observed_at").alias("first_observed_at"),
        stamp("last_observed_at").alias("last_observed_at"),
        F.col("archived_at").isNotNull().alias("archived"))


@query("split_properties", f"""WITH {LISTINGS_OF_ORDERS_SQL}
SELECT listing_id, sha256(concat_ws(chr(1), 'split', listing_id)) AS property_id,
  property_id AS from_property_id, coalesce(current_title, 'Listing ' || external_id) AS canonical_name,
  {stamp_sql('first_seen_at')} AS first_observed_at, 'split' AS kind FROM listings""")
def split_properties(t):
    splits = t.read("orders").select(
        F.col("o_orderkey").alias("listing_id"), F.lit("wrong").alias("reason"))
    return resolution.split_properties(_listings(t), splits).select(
        "listing_id", "property_id", "from_property_id", "canonical_name",
        stamp("first_observed_at").alias("first_observed_at"), "kind")


def _rolled_back(t):
    merges = _merges(t)
    listings = _listings(t)
    moves = resolution.merge_moves(merges, listings)
    redirects = resolution.merge_redirects(merges, moves)
    after = resolution.redirect_facts(listings, merges)
    chosen = redirects.filter("from_property_id = 16").select("redirect_id").head()[0]
    return after, redirects, moves, chosen


@query("rolled_back_merge", f"""WITH {LISTINGS_OF_ORDERS_SQL}, {MERGES_SQL}
SELECT listing_id, CASE WHEN property_id = 16 THEN 16 ELSE coalesce(to_property_id, property_id) END AS property_id
FROM listings LEFT JOIN merges ON from_property_id = property_id""")
def rolled_back_merge(t):
    after, redirects, moves, chosen = _rolled_back(t)
    back = resolution.rollback_moves(redirects, moves, chosen)
    return resolution.move_listings(after, back).select("listing_id", "property_id")


@query("incoming_merges", f"""WITH {MERGES_SQL}
SELECT from_property_id, to_property_id FROM merges WHERE to_property_id = 17""")
def incoming_merges(t):
    merges = _merges(t).withColumns({
        "kind": F.lit("merge"), "created_at": F.lit("2024-01-01").cast("timestamp")})
    return resolution.incoming_merges(merges, 17).select("from_property_id", "to_property_id")


_SCORES_SQL = PROPERTIES_SQL + """,
target AS (SELECT * FROM props WHERE property_id = 5),
pairs AS (
  SELECT c.property_id, c.bedrooms, t.bedrooms AS t_bedrooms,
    trim(regexp_replace(lower(c.name), '[^a-z0-9]+', ' ', 'g')) AS a,
    trim(regexp_replace(lower(t.name), '[^a-z0-9]+', ' ', 'g')) AS b,
    pow(sin(radians(c.latitude - t.latitude) / 2), 2) + cos(radians(t.latitude)) * cos(radians(c.latitude))
      * pow(sin(radians(c.longitude - t.longitude) / 2), 2) AS h
  FROM props c, target t WHERE c.property_id <> 5),
scored AS (
  SELECT *, CASE WHEN h IS NOT NULL THEN 2 * 6371000 * asin(least(1.0, sqrt(h))) END AS distance_m,
    1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) AS similarity FROM pairs),
ranked AS (SELECT *, CASE WHEN distance_m IS NULL THEN similarity
    ELSE similarity * 0.7 + greatest(0, 1 - distance_m / 5000) * 0.3 END AS score FROM scored)"""


@query("merge_candidates", f"""WITH {_SCORES_SQL}
SELECT property_id, round(similarity, 6) AS similarity, round(distance_m, 2) AS distance_m,
  round(score, 6) AS score FROM ranked""")
def merge_candidates(t):
    return resolution.rank_candidates(t.properties, 5).select(
        "property_id", F.round("similarity", 6).alias("similarity"),
        F.round("distance_m", 2).alias("distance_m"), F.round("score", 6).alias("score"))


def _contacts(t):
    k = F.col("property_id")
    return t.properties.withColumns({
        "official_website": F.concat(F.lit("https://www.Villa"), (k % 13).cast("string"),
                                     F.lit(".example/a?b=1")),
        "business_whatsapp": F.concat(F.lit("+62 81-"), (k % 19).cast("string")),
    })


@query("merge_candidate_reasons", f"""WITH {_SCORES_SQL}
SELECT property_id, concat_ws(',', CASE WHEN similarity >= 0.85 THEN 'similar_name' END,
  CASE WHEN distance_m <= 250 THEN 'near' END,
  CASE WHEN property_id % 13 = 5 THEN 'same_domain' END,
  CASE WHEN property_id % 19 = 5 THEN 'same_phone' END,
  CASE WHEN bedrooms = t_bedrooms THEN 'same_bedrooms' END) AS reasons FROM ranked""")
def merge_candidate_reasons(t):
    properties = _contacts(t)
    rooms = properties.filter("property_id = 5").select("bedrooms").head()[0]
    ranked = resolution.rank_candidates(properties, 5)
    return resolution.candidate_reasons(
        ranked, "http://villa5.example", "62815", rooms).select(
        "property_id", F.array_join("reasons", ",").alias("reasons"))


@query("all_merge_candidates", f"""WITH {PROPERTIES_SQL},
n AS (SELECT property_id, latitude, longitude, bedrooms,
    trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS a FROM props),
pairs AS (
  SELECT x.property_id, y.property_id AS candidate_id, x.bedrooms = y.bedrooms AS same_rooms,
    1 - levenshtein(x.a, y.a) / CAST(greatest(length(x.a), length(y.a)) AS DOUBLE) AS similarity,
    pow(sin(radians(y.latitude - x.latitude) / 2), 2) + cos(radians(x.latitude)) * cos(radians(y.latitude))
      * pow(sin(radians(y.longitude - x.longitude) / 2), 2) AS h
  FROM n x JOIN n y ON x.property_id <> y.property_id),
measured AS (SELECT *, CASE WHEN h IS NOT NULL THEN 2 * 6371000 * asin(least(1.0, sqrt(h))) END AS distance_m
  FROM pairs),
scored AS (SELECT *, CASE WHEN distance_m IS NULL THEN similarity
    ELSE similarity * 0.7 + greatest(0, 1 - distance_m / 5000) * 0.3 END AS score FROM measured),
ranked AS (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY score DESC, candidate_id) AS rank
  FROM scored WHERE score >= 0.75)
SELECT property_id, candidate_id, CAST(rank AS INTEGER) AS rank, round(similarity, 6) AS similarity,
  round(distance_m, 2) AS distance_m, round(score, 6) AS score,
  concat_ws(',', CASE WHEN similarity >= 0.85 THEN 'similar_name' END,
    CASE WHEN distance_m <= 250 THEN 'near' END,
    CASE WHEN property_id % 13 = candidate_id % 13 THEN 'same_domain' END,
    CASE WHEN property_id % 19 = candidate_id % 19 THEN 'same_phone' END,
    CASE WHEN same_rooms THEN 'same_bedrooms' END) AS reasons
FROM ranked WHERE rank <= 10""")
def all_merge_candidates(t):
    return matching.candidates_with_reasons(_contacts(t), 0.75, 10).select(
        "property_id", "candidate_id", "rank", F.round("similarity", 6).alias("similarity"),
        F.round("distance_m", 2).alias("distance_m"), F.round("score", 6).alias("score"),
        F.array_join("reasons", ",").alias("reasons"))
