"""Collections: grid, discoveries, outcomes, checksums, verification, pages."""

import uuid

from pyspark.sql import functions as F

from registry import query
from registry.tables import DISCOVERIES_SQL
from tidewatch.operators import market
from tidewatch.session import checkpoint_dir
from tidewatch.sinks.keyed import KeyedTable
from tidewatch.sources import pages as html

FIELDS = ("title", "area", "rating", "review_count", "displayed_price", "currency")

AREAS_SQL = """areas AS (
  SELECT s_suppkey AS area_key, 14 AS zoom,
    -8.2 - (s_suppkey % 60) / 100.0 AS lat, 114.8 + (s_suppkey % 70) / 100.0 AS lng,
    0.012 + (s_suppkey % 5) / 100.0 AS lat_half, 0.012 + (s_suppkey % 7) / 200.0 AS lng_half FROM supplier),
boxes AS (SELECT area_key, zoom, floor((lat + lat_half) * 1e6 + 0.5) / 1e6 AS north,
    floor((lat - lat_half) * 1e6 + 0.5) / 1e6 AS south, floor((lng + lng_half) * 1e6 + 0.5) / 1e6 AS east,
    floor((lng - lng_half) * 1e6 + 0.5) / 1e6 AS west FROM areas),
sized AS (SELECT *, abs(north - south) AS tall, abs(east - west) AS wide,
    CAST(least(greatest(ceil(abs(north - south) / CAST(0.03 AS DOUBLE)), 1), 8) AS BIGINT) AS n_rows,
    CAST(least(greatest(ceil(abs(east - west) / CAST(0.03 AS DOUBLE)), 1), 8) AS BIGINT) AS n_cols FROM boxes),
grid AS (SELECT area_key, zoom, r.v AS grid_row, c.v AS grid_col,
    south + r.v * (tall / n_rows) AS s, west + c.v * (wide / n_cols) AS w, tall / n_rows AS h, wide / n_cols AS b
  FROM sized, range(8) r(v), range(8) c(v) WHERE r.v < n_rows AND c.v < n_cols),
cells AS (SELECT area_key, zoom, grid_row, grid_col, floor(s * 1e6 + 0.5) / 1e6 AS south,
    floor((s + h) * 1e6 + 0.5) / 1e6 AS north, floor(w * 1e6 + 0.5) / 1e6 AS west,
    floor((w + b) * 1e6 + 0.5) / 1e6 AS east FROM grid)"""


def _cells(t):
    k = F.col("s_suppkey")
    box = market.centred_box(
        F.lit(-8.2) - (k % 60) / F.lit(100.0), F.lit(114.8) + (k % 70) / F.lit(100.0),
        F.lit(0.012) + (k % 5) / F.lit(100.0), F.lit(0.012) + (k % 7) / F.lit(200.0))
    areas = t.read("supplier").select(
        k.alias("area_key"), F.lit(14).alias("zoom"), *[v.alias(n) for n, v in box.items()])
    return market.subdivide(areas)


@query("search_cells", f"WITH {AREAS_SQL} SELECT * FROM cells")
def search_cells(t):
    return _cells(t)


@query("points_in_cells", f"""WITH {AREAS_SQL}, points AS (
  SELECT c_custkey AS point_id, -8.2 - (c_custkey % 613) / 1000.0 AS latitude,
    114.8 + (c_custkey % 701) / 1000.0 AS longitude FROM customer)
SELECT point_id, area_key, grid_row, grid_col FROM points JOIN cells
ON south <= latitude AND latitude < north AND west <= longitude AND longitude < east""")
def points_in_cells(t):
    k = F.col("c_custkey")
    points = t.read("customer").select(
        k.alias("point_id"), (F.lit(-8.2) - (k % 613) / F.lit(1000.0)).alias("latitude"),
        (F.lit(114.8) + (k % 701) / F.lit(1000.0)).alias("longitude"))
    return market.assign_cells(points, _cells(t)).select(
        "point_id", "area_key", "grid_row", "grid_col")


# --- discoveries -------------------------------------------------------------

def _held(c: str) -> str:
    return f"min_by({c}, (seq, {c})) FILTER ({c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '') AS {c}"


_UNIQUE_SQL = DISCOVERIES_SQL + f""",
uniq AS (
  SELECT source_listing_id, count(*) AS discovery_count, min(seq) AS first_seq,
    {', '.join(_held(c) for c in FIELDS)} FROM disc GROUP BY 1)"""


def _unique(t):
    return market.dedupe_discoveries(t.discoveries, FIELDS)


@query("deduped_discoveries", f"""WITH {_UNIQUE_SQL}, found AS (
  SELECT source_listing_id, cell_id, min(seq) AS s FROM disc GROUP BY 1, 2),
places AS (SELECT source_listing_id, string_agg(CAST(cell_id AS VARCHAR), ',' ORDER BY s, cell_id) AS discovery_cells
  FROM found GROUP BY 1)
SELECT uniq.*, discovery_cells FROM uniq JOIN places USING (source_listing_id)""")
def deduped_discoveries(t):
    return _unique(t).withColumn(
        "discovery_cells", F.array_join("discovery_cell_ids", ",")).drop("discovery_cell_ids")


@query("discovery_metrics", """SELECT count(*) AS total_discoveries,
  count(DISTINCT l_partkey) AS unique_listings, count(*) - count(DISTINCT l_partkey) AS duplicate_discoveries
FROM lineitem""")
def discovery_metrics(t):
    return market.discovery_metrics(_unique(t))


_KEPT = "(rating IS NULL OR rating >= 3.5) AND (review_count IS NULL OR review_count >= 10)"


@query("cell_discoveries", f"""WITH {DISCOVERIES_SQL}
SELECT cell_id, count(*) AS listings_discovered FROM disc WHERE {_KEPT} GROUP BY 1""")
def cell_discoveries(t):
    return market.cell_discoveries(t.discoveries.filter(market.passes_filters(3.5, 10)))


@query("capped_discoveries", f"""WITH {DISCOVERIES_SQL}, firsts AS (
  SELECT source_listing_id, min(seq) AS s FROM disc WHERE {_KEPT} GROUP BY 1 ORDER BY s, 1 LIMIT 300)
SELECT source_listing_id, count(*) AS discoveries FROM disc
WHERE {_KEPT} AND source_listing_id IN (SELECT source_listing_id FROM firsts) GROUP BY 1""")
def capped_discoveries(t):
    kept = t.discoveries.filter(market.passes_filters(3.5, 10))
    return market.within_cap(kept, 300).groupBy("source_listing_id").agg(
        F.count(F.lit(1)).alias("discoveries"))


@query("listing_fingerprints", f"""WITH {_UNIQUE_SQL}
SELECT source_listing_id, concat_ws('|', source_listing_id,
  coalesce(CASE WHEN rating = floor(rating) THEN CAST(CAST(rating AS BIGINT) AS VARCHAR)
    ELSE CAST(rating AS VARCHAR) END, ''), coalesce(CAST(review_count AS VARCHAR), ''),
  displayed_price, coalesce(currency, '')) AS fingerprint FROM uniq""")
def listing_fingerprints(t):
    return _unique(t).select("source_listing_id",
                             market.listing_fingerprint().alias("fingerprint"))


def _order_fingerprints(t):
    """Each order is a small market: its lines are the listings."""
    return t.read("lineitem").select(
        F.col("l_suppkey").alias("collection_id"), F.concat_ws(
            "|", "l_orderkey", "l_linenumber", F.lit(""), F.col("l_quantity").cast("int"),
            "l_returnflag").alias("fingerprint"))


_SLICE = "CAST(sum(('0x' || substr(sha256(fingerprint), {0}, 12))::BIGINT) AS VARCHAR)"


@query("market_checksums", f"""WITH rows AS (SELECT l_suppkey AS collection_id, concat_ws('|', l_orderkey, l_linenumber, '',
    CAST(l_quantity AS INTEGER), l_returnflag) AS fingerprint FROM lineitem)
SELECT collection_id, count(*) AS listings, sha256(concat_ws(':', count(*),
  {_SLICE.format(1)}, {_SLICE.format(13)}, {_SLICE.format(25)}, {_SLICE.format(37)})) AS checksum
FROM rows GROUP BY 1""")
def market_checksums(t):
    return market.multiset_checksum(_order_fingerprints(t), ["collection_id"])


@query("market_checksums_fnv", """WITH rows AS (SELECT CAST(l_suppkey AS VARCHAR) AS collection_id, concat_ws('|', l_orderkey, l_linenumber, '',
    CAST(l_quantity AS INTEGER), l_returnflag) AS fingerprint FROM lineitem),
joined AS (SELECT collection_id, string_agg(fingerprint, chr(10) ORDER BY fingerprint) AS s FROM rows GROUP BY 1),
hashed AS (SELECT collection_id, list_reduce(list_prepend(CAST('14695981039346656037' AS HUGEINT),
    list_transform(string_split(s, ''), lambda c: CAST(ascii(c) AS HUGEINT))),
    lambda h, c: (xor(h, c) * CAST(1099511628211 AS HUGEINT)) % CAST('18446744073709551616' AS HUGEINT)) AS h FROM joined)
SELECT collection_id, printf('%016x', CAST(h AS UBIGINT)) AS checksum FROM hashed""")
def market_checksums_fnv(t):
    return market.fnv_checksum(_order_fingerprints(t))


# --- outcomes: an order is a collection, its lines are cells and listings --------

_OUTCOME_SQL = """cells AS (
  SELECT l_orderkey AS collection_id, CASE WHEN l_suppkey % 9 = 0 THEN 'failed'
    WHEN l_suppkey % 11 = 0 THEN 'pending' ELSE 'completed' END AS status FROM lineitem),
seen AS (SELECT l_orderkey AS collection_id, count(*) AS unique_listings, bool_or(l_partkey % 4 = 0) AS pending
  FROM lineitem GROUP BY 1),
counted AS (SELECT collection_id, count(*) AS planned, count(*) FILTER (status = 'completed') AS completed,
    count(*) FILTER (status = 'failed') AS failed FROM cells GROUP BY 1),
base AS (
  SELECT o_orderkey AS collection_id, o_orderstatus = 'P' AS blocked, o_custkey % 3 % 2 AS errors,
    o_orderkey % 2 = 0 AS details_required, coalesce(planned, 0) AS planned, coalesce(completed, 0) AS completed,
    coalesce(failed, 0) AS failed, coalesce(unique_listings, 0) AS unique_listings, coalesce(pending, false) AS pending
  FROM orders LEFT JOIN counted ON collection_id = o_orderkey LEFT JOIN seen USING (collection_id)),
rated AS (
  SELECT *, CASE WHEN planned <= 0 THEN 0 ELSE completed / CAST(planned AS DOUBLE) END AS coverage FROM base),
judged AS (SELECT *, CASE WHEN planned <= 0 OR completed <= 0 THEN 'failed'
    WHEN completed >= planned AND failed = 0 AND errors = 0 THEN
      CASE WHEN blocked OR (details_required AND pending) THEN 'partial' ELSE 'complete' END
    WHEN coverage < 0.5 OR failed >= completed THEN 'degraded' ELSE 'partial' END AS quality_status FROM rated)"""


@query("collection_outcomes", f"""WITH {_OUTCOME_SQL}
SELECT collection_id, planned, completed, failed, unique_listings, quality_status,
  round(coverage, 6) AS search_cell_coverage, CAST(floor(coverage * 100 + 0.5) AS INTEGER) AS completion_percentage,
  completed > 0 AS creates_snapshot, CASE WHEN blocked THEN 'manual_action_required'
    WHEN quality_status = 'failed' THEN 'failed' WHEN quality_status = 'complete' THEN 'completed'
    ELSE 'partial' END AS final_state FROM judged""")
def collection_outcomes(t):
    lines = t.read("lineitem")
    supplier = F.col("l_suppkey")
    cells = lines.select(F.col("l_orderkey").alias("collection_id"), F.when(
        supplier % 9 == 0, "failed").when(supplier % 11 == 0, "pending").otherwise("completed")
        .alias("status"))
    seen = lines.select(F.col("l_orderkey").alias("collection_id"),
                        (F.col("l_partkey") % 4 != 0).alias("detail_collected"))
    collections = t.read("orders").select(
        F.col("o_orderkey").alias("collection_id"), (F.col("o_orderstatus") == "P").alias("blocked"),
        (F.col("o_custkey") % 3 % 2).alias("errors"),
        (F.col("o_orderkey") % 2 == 0).alias("details_required"))
    return market.finalise(collections, cells, seen).select(
        "collection_id", "planned", "completed", "failed", "unique_listings", "quality_status",
        F.round("search_cell_coverage", 6).alias("search_cell_coverage"), "completion_percentage",
        "creates_snapshot", "final_state")


def _stored(t):
    """Observations stored earlier: parts with an even key."""
    k = F.col("p_partkey")
    return t.read("part").filter(k % 2 == 0).select(
        F.lit("c1").alias("collection_id"), k.cast("string").alias("source_listing_id"),
        F.when(k % 3 == 0, F.col("p_name")).alias("title"), F.col("p_brand").alias("area"),
        F.when(k % 5 == 0, F.lit(4.5)).alias("rating"),
        F.lit(None).cast("bigint").alias("review_count"),
        F.array((k % 7).cast("bigint")).alias("discovery_cell_ids"),
        F.lit(2).cast("bigint").alias("discovery_count"))


@query("upserted_observations", f"""WITH {_UNIQUE_SQL}, old AS (
  SELECT CAST(p_partkey AS VARCHAR) AS source_listing_id, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS title,
    p_brand AS area, CASE WHEN p_partkey % 5 = 0 THEN 4.5 END AS rating, p_partkey % 7 AS cell
  FROM part WHERE p_partkey % 2 = 0),
places AS (SELECT source_listing_id, list(DISTINCT cell_id) AS cells FROM disc GROUP BY 1)
SELECT source_listing_id, coalesce(old.title, uniq.title) AS title,
  CASE WHEN old.cell IS NOT NULL THEN old.area ELSE uniq.area END AS area,
  coalesce(old.rating, uniq.rating) AS rating, uniq.review_count,
  CASE WHEN old.cell IS NULL THEN 0 ELSE 2 END + coalesce(discovery_count, 0) AS discovery_count,
  CAST(CASE WHEN old.cell IS NULL THEN len(cells) WHEN cells IS NULL THEN 1
    WHEN list_contains(cells, old.cell) THEN len(cells) ELSE len(cells) + 1 END AS INTEGER) AS n_cells
FROM old FULL JOIN uniq USING (source_listing_id) LEFT JOIN places USING (source_listing_id)""")
def upserted_observations(t):
    found = _unique(t).withColumn("collection_id", F.lit("c1"))
    folder = f"{checkpoint_dir(t.spark).rstrip('/')}/observations-{uuid.uuid4().hex}"
    table = KeyedTable(t.spark, folder, ["collection_id", "source_listing_id"], buckets=8, blooms=False)
    table.upsert(_stored(t))
    table.upsert(found, market.upsert_observations)
    return table.read().select(
        "source_listing_id", "title", "area", "rating", "review_count", "discovery_count",
        F.size("discovery_cell_ids").alias("n_cells"))


@query("detail_progress", """WITH marked AS (
  SELECT l_orderkey AS collection_id, CASE WHEN l_partkey % 3 = 0 THEN 'collected'
    WHEN l_partkey % 3 = 1 THEN 'unavailable' END AS status FROM lineitem)
SELECT collection_id, count(*) FILTER (status = 'collected') AS detail_pages_completed,
  bool_or(status IS DISTINCT FROM 'collected') AS details_pending,
  count(*) FILTER (status = 'unavailable') AS detail_warnings FROM marked GROUP BY 1""")
def detail_progress(t):
    key = F.concat_ws("-", "l_partkey", "l_linenumber")
    stored = t.read("lineitem").select(
        F.col("l_orderkey").alias("collection_id"), key.alias("source_listing_id"),
        F.lit(False).alias("detail_collected"), F.lit(None).cast("string").alias("detail_observed_status"),
        F.lit(None).cast("string").alias("detail"), "l_partkey")
    visited = stored.filter("l_partkey % 3 < 2").dropDuplicates(
        ["collection_id", "source_listing_id"]).select(
        "collection_id", "source_listing_id", F.when(F.col("l_partkey") % 3 == 0, "collected")
        .otherwise("unavailable").alias("observed_status"), F.lit("{}").alias("detail"))
    return market.detail_progress(market.mark_details(stored, visited))


_VERIFY_SQL = """pages_seen AS (
  SELECT l_orderkey AS collection_id, l_linenumber AS seq, l_partkey, CASE
    WHEN l_suppkey % 40 = 7 THEN 'captcha' WHEN l_suppkey % 40 = 9 THEN 'login_challenge'
    WHEN l_suppkey % 10 = 1 THEN 'no_results' WHEN l_suppkey % 20 = 3 THEN 'navigation_error' ELSE 'ok' END AS state,
    CASE l_partkey % 4 WHEN 0 THEN 'not_found' WHEN 1 THEN 'unavailable' ELSE 'collected' END AS observed
  FROM lineitem),
stops AS (SELECT collection_id, min(seq) AS stop FROM pages_seen
  WHERE state NOT IN ('ok', 'no_results') GROUP BY 1),
verified AS (SELECT p.*, CASE WHEN state = 'ok' AND observed = 'collected' THEN 'active'
    WHEN state = 'ok' AND observed = 'not_found' THEN 'not_found' WHEN state IN ('ok', 'no_results') THEN 'unavailable'
    WHEN state = 'login_challenge' THEN 'login_required' WHEN state = 'captcha' THEN 'blocked'
    ELSE 'source_error' END AS status
  FROM pages_seen p LEFT JOIN stops USING (collection_id) WHERE stop IS NULL OR seq <= stop)"""


def _verified(t):
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    state = F.when(s % 40 == 7, "captcha").when(s % 40 == 9, "login_challenge").when(
        s % 10 == 1, "no_results").when(s % 20 == 3, "navigation_error").otherwise("ok")
    rows = t.read("lineitem").select(
        F.col("l_orderkey").alias("collection_id"), F.col("l_linenumber").alias("seq"),
        F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_shipdate").alias("source_listing_id"),
        state.alias("state"), F.when(p % 4 == 0, "not_found").when(p % 4 == 1, "unavailable")
        .otherwise("collected").alias("observed_status"))
    # A page that failed to load leaves no visit behind.
    visits = rows.filter("state <> 'navigation_error'").dropDuplicates(
        ["collection_id", "source_listing_id"])
    return market.verify_listings(rows.select("collection_id", "seq", "source_listing_id"), visits)


@query("verified_listings", f"""WITH {_VERIFY_SQL}
SELECT collection_id, seq, state, status FROM verified""")
def verified_listings(t):
    return _verified(t).select("collection_id", "seq", "state", "status")


@query("verification_outcomes", f"""WITH {_VERIFY_SQL}
SELECT collection_id, count(*) AS verified, bool_or(state NOT IN ('ok', 'no_results')) AS blocked,
  CASE WHEN bool_or(state NOT IN ('ok', 'no_results')) THEN 'manual_action_required' ELSE 'completed' END AS final_state
FROM verified GROUP BY 1""")
def verification_outcomes(t):
    return market.verification_summary(_verified(t)).drop("manual_action_reason")


@query("snapshot_comparison", f"""WITH {DISCOVERIES_SQL},
a AS (SELECT source_listing_id, min_by(rating, seq) FILTER (rating IS NOT NULL) AS rating FROM disc WHERE cell_id % 3 <> 0 GROUP BY 1),
b AS (SELECT source_listing_id, min_by(rating, seq) FILTER (rating IS NOT NULL) AS rating FROM disc WHERE cell_id % 3 <> 1 GROUP BY 1),
both_sides AS (SELECT a.source_listing_id AS x, b.source_listing_id AS y, a.rating IS DISTINCT FROM b.rating AS differs
  FROM a FULL JOIN b USING (source_listing_id))
SELECT count(x) AS previous_total, count(y) AS current_total, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS in_both,
  count(*) FILTER (y IS NULL) AS only_previous, count(*) FILTER (x IS NULL) AS only_current,
  count(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND differs) AS changed,
  count(*) FILTER (x IS NOT NULL AND y IS NOT NULL AND NOT differs) AS unchanged FROM both_sides""")
def snapshot_comparison(t):
    def half(skip):
        rows = t.discoveries.filter(F.col("cell_id") % 3 != skip)
        return market.dedupe_discoveries(rows, ("rating",)).withColumns({
            "review_count": F.lit(None).cast("bigint"),
            "displayed_price": F.lit(None).cast("string"), "currency": F.lit(None).cast("string")})

    return market.comparison_totals(market.compare_snapshots(half(0), half(1)))


# --- pages -------------------------------------------------------------------

def _search_corpus(t):
    """One search page per order, a card per line; some blocked, some cards broken."""
    k, line, part = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey").cast("string")
    listing = F.when(line == 2, "").otherwise(F.concat(F.lit(' data-listing-id="'), part, F.lit('"')))
    href = F.when(line == 4, "/help").otherwise(F.concat(F.lit("/rooms/plus/"), part, F.lit("?x=1")))
    card = F.concat(
        F.lit('<ARTICLE class="c" data-testid="listing-card"'), F.when(line == 4, "").otherwise(listing),
        F.lit(' data-rating="'), F.lit("4."), (k % 10).cast("string"), F.lit(' stars" data-review-count="'),
        F.col("l_quantity").cast("int").cast("string"), F.lit('.9" data-price="'),
        F.floor("l_extendedprice").cast("bigint").cast("string"), F.lit('" data-area=" "><a href="'), href,
        F.lit('"> <b>Room</b>\n '), part, F.lit(" </a></article>\n"))
    return t.read("lineitem").select(k.alias("page_id"), line.alias("n"), card.alias("card")).groupBy(
        "page_id").agg(F.array_sort(F.collect_list(F.struct("n", "card"))).alias("c")).select(
        "page_id", F.concat(
            F.lit("<html><head>"), F.when(F.col("page_id") % 20 == 3, '<meta name="page-state" content=" captcha ">')
            .otherwise(""), F.lit("</head><body>"),
            F.when(F.col("page_id") % 20 == 7, "<p>Too many requests</p>").when(
                F.col("page_id") % 20 == 9, "<p>Please LOG IN</p>").otherwise(""),
            F.array_join(F.transform("c", lambda x: x["card"]), ""), F.lit("</body></html>")).alias("html"))


# A page whose text shows 429 anywhere counts as blocked, ids and prices included.
_SEARCH_STATES_SQL = """page_state AS (
  SELECT l_orderkey AS page_id, CASE WHEN l_orderkey % 20 = 3 THEN 'captcha' WHEN l_orderkey % 20 = 9 THEN 'login_challenge'
    WHEN l_orderkey % 20 = 7 OR bool_or(contains(l_partkey || '|' || CAST(floor(l_extendedprice) AS BIGINT), '429'))
      THEN 'blocked' ELSE 'ok' END AS state,
    count(*) FILTER (l_linenumber <> 4) AS good, count(*) FILTER (l_linenumber = 4) AS bad
  FROM lineitem GROUP BY 1)"""


@query("search_page_states", f"""WITH {_SEARCH_STATES_SQL}
SELECT page_id, state, CASE WHEN state = 'ok' THEN good ELSE 0 END AS card_count,
  CASE WHEN state = 'ok' THEN bad ELSE 0 END AS malformed_count FROM page_state""")
def search_page_states(t):
    return html.search_pages(_search_corpus(t)).select(
        "page_id", "state", "card_count", "malformed_count")


@query("search_page_cards", f"""WITH {_SEARCH_STATES_SQL}
SELECT page_id, CAST(l_partkey AS VARCHAR) AS source_listing_id,
  'Room ' || l_partkey AS title, CAST('4.' || (l_orderkey % 10) AS DOUBLE) AS rating,
  CAST(l_quantity AS BIGINT) AS review_count, CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) AS displayed_price,
  '/rooms/plus/' || l_partkey || '?x=1' AS canonical_url, CAST(NULL AS VARCHAR) AS area
FROM lineitem JOIN page_state ON page_id = l_orderkey WHERE l_linenumber <> 4 AND state = 'ok'""")
def search_page_cards(t):
    return html.cards(_search_corpus(t), "page_id").select(
        "page_id", "source_listing_id", "title", "rating", "review_count", "displayed_price",
        "canonical_url", "area")


@query("detail_pages", """WITH shown AS (
  SELECT *, CASE WHEN p_partkey % 9 = 4 THEN 'access_denied'
    WHEN contains(concat_ws('|', p_partkey, p_size, p_brand, p_type, p_name), '429') THEN 'blocked' ELSE 'ok' END AS state
  FROM part)
SELECT p_partkey AS page_id, state, CASE state WHEN 'access_denied' THEN 'blocked' WHEN 'ok' THEN 'collected' END AS observed_status,
  CASE WHEN state <> 'blocked' THEN CAST(p_partkey AS VARCHAR) END AS source_listing_id,
  CASE state WHEN 'ok' THEN 'A ' || p_name || ' to rent' END AS description,
  CASE state WHEN 'ok' THEN p_type END AS property_type,
  CASE state WHEN 'ok' THEN CAST(p_size AS DOUBLE) END AS bedrooms,
  CASE state WHEN 'ok' THEN p_partkey % 2 = 0 END AS is_superhost,
  CASE state WHEN 'ok' THEN 'Pool,' || p_brand WHEN 'access_denied' THEN '' END AS amenities,
  CASE state WHEN 'ok' THEN 'a' || p_partkey || '.jpg,b.jpg' WHEN 'access_denied' THEN '' END AS photos FROM shown""")
def detail_pages(t):
    k = F.col("p_partkey")
    key = k.cast("string")
    body = F.concat(
        F.lit('<main data-testid="listing-detail" data-listing-id="'), key, F.lit('" data-property-type="'),
        F.col("p_type"), F.lit('" data-bedrooms="'), F.col("p_size").cast("string"), F.lit('" data-superhost="'),
        F.when(k % 2 == 0, "Yes").otherwise("FALSE"), F.lit('"><p data-testid="description"> A '), F.col("p_name"),
        F.lit('\n to rent</p><ul data-testid="amenities"><li> Pool </li><li><i></i></li><li>'), F.col("p_brand"),
        F.lit('</li></ul><div data-testid="photos"><img alt="" src="a'), key,
        F.lit('.jpg"><img src="b.jpg"></div></main>'))
    denied = F.concat(F.lit('<meta name="canonical-url" content="https://x.example/rooms/'), key,
                      F.lit('"><h1>Access Denied</h1>'))
    corpus = t.read("part").select(k.alias("page_id"), F.when(k % 9 == 4, denied).otherwise(body).alias("html"))
    return html.detail_pages(corpus).select("page_id", "state", "detail.*").select(
        "page_id", "state", "observed_status", "source_listing_id", "description", "property_type", "bedrooms",
        "is_superhost", F.array_join("amenities", ",").alias("amenities"),
        F.array_join("photo_urls", ",").alias("photos"))


_PAGE_STATE_SQL = r"""CASE
  WHEN regexp_matches(lower(html), 'unusual traffic|verify you(?:''|&#39;)?re a human|are you a robot|solve the captcha') THEN 'captcha'
  WHEN regexp_matches(lower(html), 'confirm your account|verify your account|account verification') THEN 'account_verification'
  WHEN regexp_matches(lower(html), 'log in or sign up|please log in|login required|sign in to continue') THEN 'login_challenge'
  WHEN regexp_matches(lower(html), 'access denied|403 forbidden|you don(?:''|&#39;)?t have permission') THEN 'access_denied'
  WHEN regexp_matches(lower(html), 'temporarily blocked|too many requests|rate limit|429') THEN 'blocked'
  WHEN regexp_matches(lower(html), 'no exact matches|no results found|0 results') THEN 'no_results' ELSE 'ok' END"""


@query("page_states", f"""SELECT page_id, {_PAGE_STATE_SQL} AS state,
  CASE {_PAGE_STATE_SQL} WHEN 'captcha' THEN 'captcha' WHEN 'account_verification' THEN 'account_verification'
    WHEN 'login_challenge' THEN 'login_challenge' WHEN 'access_denied' THEN 'access_denied'
    WHEN 'blocked' THEN 'blocking_page' END AS manual_action_reason FROM pages""")
def page_states(t):
    return html.with_state(t.read("pages")).select("page_id", "state").withColumn(
        "manual_action_reason", html.manual_action_reason("state"))


@query("page_titles", """SELECT page_id, nullif(trim(regexp_replace(regexp_replace(
  regexp_extract(html, '(?i)<title>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')), '') AS title FROM pages""")
def page_titles(t):
    title = F.regexp_extract("html", r"(?i)<title>(.*?)</title>", 1)
    return t.read("pages").select("page_id", html.plain_text(title).alias("title"))


@query("page_links", """WITH found AS (
  SELECT page_id, regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref="([^"]*)"[^>]*>', 1) AS hrefs FROM pages),
placed AS (SELECT page_id, i, length(hrefs[i + 1]) AS n FROM (SELECT *, unnest(range(len(hrefs))) AS i FROM found)),
first AS (SELECT page_id, n, min(i) AS i FROM placed GROUP BY 1, 2)
SELECT page_id, CAST(n AS VARCHAR) AS listing_id, 'https://x.example/rooms/' || n || '?n=' || i AS url,
  'link ' || i AS label, CAST(i AS INTEGER) AS position FROM first""")
def page_links(t):
    """Links of the given pages; the length of each href stands in for a listing id."""
    anchors = F.regexp_extract_all("html", F.lit(html.ANCHOR), F.lit(0))
    linked = F.transform(anchors, lambda a, i: F.concat(
        F.lit('<a href="/rooms/'), F.length(F.regexp_extract(a, r'(?i)\bhref="([^"]*)"', 1)).cast("string"),
        F.lit("?n="), i.cast("string"), F.lit('"><b>link '), i.cast("string"), F.lit("</b></a>")))
    corpus = t.read("pages").select("page_id", F.array_join(linked, "\n").alias("html"))
    return html.listing_links(corpus, "https://x.example")
