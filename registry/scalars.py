"""Scalar functions over whole text, page, order and event tables."""

from pyspark.sql import functions as F

from registry import query
from tidewatch.functions import text as tx
from tidewatch.functions import times, urls
from tidewatch.functions.places import haversine_m, round_coordinate, valid_point, within_coverage

_COLLAPSED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query("document_hashes", f"""SELECT doc_id, length({_COLLAPSED}) AS n_chars, sha256({_COLLAPSED}) AS text_hash FROM documents""")
def document_hashes(t):
    """Whole texts, normalised and hashed (fingerprints of equal texts agree)."""
    normal = t.read("documents").select("doc_id", tx.normalize_text("text").alias("normal"))
    return normal.select("doc_id", F.length("normal").cast("bigint").alias("n_chars"),
                         tx.content_hash("normal").alias("text_hash"))


@query("document_names", """SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS name FROM documents""")
def document_names(t):
    return t.read("documents").select("doc_id", tx.normalize_name("text").alias("name"))


_WORDS = """list_sort(list_distinct(list_filter(list_transform(string_split({0}, '{1}'),
  lambda x: lower(trim(regexp_replace(x, '\\s+', ' ', 'g')))), lambda x: x <> '')))"""


_ACCENTED = "text || '. Caf' || chr(233)"


@query("document_sets", f"""SELECT doc_id, CAST(len({_WORDS.format(_ACCENTED, '.')}) AS INTEGER) AS members,
  sha256(array_to_string({_WORDS.format(_ACCENTED, '.')}, chr(10))) AS set_hash FROM documents""")
def document_sets(t):
    """Sentences of each document, and a decomposed one, as a normalised set."""
    parts = F.split(F.concat("text", F.lit(". Cafe\u0301")), r"\.")
    return t.read("documents").select("doc_id", F.size(tx.normalize_set(parts)).alias("members"),
                                      tx.set_hash(parts).alias("set_hash"))


@query("label_set_changes", """WITH sets AS (
  SELECT c_custkey AS id, list_filter(['Pool', ' wifi ', CASE WHEN c_custkey % 2 = 0 THEN 'Gym' ELSE '' END,
    CASE WHEN c_custkey % 3 = 0 THEN 'POOL' ELSE c_mktsegment END], lambda x: x <> '') AS a,
    ['wifi', CASE WHEN c_custkey % 5 = 0 THEN 'gym' ELSE 'Bar' END] AS b FROM customer),
norm AS (SELECT id, list_distinct(list_transform(a, lambda x: lower(trim(x)))) AS a, list_distinct(list_transform(b, lambda x: lower(trim(x)))) AS b FROM sets)
SELECT id, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS added,
  array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS removed FROM norm""")
def label_set_changes(t):
    k = F.col("c_custkey")
    before = F.array(F.lit("Pool"), F.lit(" wifi "), F.when(k % 2 == 0, "Gym").otherwise(""),
                     F.when(k % 3 == 0, "POOL").otherwise(F.col("c_mktsegment")))
    after = F.array(F.lit("wifi"), F.when(k % 5 == 0, "gym").otherwise("Bar"))
    return t.read("customer").select(
        k.alias("id"), F.array_join(tx.set_added(before, after), ",").alias("added"),
        F.array_join(tx.set_removed(before, after), ",").alias("removed"))


@query("photo_hashes", """SELECT l_orderkey AS id, l_linenumber AS line,
  sha256('p' || l_partkey || chr(10) || 's' || l_suppkey) AS photos_hash FROM lineitem""")
def photo_hashes(t):
    photos = F.array(F.concat(F.lit(" p"), F.col("l_partkey").cast("string")),
                     F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("\t")))
    return t.read("lineitem").select(F.col("l_orderkey").alias("id"),
                                     F.col("l_linenumber").alias("line"),
                                     tx.photos_hash(photos).alias("photos_hash"))


@query("canonical_urls", """WITH cut AS (
  SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) AS base,
    regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?([^#]*)', 1) AS q FROM pages),
params AS (SELECT page_id, string_agg(p || CASE WHEN contains(p, '=') THEN '' ELSE '=' END, '&' ORDER BY p) AS q
  FROM (SELECT page_id, unnest(string_split(q, '&')) AS p FROM cut)
  WHERE p <> '' AND NOT (lower(split_part(p, '=', 1)) LIKE 'utm\\_%' ESCAPE '\\' OR lower(split_part(p, '=', 1)) IN
    ('fbclid', 'gclid', 'gclsrc', 'dclid', 'msclkid', 'mc_cid', 'mc_eid', 'igshid', 'yclid', '_ga', 'ref', 'ref_src', 'source', 's'))
  GROUP BY 1)
SELECT page_id, base || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END
  || CASE WHEN params.q IS NULL THEN '' ELSE '?' || params.q END AS url FROM cut LEFT JOIN params USING (page_id)""")
def canonical_urls(t):
    return t.read("pages").select("page_id", urls.normalize_url("url").alias("url"))


@query("parsed_urls", """SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1)) ||
  CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE '' END ||
  regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', '') AS url FROM pages""")
def parsed_urls(t):
    return t.read("pages").select("page_id", urls.parse_http_url("url").alias("url"))


_LISTING_ID_SQL = r"""nullif(coalesce(nullif(regexp_extract({0}, '(?i)/rooms/(?:[a-z0-9_-]+/)?([0-9]+)(?:[/?#]|$)', 1), ''),
    regexp_extract({0}, '(?i)[?&](?:listing_id|room_id|id)=([0-9]+)', 1)), '')"""


@query("url_listing_ids", f"""SELECT page_id, CAST(page_id AS VARCHAR) AS from_room,
  {_LISTING_ID_SQL.format("(url || '&ID=' || page_id)")} AS from_param,
  {_LISTING_ID_SQL.format('url')} AS as_is FROM pages""")
def url_listing_ids(t):
    key = F.col("page_id").cast("string")
    return t.read("pages").select(
        "page_id",
        urls.listing_id_from_url(F.concat(F.lit("https://x.example/Rooms/plus/"), key, F.lit("?a=1")))
        .alias("from_room"),
        urls.listing_id_from_url(F.concat("url", F.lit("&ID="), key)).alias("from_param"),
        urls.listing_id_from_url("url").alias("as_is"))


@query("parsed_numbers", """WITH raw AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN ' ' || o_custkey || ' '
    WHEN 1 THEN '-' || o_custkey || '.5' WHEN 2 THEN '1,' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0')
    WHEN 3 THEN o_custkey || ' beds' ELSE o_orderpriority END AS v, o_custkey AS c FROM orders)
SELECT id, CASE WHEN id % 5 = 0 THEN c END AS as_integer,
  CASE id % 5 WHEN 0 THEN CAST(c AS DOUBLE) WHEN 1 THEN -c - 0.5 END AS as_decimal,
  CASE id % 5 WHEN 0 THEN CAST(c AS DOUBLE) WHEN 1 THEN -c - 0.5 WHEN 2 THEN 1000.0 + c % 1000 END AS as_number,
  CASE id % 5 WHEN 0 THEN CAST(c AS DOUBLE) WHEN 1 THEN -c - 0.5 WHEN 2 THEN 1.0 WHEN 3 THEN CAST(c AS DOUBLE)
    ELSE CAST(left(v, 1) AS DOUBLE) END AS leading,
  CASE id % 5 WHEN 0 THEN c WHEN 1 THEN -c WHEN 2 THEN 1 WHEN 3 THEN c ELSE CAST(left(v, 1) AS BIGINT) END AS leading_int
FROM raw""")
def parsed_numbers(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    v = F.when(k % 5 == 0, F.concat(F.lit(" "), c, F.lit(" "))).when(
        k % 5 == 1, F.concat(F.lit("-"), c, F.lit(".5"))).when(
        k % 5 == 2, F.concat(F.lit("1,"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 3, "0"))).when(
        k % 5 == 3, F.concat(c, F.lit(" beds"))).otherwise(F.col("o_orderpriority"))
    return t.read("orders").select(k.alias("id"), v.alias("v")).select(
        "id", tx.parse_integer("v").alias("as_integer"), tx.parse_decimal("v").alias("as_decimal"),
        tx.parse_number("v").alias("as_number"), tx.leading_number("v").alias("leading"),
        tx.leading_integer("v").alias("leading_int"))


@query("parsed_booleans", """WITH raw AS (SELECT o_orderkey AS id, ['true', ' 1', 'YES', 'y', 't', 'false', '0 ', 'No', 'n', 'F', 'maybe', '']
  [CAST(o_orderkey % 12 + 1 AS INTEGER)] AS v FROM orders)
SELECT id, CASE WHEN id % 12 < 4 THEN true WHEN id % 12 BETWEEN 5 AND 8 THEN false END AS strict,
  CASE WHEN id % 12 < 5 THEN true WHEN id % 12 BETWEEN 5 AND 9 THEN false END AS lenient FROM raw""")
def parsed_booleans(t):
    words = F.array(*[F.lit(w) for w in ("true", " 1", "YES", "y", "t", "false", "0 ", "No", "n", "F", "maybe", "")])
    k = F.col("o_orderkey")
    v = F.element_at(words, (k % 12 + 1).cast("int"))
    return t.read("orders").select(k.alias("id"), tx.parse_boolean(v).alias("strict"),
                                   tx.parse_boolean(v, single_letters=True).alias("lenient"))


@query("times", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, strftime(ts, '%Y-%m-%d') AS day,
  strftime(ts + INTERVAL 8 HOUR, '%d %b %Y, %H:%M') AS shown,
  round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0, 6) AS hours,
  round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0, 6) AS days FROM events""")
def event_times(t):
    start = F.lit("2024-01-01").cast("timestamp")
    return t.events.select(
        "event_id", times.iso_utc("ts").alias("iso"), times.utc_date("ts").alias("day"),
        times.display_time("ts").alias("shown"),
        F.round(times.hours_between(start, "ts"), 6).alias("hours"),
        F.round(times.days_between(start, "ts"), 6).alias("days"))


@query("json_values", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  '{"k":' || json_extract_string(props, '$.k') || ',"kind":"' || event_type || '"}' AS built FROM events""")
def json_values(t):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return t.events.select("event_id", k.alias("k"), F.to_json(
        F.struct(k.alias("k"), F.col("event_type").alias("kind"))).alias("built"))


@query("places", """WITH p AS (SELECT c_custkey AS id, -8.0 - (c_custkey % 2000) / 1000.0 AS lat,
    114.0 + (c_custkey % 2500) / 1000.0 AS lng FROM customer)
SELECT id, floor(lat * 100.0 + 0.5) / 100.0 AS lat2, floor(lng * 1000.0 + 0.5) / 1000.0 AS lng3, true AS valid,
  lat BETWEEN -9.2 AND -8.0 AND lng BETWEEN 114.4 AND 115.8 AS covered,
  round(2 * 6371000 * asin(least(1.0, sqrt(pow(sin(radians(-8.65 - lat) / 2), 2)
    + cos(radians(lat)) * cos(radians(-8.65)) * pow(sin(radians(115.13 - lng) / 2), 2)))), 2) AS metres FROM p""")
def places(t):
    k = F.col("c_custkey")
    lat = F.lit(-8.0) - (k % 2000) / F.lit(1000.0)
    lng = F.lit(114.0) + (k % 2500) / F.lit(1000.0)
    return t.read("customer").select(
        k.alias("id"), round_coordinate(lat, 2).alias("lat2"), round_coordinate(lng).alias("lng3"),
        valid_point(lat, lng).alias("valid"), within_coverage(lat, lng).alias("covered"),
        F.round(haversine_m(lat, lng, F.lit(-8.65), F.lit(115.13)), 2).alias("metres"))


@query("name_similarities", """WITH n AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS a,
    trim(regexp_replace(lower(p_type || '-' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS b FROM part)
SELECT p_partkey AS id, levenshtein(a, b) AS distance,
  round(1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE), 6) AS similarity FROM n""")
def name_similarities(t):
    other = F.concat_ws("-", "p_type", "p_brand")
    a, b = tx.normalize_name("p_name"), tx.normalize_name(other)
    return t.read("part").select(
        F.col("p_partkey").alias("id"), F.levenshtein(a, b).cast("bigint").alias("distance"),
        F.round(tx.name_similarity("p_name", other), 6).alias("similarity"))
