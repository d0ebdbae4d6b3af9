"""Likely duplicates of every property: an exact similarity join.

The score of a pair is its name similarity, or 0.7 of that and 0.3 of proximity where both have
coordinates.  A score of ``min_score`` or more therefore bounds the name similarity from
below and, above 0.7, the distance from above, and candidates are found by those bounds:

* Names that are similar enough share a q-gram among the rarest of each (prefix filter).  How
  many grams must be looked at follows from the edits the bound allows, and q from the
  similarity, such that no pair is missed; lengths are compared first.
* Near pairs meet by tile: tiles are as wide as the bound, with columns by latitude row, and one
  side is entered in all tiles that may hold a partner, also over the date line and the poles.
* Where a side lacks coordinates, or points far apart still reach the score, names meet alone.

* Where few names stand at many places, names and places meet once each instead (``near_offers``).

Every candidate pair is then scored as a single target's candidates are.  Properties equal in
name and place are one *spot*: spots meet, not properties, and a spot offers its first
``limit + 1`` ids, as no property can use more.

Only tables that were counted are broadcast; all others join by sorting, whatever size Spark
expects of them from their compressed files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.constants import EARTH_RADIUS_M
from tidewatch.functions.places import haversine_m
from tidewatch.functions.text import normalize_name
from tidewatch.operators.resolution import MAX_PROXIMITY_M, NAME_WEIGHT, reasons_of_pair
from tidewatch.operators.scans import lookup
from tidewatch.session import cut_lineage

BROADCAST_GRAMS = 200_000
BROADCAST_ROWS = 20_000  # names, places or pairs of names
BROADCAST_SPOTS = 1_000  # spots opened to their grams
FEW_NAMES = 64
SLACK = 1e-9  # bounds are loosened by this against rounding; scores decide in the end


def _sized(table: DataFrame, rows: int, limit: int) -> DataFrame:
    """One side of a join: broadcast while its counted rows allow, else joined by sorting, so that
    no table that grows with the input is collected on the driver."""
    return F.broadcast(table) if rows <= limit else _sorted(table)


def _sorted(table: DataFrame) -> DataFrame:
    return table.hint("merge")


# --- bounds --------------------------------------------------------------------

def gram_size(similarity: float) -> int:
    """The longest grams of which two names at this similarity always share one."""
    return 3 if similarity >= 2 / 3 else 2 if similarity >= 1 / 2 else 1


def _grams(name: Column, q: int) -> Column:
    """Grams of the padded name, the n-th repeat of a gram marked with n, so they form a set."""
    pad = "#" * (q - 1)
    padded = F.concat(F.lit(pad), name, F.lit(pad))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - q + 1, F.lit(1))),
                        lambda i: F.substring(padded, i, q))
    return F.transform(grams, lambda g, i: F.concat(
        g, F.size(F.filter(F.slice(grams, 1, i + 1), lambda h: h == g)).cast("string")))


def _prefix_length(length: Column, similarity: float, q: int) -> Column:
    """Grams of a name to look at: one more than the edits to any partner can destroy."""
    edits = F.floor((1 - similarity) / similarity * length + SLACK)
    return (edits * q + 1).cast("int")


def with_prefixes(spots: DataFrame, similarity: float) -> DataFrame:
    """Add ``prefix``: the rarest grams of each name, as numbers in order of rarity."""
    q = gram_size(similarity)
    names = spots.select("name").distinct()
    grams = names.select("name", F.explode(_grams(F.col("name"), q)).alias("gram"))
    counts = cut_lineage(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    # The name alphabet has 37 letters, so there are few grams; counted all the same.
    counted = _sized(counts, counts.count(), BROADCAST_GRAMS)
    order = F.struct("n", F.xxhash64("gram").alias("h"), "gram")
    listed = grams.join(counted, "gram").groupBy("name").agg(
        F.sort_array(F.collect_list(order)).alias("g"))
    prefixes = listed.select("name", F.slice(
        F.transform("g", lambda g: g["gram"]), F.lit(1),
        _prefix_length(F.length("name"), similarity, q)).alias("prefix"))
    return lookup(spots, _sized(prefixes, names.count(), BROADCAST_ROWS), ["name"], "inner")


def _degrees(metres: float, lat: Column) -> Column:
    """Longitude difference that ``metres`` can span at this latitude or closer to its pole."""
    reach = F.degrees(F.lit(metres / EARTH_RADIUS_M))
    edge = F.least(F.abs(lat) + reach, F.lit(90.0))
    share = F.sin(F.lit(metres / EARTH_RADIUS_M / 2)) / F.nullif(F.cos(F.radians(edge)), F.lit(0.0))
    return F.when((edge >= 90) | share.isNull() | (share >= 1), F.lit(360.0)).otherwise(
        F.degrees(2 * F.asin(share)) * (1 + SLACK) + SLACK)


class Tiles:
    """Rows of latitude as high as ``metres``; each row has as many columns as are still as wide."""

    def __init__(self, metres: float):
        self.metres = metres
        self.height = metres / EARTH_RADIUS_M * 57.29577951308232 * (1 + SLACK) + SLACK

    def row(self, lat: Column) -> Column:
        return F.floor((lat + 90) / self.height)

    def columns(self, row: Column) -> Column:
        far = F.greatest(F.abs(row * self.height - 90), F.abs((row + 1) * self.height - 90))
        return F.greatest(F.floor(360 / _degrees(self.metres, F.least(far, F.lit(90.0)))), F.lit(1))

    def own(self, lat: Column, lng: Column) -> Column:
        row = self.row(lat)
        n = self.columns(row)
        return F.struct(row.alias("row"), F.pmod(F.floor((lng + 180) * n / 360), n).alias("column"))

    def around(self, lat: Column, lng: Column) -> Column:
        """All tiles that can hold a point within reach."""
        middle = self.row(lat)
        span = _degrees(self.metres, lat)

        def cells(row: Column) -> Column:
            n = self.columns(row)
            low, high = (F.floor((lng + 180 + d * span) * n / 360) for d in (-1, 1))
            return F.transform(F.sequence(low, F.least(high, low + n - 1)), lambda c: F.struct(
                row.alias("row"), F.pmod(c, n).alias("column")))

        return F.array_distinct(F.flatten(F.transform(F.sequence(middle - 1, middle + 1), cells)))


# --- joining --------------------------------------------------------------------

def _sides(left: DataFrame, right: DataFrame, key: list[str], similarity: float,
           rows: int | None = None) -> DataFrame:
    """Pairs of spots with a common key and gram, once each, whose names are similar enough.

    ``rows`` is the counted number of spots of the left side, where that side may be small.
    """
    columns = ["spot", "name", "latitude", "longitude", "prefix"]

    def side(df: DataFrame, mark: str) -> DataFrame:
        return df.select("dataset_id", *key, F.explode("prefix").alias("gram"), *[
            F.col(c).alias(f"{mark}_{c}") for c in columns])

    first_side = side(left, "a")
    first_side = _sorted(first_side) if rows is None else _sized(first_side, rows, BROADCAST_SPOTS)
    pairs = first_side.join(side(right, "b"), ["dataset_id", *key, "gram"])
    la, lb = F.length("a_name"), F.length("b_name")
    longest = F.greatest(la, lb)
    edits = F.floor((1 - similarity) * longest + SLACK).cast("int")
    # Prefixes follow one order, so the first gram they share names the pair once.
    first = F.array_intersect("a_prefix", "b_prefix")[0] == F.col("gram")
    close = (F.abs(la - lb) <= edits) & first
    apart = F.levenshtein("a_name", "b_name")
    return pairs.filter(close).withColumn("similarity", F.when(longest == 0, F.lit(1.0)).otherwise(
        1.0 - apart / F.nullif(longest, F.lit(0)))).filter(
        F.col("similarity") >= similarity - SLACK).drop("gram", "a_prefix", "b_prefix", *key)


def _placed(df: DataFrame, known: bool) -> DataFrame:
    both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return df.filter(both if known else ~both)


def _near_bounds(min_score: float) -> tuple[float, float]:
    """Least name similarity and greatest distance of a near pair that reaches the score."""
    share = 1 - NAME_WEIGHT
    least_near = (min_score - share) / NAME_WEIGHT
    if least_near <= 0:
        raise ValueError(f"every near pair scores {share} or more; ask for more than that")
    return least_near, MAX_PROXIMITY_M * min(1.0, (1 - min_score) / share) * (1 + SLACK) + SLACK


def _apart() -> Column:
    return haversine_m("a_latitude", "a_longitude", "b_latitude", "b_longitude")


def _scored(pairs: DataFrame, min_score: float) -> DataFrame:
    proximity = F.greatest(F.lit(0.0), 1.0 - F.col("distance_m") / MAX_PROXIMITY_M)
    score = F.when(F.col("distance_m").isNull(), F.col("similarity")).otherwise(
        F.col("similarity") * NAME_WEIGHT + proximity * (1 - NAME_WEIGHT))
    return pairs.withColumn("score", score).filter(F.col("score") >= min_score).select(
        "a_spot", "b_spot", "similarity", "distance_m", "score")


def spot_pairs(spots: DataFrame, min_score: float) -> DataFrame:
    """Unordered pairs of different spots that reach the score: a_spot, b_spot, similarity,
    distance_m, score.  ``spots`` has dataset_id, spot, name, latitude, longitude."""
    least_near, reach = _near_bounds(min_score)
    tiles = Tiles(reach)
    lat, lng = F.col("latitude"), F.col("longitude")

    near = with_prefixes(_placed(spots, True), least_near)
    found = _sides(near.withColumn("tile", tiles.own(lat, lng)),
                   near.withColumn("tile", F.explode(tiles.around(lat, lng))), ["tile"], least_near)
    found = found.filter("a_spot < b_spot").withColumn("distance_m", _apart()).filter(
        F.col("distance_m") <= reach)
    return _scored(found, min_score).unionByName(distant_pairs(spots, min_score))


def distant_pairs(spots: DataFrame, min_score: float) -> DataFrame:
    """The pairs of ``spot_pairs`` that are not within reach of each other, or not known to be."""
    reach, least_far = _near_bounds(min_score)[1], min_score / NAME_WEIGHT
    # One side without coordinates: names decide alone.
    named = with_prefixes(spots, min_score)
    blind = _placed(named, False)
    rows = _placed(spots, False).count()
    others = _sides(blind, _placed(named, True), [], min_score, rows).unionByName(
        _sides(blind, blind, [], min_score, rows).filter("a_spot < b_spot"))
    found = others.withColumn("distance_m", F.lit(None).cast("double"))
    if least_far <= 1:  # also points out of reach of each other
        placed = with_prefixes(_placed(spots, True), least_far)
        far = _sides(placed, placed, [], least_far).filter("a_spot < b_spot").withColumn(
            "distance_m", _apart()).filter(F.col("distance_m") > reach)
        found = found.unionByName(far)
    return _scored(found, min_score)


def near_offers(spots: DataFrame, names: DataFrame, ids: DataFrame, min_score: float, limit: int) -> DataFrame:
    """Offers among placed spots within reach (spot, other, similarity, distance_m, score), for few names.

    Names meet names and places meet places, once each.  For every place and name the nearest spots
    of that name follow, as many as hold ``limit + 1`` ids: of one name a farther spot never scores
    more, so the others can be in no list.  Distances that differ by a micrometre or less count as equal.
    """
    least_near, reach = _near_bounds(min_score)
    tiles = Tiles(reach)
    place = ["dataset_id", "latitude", "longitude"]
    lat, lng = F.col("latitude"), F.col("longitude")
    placed = _placed(spots, True)
    # Numbers stand for names and places; they are fixed once the tables are stored.
    named = cut_lineage(names.withColumn("name_no", F.monotonically_increasing_id()))
    places = cut_lineage(placed.select(*place).distinct().withColumn("place_no", F.monotonically_increasing_id()))
    n_names, n_places = named.count(), places.count()
    numbered = cut_lineage(placed.join(_sized(named, n_names, BROADCAST_ROWS), ["dataset_id", "name"]).join(
        _sized(places, n_places, BROADCAST_ROWS), place).join(
        _sorted(ids.select("spot", F.size("ids").alias("n"))), "spot").select("spot", "name_no", "place_no", "n"))

    alike = with_prefixes(named.withColumnRenamed("name_no", "spot").withColumns({
        "latitude": F.lit(None).cast("double"), "longitude": F.lit(None).cast("double")}), least_near)
    alike = cut_lineage(_sides(alike, alike, [], least_near, n_names).select(
        F.col("a_spot").alias("name_no"), F.col("b_spot").alias("other_name"), "similarity"))

    def side(df: DataFrame, mark: str) -> DataFrame:
        return df.select("dataset_id", "tile", *[F.col(c).alias(f"{mark}_{c}") for c in (
            "place_no", "latitude", "longitude")])

    met = _sized(side(places.withColumn("tile", tiles.own(lat, lng)), "a"), n_places, BROADCAST_ROWS).join(
        side(places.withColumn("tile", F.explode(tiles.around(lat, lng))), "b"), ["dataset_id", "tile"])
    met = cut_lineage(met.withColumn("distance_m", _apart()).filter(F.col("distance_m") <= reach).select(
        F.col("a_place_no").alias("place_no"), F.col("b_place_no").alias("other_place"), "distance_m"))

    there = numbered.select(F.col("spot").alias("other"), F.col("place_no").alias("other_place"),
                            F.col("name_no").alias("other_name"), "n")
    nearer = F.sum("n").over(Window.partitionBy("place_no", "other_name").orderBy("__um").rangeBetween(
        Window.unboundedPreceding, -2))
    around = met.join(_sorted(there.drop("other")), "other_place").withColumn(
        "__um", F.floor(F.col("distance_m") * 1_000_000)).withColumn("__nearer", nearer).filter(
        F.coalesce("__nearer", F.lit(0)) <= limit).select("place_no", "other_name", "other_place", "distance_m")
    offers = numbered.select("spot", "name_no", "place_no").join(
        _sized(alike, alike.count(), BROADCAST_ROWS), "name_no").join(
        _sorted(around), ["place_no", "other_name"]).filter(
        (F.col("name_no") != F.col("other_name")) | (F.col("place_no") != F.col("other_place")))
    return _scored(offers.join(_sorted(there.drop("n")), ["other_name", "other_place"]).select(
        F.col("spot").alias("a_spot"), F.col("other").alias("b_spot"), "similarity", "distance_m"), min_score).select(
        F.col("a_spot").alias("spot"), F.col("b_spot").alias("other"), "similarity", "distance_m", "score")


def all_candidates(properties: DataFrame, min_score: float = 0.8, limit: int = 10) -> DataFrame:
    """For every property its ``limit`` likeliest duplicates in its dataset that reach ``min_score``:
    property_id, candidate_id, rank, similarity, distance_m, score.

    Equal scores rank by candidate id.  A property without a name compares as an empty name.
    """
    spot = F.sha2(F.concat_ws("\u0001", F.col("dataset_id").cast("string"), F.col("name"), *[
        F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("latitude", "longitude")]), 256)
    rows = properties.select(
        "property_id", "dataset_id", F.coalesce(normalize_name("name"), F.lit("")).alias("name"),
        F.col("latitude").cast("double"), F.col("longitude").cast("double")).withColumn("spot", spot)
    # The first ids of a spot, kept short map-side: top of each task, then top of all.
    per_spot = Window.partitionBy("spot").orderBy("property_id")
    first = rows.select("spot", "property_id").withColumn("n", F.row_number().over(per_spot)).filter(
        F.col("n") <= limit + 1).groupBy("spot").agg(
        F.sort_array(F.collect_list("property_id")).alias("ids"))
    spots = cut_lineage(rows.groupBy("spot").agg(*[
        F.first(c).alias(c) for c in ("dataset_id", "name", "latitude", "longitude")]))
    ids = cut_lineage(first)

    # Few names over many spots: pairs of names are then no more than FEW_NAMES rows a spot.
    names = cut_lineage(spots.select("dataset_id", "name").distinct())
    few = names.count() ** 2 <= FEW_NAMES * spots.count()
    pairs = cut_lineage((distant_pairs if few else spot_pairs)(spots, min_score))
    facts = ["similarity", "distance_m", "score"]
    both = pairs.select(F.col("a_spot").alias("spot"), F.col("b_spot").alias("other"), *facts).unionByName(
        pairs.select(F.col("b_spot").alias("spot"), F.col("a_spot").alias("other"), *facts))
    if few:
        both = both.unionByName(near_offers(spots, names, ids, min_score, limit))
    same = F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), F.lit(0.0))
    own = spots.select("spot", F.col("spot").alias("other"), F.lit(1.0).alias("similarity"),
                       same.alias("distance_m"), F.lit(1.0).alias("score"))
    offered = lookup(both.unionByName(own), _sorted(ids.withColumnRenamed("spot", "other")), ["other"], "inner")
    offered = offered.select("spot", F.explode("ids").alias("candidate_id"), *facts)
    best = Window.partitionBy("spot").orderBy(F.desc("score"), "candidate_id")
    kept = offered.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= limit + 1)
    lists = kept.groupBy("spot").agg(F.sort_array(F.collect_list(
        F.struct("n", "candidate_id", *facts))).alias("offers"))

    offered = lookup(rows.select("property_id", "spot"), _sorted(cut_lineage(lists)), ["spot"], "inner")
    mine = F.slice(F.filter("offers", lambda o: o["candidate_id"] != F.col("property_id")), 1, limit)
    return offered.select("property_id", F.posexplode(mine).alias("at", "o")).select(
        "property_id", "o.candidate_id", (F.col("at") + 1).alias("rank"), *[f"o.{c}" for c in facts])


def candidates_with_reasons(properties: DataFrame, min_score: float = 0.8, limit: int = 10) -> DataFrame:
    """``all_candidates`` with the further signals that speak for each pair as ``reasons``."""
    signals = ["official_website", "business_whatsapp", "bedrooms"]
    found = cut_lineage(all_candidates(properties, min_score, limit))
    for key, mark in (("property_id", "a"), ("candidate_id", "b")):
        side = properties.select(F.col("property_id").alias(key),
                                 *[F.col(c).alias(f"{mark}_{c}") for c in signals])
        found = lookup(found, _sorted(side), [key])
    reasons = reasons_of_pair(*[F.col(f"{mark}_{c}") for c in signals for mark in "ab"])
    return found.withColumn("reasons", reasons).drop(
        *[f"{mark}_{c}" for c in signals for mark in "ab"])
