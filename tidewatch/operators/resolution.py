"""Listings and properties: resolving, merging, splitting, rolling back, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.places import haversine_m
from tidewatch.functions.text import normalize_name, similarity_of_normalized
from tidewatch.operators.scans import lookup
from tidewatch.operators.snapshots import listing_id

MAX_PROXIMITY_M = 5_000.0
NAME_WEIGHT = 0.7


# --- resolving ---------------------------------------------------------------

def listing_keys(rows: DataFrame, dataset_id: str) -> DataFrame:
    """Add dataset_id and the deterministic listing_id to accepted rows."""
    return rows.withColumn("dataset_id", F.lit(dataset_id)).withColumn(
        "listing_id", listing_id(F.col("dataset_id"), F.col("source_key"), F.col("external_id")))


def first_rows(rows: DataFrame) -> DataFrame:
    """The earliest row of every listing; combines map-side, no window."""
    rest = [c for c in rows.columns if c != "listing_id"]
    tie = "row_number" if "row_number" in rest else rest[0]
    first = F.min_by(F.struct(*rest), F.struct("observed_at", tie))
    return rows.groupBy("listing_id").agg(first.alias("f")).select("listing_id", "f.*")


def new_listings(rows: DataFrame, existing: DataFrame | None) -> DataFrame:
    first = first_rows(rows)
    if existing is None:
        return first
    return first.join(existing.select("listing_id"), "listing_id", "left_anti")


def resolve_properties(listings: DataFrame, aliases: DataFrame) -> DataFrame:
    """Give every new listing its property.

    An alias of the same dataset (compared exactly) reuses that property.  Other
    listings with a canonical key share one new property per key; the rest get one
    each.  ``aliases`` has dataset_id, alias, property_id.
    """
    known = aliases.groupBy("dataset_id", "alias").agg(F.min("property_id").alias("__known"))
    known = known.withColumnRenamed("alias", "canonical_property_key")
    matched = lookup(listings, known, ["dataset_id", "canonical_property_key"])
    by_key = F.sha2(F.concat_ws("\u0001", F.lit("key"), "dataset_id", "canonical_property_key"), 256)
    own = F.sha2(F.concat_ws("\u0001", F.lit("listing"), "listing_id"), 256)
    return matched.withColumns({
        "is_new_property": F.col("__known").isNull(),
        "property_id": F.coalesce(
            F.col("__known"), F.when(F.col("canonical_property_key").isNotNull(), by_key), own),
    }).drop("__known")


def property_name(title: Column, external_id: Column) -> Column:
    return F.coalesce(title, F.concat(F.lit("Listing "), external_id))


def new_properties(resolved: DataFrame) -> DataFrame:
    """One property row per new property, described by its earliest listing."""
    created = resolved.filter("is_new_property")
    facts = F.struct(
        property_name(F.col("title"), F.col("external_id")).alias("canonical_name"),
        "dataset_id", "latitude", "longitude", "bedrooms", "bathrooms", "guest_capacity",
        "official_website", "business_whatsapp", "direct_booking_url",
        F.col("observed_at").alias("first_observed_at"),
        F.col("observed_at").alias("last_observed_at"), "canonical_property_key")
    first = F.min_by(facts, F.struct("observed_at", "listing_id"))
    return created.groupBy("property_id").agg(first.alias("f")).select("property_id", "f.*")


def new_aliases(properties: DataFrame) -> DataFrame:
    return properties.filter(F.col("canonical_property_key").isNotNull()).select(
        "property_id", F.col("canonical_property_key").alias("alias"), "dataset_id",
        F.lit("import").alias("source"))


# --- merge, split, rollback --------------------------------------------------

def check_merges(merges: DataFrame, properties: DataFrame) -> DataFrame:
    """Add ``problem`` to each requested merge (from_property_id, to_property_id).

    A batch is one hop: a property that is merged away cannot also be a target or
    be merged twice.
    """
    ids = properties.select("property_id", "dataset_id")
    source = ids.select(F.col("property_id").alias("from_property_id"),
                        F.col("dataset_id").alias("__from"))
    target = ids.select(F.col("property_id").alias("to_property_id"),
                        F.col("dataset_id").alias("__to"))
    sources = merges.groupBy("from_property_id").agg(F.count(F.lit(1)).alias("__times"))
    chained = sources.select(F.col("from_property_id").alias("to_property_id"),
                             F.lit(True).alias("__chained"))
    joined = (
        merges.join(source, "from_property_id", "left").join(target, "to_property_id", "left")
        .join(sources, "from_property_id").join(chained, "to_property_id", "left")
    )
    problem = (
        F.when(F.col("from_property_id") == F.col("to_property_id"),
               "cannot merge a property into itself")
        .when(F.col("__from").isNull() | F.col("__to").isNull(), "both properties must exist")
        .when(F.col("__from") != F.col("__to"), "properties belong to different datasets")
        .when(F.col("__times") > 1, "property merged twice in one batch")
        .when(F.col("__chained"), "merge target is itself merged in this batch")
    )
    return joined.withColumns({"problem": problem, "dataset_id": F.col("__from")}).drop(
        "__from", "__to", "__times", "__chained")


def redirect_facts(facts: DataFrame, redirects: DataFrame) -> DataFrame:
    """Point a fact table's property_id at the merge target."""
    moved = redirects.select(F.col("from_property_id").alias("property_id"),
                             F.col("to_property_id").alias("__to"))
    return lookup(facts, moved, ["property_id"]).withColumn(
        "property_id", F.coalesce(F.col("__to"), F.col("property_id"))).drop("__to")


def merge_moves(merges: DataFrame, listings: DataFrame) -> DataFrame:
    """The exact listings each merge moves, one row per listing.

    Kept as rows, not as a list per merge: a property may hold any number of listings.
    """
    target = merges.select(F.col("from_property_id").alias("property_id"), "to_property_id")
    return lookup(listings.select("listing_id", "property_id"), target, ["property_id"],
                  "inner").select(
        "listing_id", F.col("property_id").alias("from_property_id"), "to_property_id")


def merge_redirects(merges: DataFrame, moves: DataFrame) -> DataFrame:
    """One redirect record per merge."""
    counts = moves.groupBy("from_property_id").agg(F.count(F.lit(1)).alias("moved_count"))
    return merges.join(counts, "from_property_id", "left").fillna(0, ["moved_count"]).withColumns({
        "kind": F.lit("merge"),
        "redirect_id": F.sha2(F.concat_ws(
            "\u0001", F.lit("merge"), "from_property_id", "to_property_id"), 256),
    })


def refresh_windows(properties: DataFrame, listings: DataFrame, touched: DataFrame) -> DataFrame:
    """Widen the observation window of merge targets to their listings' window.

    ``listings`` must already carry the new property ids.
    """
    targets = touched.select(F.col("to_property_id").alias("property_id")).distinct()
    spans = listings.join(targets, "property_id", "left_semi").groupBy("property_id").agg(
        F.min("first_seen_at").alias("__first"), F.max("last_observed_at").alias("__last"))
    return properties.join(spans, "property_id", "left").withColumns({
        "first_observed_at": F.least("first_observed_at", "__first"),
        "last_observed_at": F.greatest("last_observed_at", "__last"),
    }).drop("__first", "__last")


def archive_sources(properties: DataFrame, merges: DataFrame, at: Column) -> DataFrame:
    gone = merges.select(F.col("from_property_id").alias("property_id"),
                         F.lit(True).alias("__gone")).distinct()
    return properties.join(gone, "property_id", "left").withColumn(
        "archived_at", F.when(F.col("__gone"), at).otherwise(F.col("archived_at"))).drop("__gone")


def merge_audit(redirects: DataFrame) -> DataFrame:
    return redirects.select(
        F.lit("property.merge").alias("action"), F.lit("property").alias("target_type"),
        F.col("from_property_id").cast("string").alias("target_id"),
        F.to_json(F.struct("to_property_id", "reason", "moved_count")).alias("metadata"))


def split_properties(listings: DataFrame, splits: DataFrame) -> DataFrame:
    """Move single listings into properties of their own.

    ``splits`` has listing_id and reason.  One row per split: the new property
    (property_id, canonical_name, window) and the redirect (from_property_id, kind).
    """
    taken = listings.join(splits, "listing_id")
    return taken.select(
        F.sha2(F.concat_ws("\u0001", F.lit("split"), "listing_id"), 256).alias("property_id"),
        "dataset_id", property_name(F.col("current_title"), F.col("external_id"))
        .alias("canonical_name"),
        F.col("first_seen_at").alias("first_observed_at"), "last_observed_at", "listing_id",
        F.col("property_id").alias("from_property_id"), "reason", F.lit("split").alias("kind"))


def move_listings(facts: DataFrame, moves: DataFrame) -> DataFrame:
    """Point rows of the moved listings (listing_id, property_id) at their new property."""
    target = moves.select("listing_id", F.col("property_id").alias("__to"))
    return lookup(facts, target, ["listing_id"]).withColumn(
        "property_id", F.coalesce(F.col("__to"), F.col("property_id"))).drop("__to")


def rollback_moves(redirects: DataFrame, moves: DataFrame, redirect_id: str) -> DataFrame:
    """Listings that return to their former property when a merge is undone.

    Only a merge can be rolled back.  Aliases, notes and the observation window stay
    where the merge put them; use ``move_listings`` for listings and their events.
    """
    chosen = redirects.filter(F.col("redirect_id") == redirect_id).select(
        "kind", "from_property_id", "to_property_id").head()
    if chosen is None:
        raise ValueError("redirect not found")
    if chosen.kind != "merge":
        raise ValueError("only a merge can be rolled back")
    return moves.filter(
        (F.col("from_property_id") == chosen.from_property_id)
        & (F.col("to_property_id") == chosen.to_property_id)
    ).select("listing_id", F.col("from_property_id").alias("property_id"))


def rollback_record(redirects: DataFrame, redirect_id: str) -> DataFrame:
    return redirects.filter(F.col("redirect_id") == redirect_id).select(
        F.col("to_property_id").alias("from_property_id"),
        F.col("from_property_id").alias("to_property_id"),
        F.lit("rollback").alias("kind"), "moved_count")


def incoming_merges(redirects: DataFrame, property_id) -> DataFrame:
    return redirects.filter(
        (F.col("to_property_id") == property_id) & (F.col("kind") == "merge")
    ).orderBy(F.desc("created_at"))


# --- ranking likely duplicates -----------------------------------------------

def score_candidates(candidates: DataFrame, name, lat: float | None, lng: float | None) -> DataFrame:
    """Score every candidate against one target: a projection, so it scales linearly."""
    target_name = normalize_name(F.lit(name))
    similarity = similarity_of_normalized(target_name, normalize_name("name"))
    if lat is None or lng is None:
        distance = F.lit(None).cast("double")
    else:
        distance = F.when(
            F.col("latitude").isNotNull() & F.col("longitude").isNotNull(),
            haversine_m(F.lit(float(lat)), F.lit(float(lng)), "latitude", "longitude"))
    proximity = F.greatest(F.lit(0.0), 1.0 - F.col("distance_m") / MAX_PROXIMITY_M)
    return candidates.withColumn("distance_m", distance).withColumn("similarity", similarity).withColumn(
        "score", F.when(F.col("distance_m").isNull(), F.col("similarity")).otherwise(
            F.col("similarity") * NAME_WEIGHT + proximity * (1 - NAME_WEIGHT)))


def rank_candidates(properties: DataFrame, target_id, limit: int | None = None) -> DataFrame:
    """Other properties of the target's dataset, most likely duplicate first.

    Reads the one target row, then scores all candidates exactly in a single scan.
    """
    target = properties.filter(F.col("property_id") == target_id).select(
        "dataset_id", "name", "latitude", "longitude").head()
    if target is None:
        raise ValueError(f"no property {target_id!r}")
    others = properties.filter(
        (F.col("dataset_id") == target.dataset_id) & (F.col("property_id") != target_id))
    ranked = score_candidates(
        others, target.name, target.latitude, target.longitude
    ).orderBy(F.desc("score"), "property_id")
    return ranked if limit is None else ranked.limit(limit)


def reasons_of_pair(site_a: Column, site_b: Column, phone_a: Column, phone_b: Column,
                    rooms_a: Column, rooms_b: Column) -> Column:
    """What speaks for a match, from columns of both sides and ``similarity`` and ``distance_m``."""
    host = lambda c: F.regexp_extract(F.lower(c), r"^https?://(?:www\.)?([^/:?#]+)", 1)
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    return F.filter(F.array(
        F.when(F.col("similarity") >= 0.85, F.lit("similar_name")),
        F.when(F.col("distance_m") <= 250, F.lit("near")),
        F.when((host(site_a) != "") & (host(site_a) == host(site_b)), F.lit("same_domain")),
        F.when((digits(phone_a) != "") & (digits(phone_a) == digits(phone_b)), F.lit("same_phone")),
        F.when(rooms_a == rooms_b, F.lit("same_bedrooms")),
    ), lambda r: r.isNotNull())


def candidate_reasons(scored: DataFrame, website: str | None = None, phone: str | None = None,
                      bedrooms: float | None = None) -> DataFrame:
    """Further signals in favour of a match with one target, as a list of reasons."""
    site, number, rooms = (F.lit(v).cast(t) for v, t in (
        (website, "string"), (phone, "string"), (bedrooms, "double")))
    return scored.withColumn("reasons", reasons_of_pair(
        site, F.col("official_website"), number, F.col("business_whatsapp"), rooms, F.col("bedrooms")))
