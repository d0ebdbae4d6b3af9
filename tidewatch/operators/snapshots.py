"""Immutable snapshots: normalised values, presence, quality flags, fingerprint."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.constants import NORMALIZER_VERSION, PRICE_UNITS, SNAPSHOT_FIELDS
from tidewatch.functions import text as tx
from tidewatch.functions.places import round_coordinate
from tidewatch.functions.urls import normalize_url

FIELD_NAMES = tuple(name for name, _ in SNAPSHOT_FIELDS)
# Value columns of an observation and the type each has when nothing supplies it.
VALUE_COLUMNS = {
    "title": "string", "description": "string", "photos": "array<string>",
    "amenities": "array<string>", "property_type": "string", "latitude": "double",
    "longitude": "double", "rating": "double", "review_count": "bigint",
    "price_amount": "string", "price_currency": "string", "price_unit": "string",
    "bedrooms": "double", "bathrooms": "double", "guest_capacity": "bigint",
    "is_superhost": "boolean", "host_external_id": "string", "official_website": "string",
    "business_whatsapp": "string", "direct_booking_url": "string",
}


def price_unit(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isin(*PRICE_UNITS), c).otherwise("unknown")


def presence_map(present: dict[str, Column]) -> Column:
    """map<field, collected?> over all comparable fields."""
    pairs = []
    for name in FIELD_NAMES:
        pairs += [F.lit(name), F.coalesce(present.get(name, F.lit(False)), F.lit(False))]
    return F.create_map(*pairs)


def observations_from_import(rows: DataFrame, blank_means_null_when_active: bool = False) -> DataFrame:
    """Accepted import rows as observations.

    A blank cell was not collected.  ``blank_means_null_when_active`` instead
    reads a blank cell of an active row as "looked for, not there" for every
    field a CSV can carry.
    """
    price = F.col("observed_price_amount").isNotNull() & F.col("observed_price_currency").isNotNull()
    carried = {
        "title": F.col("title").isNotNull(),
        "location": F.col("latitude").isNotNull() & F.col("longitude").isNotNull(),
        "price": price,
    }
    for name in ("rating", "review_count", "bedrooms", "bathrooms", "guest_capacity",
                 "is_superhost", "host_external_id", "official_website",
                 "business_whatsapp", "direct_booking_url"):
        carried[name] = F.col(name).isNotNull()
    if blank_means_null_when_active:
        active = F.col("observation_status") == "active"
        carried = {name: flag | active for name, flag in carried.items()}
    return rows.withColumns({
        "price_amount": F.when(price, F.col("observed_price_amount")),
        "price_currency": F.when(price, F.col("observed_price_currency")),
        "price_unit": F.when(price, price_unit("observed_price_unit")),
        "field_presence": presence_map(carried),
    }).drop("observed_price_amount", "observed_price_currency", "observed_price_unit")


def import_rows_from_adapter(observations: DataFrame) -> DataFrame:
    """Adapter output (price as a struct, region_name) in the import-row shape."""
    price = F.col("observed_price")
    return observations.withColumns({
        "region": F.col("region_name"),
        "observed_price_amount": price["amount"],
        "observed_price_currency": price["currency"],
        "observed_price_unit": price["unit"],
    }).drop("observed_price", "region_name")


def quality_flags(absent: Collection[str] = ()) -> Column:
    """Sorted data-quality flags of one observation (before normalisation).

    ``absent`` names columns that are NULL in every row.
    """
    bad_url = F.lit(False)
    for name in {"official_website", "direct_booking_url"}.difference(absent):
        given = F.col(name).isNotNull() & (F.col(name) != "")
        bad_url = bad_url | (given & normalize_url(name).isNull())
    price_given = F.col("price_amount").isNotNull() & F.col("price_currency").isNotNull()
    flags = F.array(
        F.when(bad_url, F.lit("invalid_url")),
        F.when(F.col("review_count") < 0, F.lit("negative_review_count")),
        F.when((F.col("rating") < 0) | (F.col("rating") > 5), F.lit("rating_out_of_range")),
        F.when(price_given & ~F.col("price_currency").rlike("^[A-Z]{3}$"),
               F.lit("unknown_currency")),
    )
    return F.filter(flags, lambda f: f.isNotNull())


def fingerprint() -> Column:
    """sha256 over the salient content; observation time never takes part."""

    def line(key: str, value: Column) -> Column:
        return F.concat(F.lit(f"{key}="), F.coalesce(value, F.lit("")))

    price = F.when(F.col("price_amount").isNotNull(), F.concat_ws(
        "|", "price_amount", "price_currency", "price_unit"))
    return F.sha2(F.concat_ws(
        "\n",
        line("status", F.col("observation_status")),
        line("title", F.col("title_hash")),
        line("description", F.col("description_hash")),
        line("photos", F.col("photos_hash")),
        line("amenities", F.col("amenities_hash")),
        line("property_type", F.col("property_type")),
        line("lat", tx.num_text("latitude")),
        line("lng", tx.num_text("longitude")),
        line("rating", tx.num_text("rating")),
        line("review_count", F.col("review_count").cast("string")),
        line("price", price),
        line("bedrooms", tx.num_text("bedrooms")),
        line("bathrooms", tx.num_text("bathrooms")),
        line("guest_capacity", F.col("guest_capacity").cast("string")),
        line("is_superhost", F.col("is_superhost").cast("string")),
        line("host", F.col("host_external_id")),
        line("official_website", F.col("official_website")),
        line("business_whatsapp", F.col("business_whatsapp")),
        line("direct_booking_url", F.col("direct_booking_url")),
    ), 256)


def build_snapshots(observations: DataFrame) -> DataFrame:
    """Normalise observations into comparable snapshots, one output row per input row.

    Two projections, no shuffle.  Needs observed_at, observation_status,
    parser_version, field_presence; any missing value column counts as NULL.
    """
    df = observations
    # What no row has needs no normalising; a NULL literal would still be sent to Python.
    absent = set(VALUE_COLUMNS).difference(df.columns)

    def made(name: str, how: Callable[[str], Column]) -> Column:
        return F.lit(None).cast("string") if name in absent else how(name)

    members = F.array().cast("array<string>")
    if "amenities" not in absent:
        members = F.coalesce(tx.normalize_set("amenities"), members)
    df = df.withColumns({
        name: (F.col(name) if name in df.columns else F.lit(None)).cast(kind)
        for name, kind in VALUE_COLUMNS.items()
    })
    amenities_seen = F.col("field_presence").getItem("amenities")
    priced = F.col("price_amount").isNotNull() & F.col("price_currency").isNotNull()
    df = df.withColumns({
        "quality_flags": quality_flags(absent),
        "title_hash": made("title", tx.normalized_hash),
        "description_hash": made("description", tx.normalized_hash),
        "photos_hash": made("photos", tx.photos_hash),
        "amenities_hash": made("amenities", tx.set_hash),
        "amenities": F.when(amenities_seen, members),
        "title": made("title", tx.text_value),
        "property_type": made("property_type", tx.text_value),
        "host_external_id": made("host_external_id", tx.text_value),
        "business_whatsapp": made("business_whatsapp", tx.text_value),
        "official_website": made("official_website", normalize_url),
        "direct_booking_url": made("direct_booking_url", normalize_url),
        "latitude": round_coordinate("latitude"),
        "longitude": round_coordinate("longitude"),
        "price_amount": F.when(priced, F.col("price_amount")),
        "price_currency": F.when(priced, F.col("price_currency")),
        "price_unit": F.when(priced, price_unit("price_unit")),
        "normalizer_version": F.lit(NORMALIZER_VERSION),
    })
    df = df.withColumn("content_fingerprint", fingerprint())
    # At rest a rating has two decimals, room counts one; both sides of a later
    # comparison then carry the same precision.
    return df.withColumns({
        "rating": F.round("rating", 2),
        "bedrooms": F.round("bedrooms", 1),
        "bathrooms": F.round("bathrooms", 1),
    })


def one_per_run(snapshots: DataFrame) -> DataFrame:
    """Keep the first snapshot of each (listing, run).

    An aggregation, not a window: duplicates of one key combine before the shuffle.
    """
    columns = snapshots.columns
    first = F.min_by(F.struct(*columns), F.struct("observed_at", "snapshot_id"))
    return snapshots.groupBy(
        F.col("listing_id").alias("__l"), F.col("run_id").alias("__r")
    ).agg(first.alias("s")).select("s.*")


def listing_id(dataset: Column, source: Column, external: Column) -> Column:
    """Deterministic id of the natural key, so resolving a listing needs no join."""
    return F.sha2(F.concat_ws("\u0001", dataset, source, external), 256)
