"""Import rows: typed or rejected with codes, de-duplicated, counted.

Validation is one projection.  De-duplication needs, per (source, listing), the
first valid row; that is a running "first", so repeated keys of any size work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.config import Coverage
from tidewatch.constants import CSV_COLUMNS, OBSERVATION_STATUSES
from tidewatch.functions import text as tx
from tidewatch.functions.places import valid_point, within_coverage
from tidewatch.functions.times import parse_timestamp
from tidewatch.functions.urls import parse_http_url
from tidewatch.operators.scans import Scan, by_key, running

_URLS = ("source_url", "official_website", "direct_booking_url")
_TEXTS = ("title", "region", "observed_price_amount", "observed_price_unit",
          "host_external_id", "business_whatsapp", "canonical_property_key")


def _reject(code: str, message: Column | str, column: str) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(code).alias("code"), message.alias("message"),
                    F.lit(column).alias("column"))


def _quoted(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(f'{prefix} "'), value, F.lit('"'))


def validate_rows(
    raw: DataFrame,
    approved_sources: Sequence[str] | DataFrame,
    coverage: Coverage = Coverage(),
) -> DataFrame:
    """Add typed columns under ``row`` and the list of ``rejections`` to raw text rows.

    ``approved_sources`` is a short list, or a table with source_key.  Cells come back
    trimmed.
    """
    # Trimmed once here; everything below refers to the trimmed cells.
    df = raw.withColumns({
        c: tx.strip(F.coalesce(F.col(c), F.lit(""))) if c in raw.columns else F.lit("")
        for c in CSV_COLUMNS
    })
    given = {c: F.col(c) for c in CSV_COLUMNS}
    if isinstance(approved_sources, DataFrame):
        marks = approved_sources.select(
            F.col("source_key").alias("__approved")).distinct()
        df = df.join(marks, given["source_key"] == F.col("__approved"), "left")
        approved = F.col("__approved").isNotNull()
    else:
        approved = given["source_key"].isin(list(approved_sources))

    value = {c: F.when(given[c] != "", given[c]) for c in CSV_COLUMNS}
    # Parsed once as columns of their own, used by the checks and by the typed row.
    parsed = {
        "at": parse_timestamp(given["observed_at"]),
        "rating": tx.parse_decimal(value["rating"]),
        "reviews": tx.parse_integer(value["review_count"]),
        "lat": tx.parse_decimal(value["latitude"]),
        "lng": tx.parse_decimal(value["longitude"]),
        "currency": F.upper(value["observed_price_currency"]),
        **{c: parse_http_url(value[c], trimmed=True) for c in _URLS},
    }
    df = df.withColumns({f"__p_{name}": column for name, column in parsed.items()})
    p = {name: F.col(f"__p_{name}") for name in parsed}
    has_place = value["latitude"].isNotNull() | value["longitude"].isNotNull()
    place_ok = valid_point(p["lat"], p["lng"])
    covered = F.coalesce(within_coverage(p["lat"], p["lng"], coverage), F.lit(False))
    rating_ok = F.coalesce(p["rating"].between(0, 5), F.lit(False))
    currency_ok = F.coalesce(p["currency"].rlike("^[A-Z]{3}$"), F.lit(True))
    checks = [
        F.when(~approved, _reject("unknown_source", _quoted(
            "unknown or unapproved source", given["source_key"]), "source_key")),
        F.when(given["external_id"] == "", _reject(
            "missing_external_id", "external_id is required", "external_id")),
        F.when(p["at"].isNull(), _reject("invalid_timestamp", _quoted(
            "invalid observed_at", given["observed_at"]), "observed_at")),
        F.when(~given["observation_status"].isin(*OBSERVATION_STATUSES), _reject(
            "invalid_status", _quoted("invalid observation_status", given["observation_status"]),
            "observation_status")),
        F.when(value["rating"].isNotNull() & ~rating_ok, _reject(
            "rating_out_of_range", "rating must be within 0..5", "rating")),
        F.when(value["review_count"].isNotNull() & ~F.coalesce(p["reviews"] >= 0, F.lit(False)),
               _reject("negative_review_count", "review_count must be >= 0", "review_count")),
        F.when(has_place & ~place_ok, _reject(
            "invalid_coordinates", "latitude/longitude are not valid coordinates", "latitude")),
        F.when(has_place & place_ok & ~covered, _reject(
            "coordinates_outside_coverage",
            "coordinates fall outside the configured coverage", "latitude")),
        F.when(~currency_ok, _reject("unknown_currency", _quoted(
            "invalid currency", p["currency"]), "observed_price_currency")),
        *[F.when(value[c].isNotNull() & p[c].isNull(), _reject(
            "invalid_url", f"invalid URL in {c}", c)) for c in _URLS],
    ]
    typed = F.struct(
        given["source_key"].alias("source_key"), given["external_id"].alias("external_id"),
        p["source_url"].alias("source_url"), p["at"].alias("observed_at"),
        given["observation_status"].alias("observation_status"),
        F.when(has_place, p["lat"]).alias("latitude"),
        F.when(has_place, p["lng"]).alias("longitude"),
        p["rating"].alias("rating"), p["reviews"].alias("review_count"),
        p["currency"].alias("observed_price_currency"),
        # Lenient cells: what cannot be read counts as not collected.
        tx.parse_decimal(value["bedrooms"]).alias("bedrooms"),
        tx.parse_decimal(value["bathrooms"]).alias("bathrooms"),
        tx.parse_integer(value["guest_capacity"]).alias("guest_capacity"),
        tx.parse_boolean(value["is_superhost"]).alias("is_superhost"),
        p["official_website"].alias("official_website"),
        p["direct_booking_url"].alias("direct_booking_url"),
        *[value[c].alias(c) for c in _TEXTS],
    )
    rejections = F.filter(F.array(*checks), lambda r: r.isNotNull())
    return df.withColumns({"rejections": rejections, "row": typed}).drop(
        "__approved", *[f"__p_{name}" for name in parsed])


def row_signature(columns: Sequence[str]) -> Column:
    """Identity of a raw row: all its cells under sorted column names."""
    cells = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c), F.lit(""))) for c in sorted(columns)]
    return F.sha2(F.concat_ws("\u0001", *cells), 256)


def classify_rows(validated: DataFrame, signature_columns: Sequence[str],
                  scope: Sequence[str] = (), sized_by: DataFrame | None = None) -> DataFrame:
    """Add ``outcome``: accepted, rejected, duplicate or conflict.

    ``scope`` names columns (an import id, a file) inside which rows are compared;
    row_number must be unique within it.
    """
    valid = F.size("rejections") == 0
    df = validated.withColumn("__mine", F.when(
        valid, F.struct("row_number", row_signature(signature_columns).alias("s"))))
    keys = [*scope, "source_key", "external_id"]

    def body(part: DataFrame, segment: str | None) -> DataFrame:
        return running(part, keys, ["row_number"], [Scan("__first", "first", F.col("__mine"))],
                       segment=segment)

    df = by_key(df, keys, ["row_number"], body, sized_by)
    first, mine = F.col("__first"), F.col("__mine")
    outcome = (
        F.when(~valid, "rejected")
        .when(first["row_number"] == F.col("row_number"), "accepted")
        .when(first["s"] == mine["s"], "duplicate")
        .otherwise("conflict")
    )
    conflict = _reject("duplicate_conflict", F.concat(
        F.lit("conflicting duplicate for ("), F.col("source_key"), F.lit(", "),
        F.col("external_id"), F.lit(")")), "")
    return df.withColumn("outcome", outcome).withColumn("rejections", F.when(
        F.col("outcome") == "conflict",
        F.array(conflict.withField("column", F.lit(None).cast("string"))),
    ).otherwise(F.col("rejections"))).drop("__mine", "__first")


def process_import(raw: DataFrame, approved_sources, coverage: Coverage = Coverage(),
                   scope: Sequence[str] = ()) -> DataFrame:
    """Validate and classify raw rows (text columns plus row_number)."""
    cells = [c for c in raw.columns if c not in ("row_number", "file_path", *scope)]
    return classify_rows(validate_rows(raw, approved_sources, coverage), cells, scope)


def accepted_rows(classified: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return classified.filter(F.col("outcome") == "accepted").select(*keep, "row_number", "row.*")


def rejection_rows(classified: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per rejection reason, in row order within the reason list."""
    return classified.filter(F.size("rejections") > 0).select(
        *keep, "row_number", F.posexplode("rejections").alias("position", "r")
    ).select(*keep, "row_number", "position", "r.code", "r.message", "r.column")


def import_metrics(classified: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row totals; ``rejected`` counts reasons, not rows."""
    kind = F.col("outcome")
    return classified.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(kind == "accepted").alias("accepted"),
        F.coalesce(F.sum(F.size("rejections").cast("long")), F.lit(0)).alias("rejected"),
        F.count_if(kind == "duplicate").alias("duplicates"),
    ).withColumn("status", F.when(F.col("rejected") > 0, "completed_with_errors")
                 .otherwise("completed"))


def constraint_report(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Violations per named constraint (a NULL result passes), in one pass."""
    counted = df.agg(*[
        F.count_if(~F.coalesce(ok, F.lit(True))).alias(name) for name, ok in checks.items()])
    return counted.unpivot([], list(checks), "constraint_name", "violations")


def observation_constraints() -> dict[str, Column]:
    return {
        "rating_range": F.col("rating").between(0, 5),
        "review_count_not_negative": F.col("review_count") >= 0,
    }


def exactly_one(*columns: str) -> Column:
    """Exactly one of the columns is set (a watchlist item names one target)."""
    filled = [F.col(c).isNotNull().cast("int") for c in columns]
    total = filled[0]
    for f in filled[1:]:
        total = total + f
    return total == 1


def money_problems(amount: Column, currency: Column, unit: Column) -> Column:
    """Names of the parts of a money value that break its schema."""
    return F.filter(F.array(
        F.when(~F.coalesce(amount.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.lit(False)), F.lit("amount")),
        F.when(~F.coalesce(F.length(currency) == 3, F.lit(False)), F.lit("currency")),
        F.when(~F.coalesce(unit.isin("night", "stay", "unknown"), F.lit(False)), F.lit("unit")),
    ), lambda m: m.isNotNull())


def raw_observation_problems() -> Column:
    """Names of the parts of a raw observation that break its schema."""
    def bad(name: str, ok: Column) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))

    return F.filter(F.array(
        bad("source_key", F.length("source_key") > 0),
        bad("external_id", F.length("external_id") > 0),
        bad("observed_at", parse_timestamp("observed_at").isNotNull()
            & F.col("observed_at").rlike("(Z|[+-][0-9]{2}:[0-9]{2})$")),
        bad("observation_status", F.col("observation_status").isin(*OBSERVATION_STATUSES)),
        bad("source_url", F.col("source_url").isNull() | parse_http_url("source_url").isNotNull()),
        bad("evidence", F.length(F.col("evidence.method")) > 0),
    ), lambda m: m.isNotNull())
