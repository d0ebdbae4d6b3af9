"""Configured listings as a source: emits what it is given, nothing from a network."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.constants import FIXTURE_PARSER_VERSION
from tidewatch.operators.snapshots import presence_map

_COLLECTED = ("title", "latitude", "longitude", "rating", "review_count", "price_amount",
              "price_currency", "price_unit", "host_external_id", "direct_booking_url")


def fixture_observations(listings: DataFrame, source_key: str, requested_at: str,
                         external_ids: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Observations of the configured listings; only active ones carry field values.

    ``external_ids`` narrows the run: a short list, or a table with external_id.
    """
    df = listings
    if isinstance(external_ids, DataFrame):
        df = df.join(external_ids.select("external_id"), "external_id", "left_semi")
    elif external_ids is not None:
        df = df.filter(F.col("external_id").isin(list(external_ids)))
    active = F.col("observation_status") == "active"
    df = df.withColumns({c: F.when(active, F.col(c)) for c in _COLLECTED if c in df.columns})
    given = lambda c: F.col(c).isNotNull() if c in df.columns else F.lit(False)
    present = {
        "title": given("title"), "location": given("latitude") & given("longitude"),
        "rating": given("rating"), "review_count": given("review_count"),
        "price": given("price_amount"), "host_external_id": given("host_external_id"),
        "direct_booking_url": given("direct_booking_url"),
    }
    return df.withColumns({
        "source_key": F.lit(source_key),
        "observed_at": F.lit(requested_at).cast("timestamp"),
        "parser_version": F.lit(FIXTURE_PARSER_VERSION),
        "field_presence": presence_map(present),
        "evidence": F.struct(F.lit("fixture").alias("method"),
                             F.lit("controlled fixture data").alias("notes")),
    })

