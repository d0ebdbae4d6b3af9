"""Coordinates: display rounding, validity, coverage and distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.config import Coverage
from tidewatch.constants import EARTH_RADIUS_M


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c: Column | str, decimals: int) -> Column:
    """Halves go towards plus infinity: -8.6475 becomes -8.647."""
    factor = float(10 ** max(0, decimals))
    c = _col(c).cast("double")
    return F.floor(c * factor + 0.5) / factor


def round_coordinate(c: Column | str, decimals: int = 3) -> Column:
    c = _col(c).cast("double")
    finite = ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.when(finite, round_half_up(c, decimals)).otherwise(c)


def valid_point(lat: Column | str, lng: Column | str) -> Column:
    lat, lng = _col(lat), _col(lng)
    return F.coalesce(lat.between(-90, 90) & lng.between(-180, 180), F.lit(False))


def within_coverage(lat: Column | str, lng: Column | str, area: Coverage = Coverage()) -> Column:
    lat, lng = _col(lat), _col(lng)
    return lat.between(area.lat_min, area.lat_max) & lng.between(area.lng_min, area.lng_max)


def haversine_m(lat1, lng1, lat2, lng2) -> Column:
    lat1, lng1, lat2, lng2 = map(_col, (lat1, lng1, lat2, lng2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * (
        half_lng * half_lng)
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))
