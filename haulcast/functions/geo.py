"""Great-circle geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EARTH_RADIUS_KM


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """SQL text of ``haversine_km`` over column names."""
    a = (
        f"pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1}))"
        f" * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)"
    )
    # rounding can push antipodal points just above 1
    return f"({2 * EARTH_RADIUS_KM}D * asin(sqrt(CASE WHEN {a} > 1 THEN 1D ELSE {a} END)))"


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km between two points given in degrees (names or columns)."""
    if all(isinstance(c, str) for c in (lat1, lon1, lat2, lon2)):
        return F.expr(haversine_sql(lat1, lon1, lat2, lon2))
    lat1, lon1, lat2, lon2 = (F.radians(_col(c)) for c in (lat1, lon1, lat2, lon2))
    sin_lat = F.sin((lat2 - lat1) / 2)
    sin_lon = F.sin((lon2 - lon1) / 2)
    a = sin_lat * sin_lat + F.cos(lat1) * F.cos(lat2) * sin_lon * sin_lon
    safe = F.when(a > 1.0, F.lit(1.0)).otherwise(a)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(safe))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial heading from point 1 to point 2, in degrees in (-180, 180]."""
    lat1, lon1, lat2, lon2 = (F.radians(_col(c)) for c in (lat1, lon1, lat2, lon2))
    east = F.sin(lon2 - lon1) * F.cos(lat2)
    north = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(lon2 - lon1)
    return F.degrees(F.atan2(east, north))


def wrap_180(angle: Column) -> Column:
    """Wrap a difference of headings to (-180, 180]."""
    return (
        F.when(angle > 180.0, angle - 360.0).when(angle <= -180.0, angle + 360.0).otherwise(angle)
    )
