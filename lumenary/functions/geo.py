"""Points on the globe: arrays of latitude and longitude in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_M = 6_371_008.8


def point(c: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude, and whether ``c`` is a point: two numbers in range."""
    lat, lon = F.try_element_at(c, F.lit(1)).cast("double"), F.try_element_at(c, F.lit(2)).cast("double")
    ok = F.coalesce((F.size(c) == 2) & lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))
    return lat, lon, ok


def haversine(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Metres from (lat0, lon0) along a great circle."""
    half = lambda x: F.pow(F.sin(x / 2), F.lit(2.0))
    h = half(F.radians(lat) - F.radians(F.lit(float(lat0)))) + F.cos(F.radians(lat)) * F.cos(F.radians(F.lit(float(lat0)))) * half(F.radians(lon) - F.radians(F.lit(float(lon0))))
    return F.lit(2 * RADIUS_M) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def within_radius(c: Column, lat0: float, lon0: float, metres: float) -> Column:
    lat, lon, ok = point(c)
    return ok & F.coalesce(haversine(lat, lon, lat0, lon0) <= F.lit(float(metres)), F.lit(False))


def within_box(c: Column, south: float, west: float, north: float, east: float) -> Column:
    """Whether the point is in the box; one whose west is beyond its east spans the antimeridian."""
    lat, lon, ok = point(c)
    across = (lon >= west) & (lon <= east) if west <= east else (lon >= west) | (lon <= east)
    return ok & F.coalesce(lat.between(south, north) & across, F.lit(False))
