"""Longitudes, circular means, the sphere and the polar plane."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def lon180(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon.cast("double") + 180.0, F.lit(360.0)) - 180.0


def lon360(lon: Column, eps: float = 1e-9) -> Column:
    """Longitude in [0, 360); values next to 360 become 0."""
    x = F.pmod(lon.cast("double"), F.lit(360.0))
    return F.when(F.abs(x - 360.0) < eps, 0.0).otherwise(x)


def circular_mean(lon: Column) -> Column:
    """Aggregate: the direction of the mean unit vector, in degrees."""
    r = F.radians(lon)
    return F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r))))


def as_degrees(angle: Column, greatest: Column, units: Column | None = None) -> Column:
    """Radians are told by their units, or where these say nothing by their range."""
    by_range = F.when(greatest <= 2 * math.pi + 1e-6, F.degrees(angle)).otherwise(angle)
    if units is None:
        return by_range
    u = F.lower(units)
    return F.when(u.contains("radian"), F.degrees(angle)).when(u.contains("degree"), angle).otherwise(by_range)


def unit_xyz(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    a, b = F.radians(lon), F.radians(lat)
    return F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)


def chord_km(chord: Column) -> Column:
    """Great-circle distance of two points from the chord of their unit vectors."""
    return 2 * EARTH_KM * F.asin(F.least(chord / 2, F.lit(1.0)))


def central_meridian(lon_min: Column, lon_max: Column) -> Column:
    """The middle of a box, across the date line if it wraps; a box right around has its edge as its middle."""
    west, east = lon180(lon_min), lon180(lon_max)
    middle = (west + F.when(west > east, east + 360.0).otherwise(east)) / 2
    return F.when(middle > 180.0, middle - 360.0).otherwise(middle)


#: The WGS 84 ellipsoid and the standard parallel of the southern polar stereographic plane.
A, E2, PARALLEL = 6378137.0, 0.00669437999014, 71.0
E = math.sqrt(E2)


def _t(phi: float) -> float:
    return math.tan(math.pi / 4 - phi / 2) / ((1 - E * math.sin(phi)) / (1 + E * math.sin(phi))) ** (E / 2)


_PHI = math.radians(PARALLEL)
_SCALE = A * math.cos(_PHI) / math.sqrt(1 - E2 * math.sin(_PHI) ** 2) / _t(_PHI)


def polar_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Southern polar stereographic metres, true at 71 degrees south."""
    phi, lam = F.radians(-lat), F.radians(lon)
    es = F.sin(phi) * E
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - es) / (1 + es), F.lit(E / 2))
    return F.sin(lam) * t * _SCALE, F.cos(lam) * t * _SCALE


def polar_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    """The inverse, by the series in the conformal latitude."""
    chi = F.lit(math.pi / 2) - 2 * F.atan(F.sqrt(x * x + y * y) / _SCALE)
    c2 = E2 / 2 + 5 * E2**2 / 24 + E2**3 / 12 + 13 * E2**4 / 360
    c4 = 7 * E2**2 / 48 + 29 * E2**3 / 240 + 811 * E2**4 / 11520
    c6 = 7 * E2**3 / 120 + 81 * E2**4 / 1120
    lat = chi + c2 * F.sin(2 * chi) + c4 * F.sin(4 * chi) + c6 * F.sin(6 * chi)
    return F.degrees(F.atan2(x, y)), -F.degrees(lat)


def spherical_area(lat_lo: Column, lat_hi: Column, dlon: Column, radius: float = 6_371_000.0) -> Column:
    """Area of a latitude-longitude cell in square metres."""
    return F.lit(radius * radius) * F.radians(F.abs(dlon)) * F.abs(F.sin(F.radians(lat_hi)) - F.sin(F.radians(lat_lo)))
