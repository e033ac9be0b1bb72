"""Geodesy as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius used for chords, metres per degree, and the WGS84 ellipsoid.
SPHERE_RADIUS = 6_378_000.0
METRES_PER_DEGREE = 111_320.0
WGS84_A = 6_378_137.0
WGS84_F = 1 / 298.257223563


def distance_equirect(lat1: Column, lon1: Column, lat2: Column, lon2: Column, alt1: Column | None = None, alt2: Column | None = None) -> Column:
    """Local distance in metres; with altitudes in three dimensions."""
    dy = (lat2 - lat1) * METRES_PER_DEGREE
    dx = (lon2 - lon1) * METRES_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    flat = dx * dx + dy * dy
    return F.sqrt(flat if alt1 is None else flat + (alt2 - alt1) * (alt2 - alt1))


def to_cartesian(lat: Column, lon: Column, alt: Column, radius: float = SPHERE_RADIUS) -> tuple[Column, Column, Column]:
    """Sphere to axes x = east at the equator, y = north pole, z = zero meridian."""
    r, la, lo = alt + radius, F.radians(lat), F.radians(lon)
    return r * F.sin(lo) * F.cos(la), r * F.sin(la), r * F.cos(lo) * F.cos(la)


def to_gps(x: Column, y: Column, z: Column, radius: float = SPHERE_RADIUS) -> tuple[Column, Column, Column]:
    """Inverse of ``to_cartesian``: lat, lon, alt."""
    r = F.sqrt(x * x + y * y + z * z)
    return F.degrees(F.asin(y / r)), F.degrees(F.atan2(x, z)), r - radius


@dataclass(frozen=True)
class Origin:
    """Reference point of a local east-north-up frame."""

    lat: Column
    lon: Column
    alt: Column


def _ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    e2 = WGS84_F * (2 - WGS84_F)
    la, lo = F.radians(lat), F.radians(lon)
    n = WGS84_A / F.sqrt(1 - e2 * F.sin(la) * F.sin(la))
    return (n + alt) * F.cos(la) * F.cos(lo), (n + alt) * F.cos(la) * F.sin(lo), (n * (1 - e2) + alt) * F.sin(la)


def geodetic_to_enu(lat: Column, lon: Column, alt: Column, origin: Origin) -> tuple[Column, Column, Column]:
    """East, north, up of a point seen from the origin."""
    x, y, z = _ecef(lat, lon, alt)
    x0, y0, z0 = _ecef(origin.lat, origin.lon, origin.alt)
    dx, dy, dz = x - x0, y - y0, z - z0
    la, lo = F.radians(origin.lat), F.radians(origin.lon)
    east = -F.sin(lo) * dx + F.cos(lo) * dy
    out = F.cos(lo) * dx + F.sin(lo) * dy
    return east, F.cos(la) * dz - F.sin(la) * out, F.cos(la) * out + F.sin(la) * dz


def enu_to_geodetic(e: Column, n: Column, u: Column, origin: Origin) -> tuple[Column, Column, Column]:
    """lat, lon, alt of a local point, by Bowring's closed formula."""
    x0, y0, z0 = _ecef(origin.lat, origin.lon, origin.alt)
    la, lo = F.radians(origin.lat), F.radians(origin.lon)
    out = F.cos(la) * u - F.sin(la) * n
    x = x0 + F.cos(lo) * out - F.sin(lo) * e
    y = y0 + F.sin(lo) * out + F.cos(lo) * e
    z = z0 + F.cos(la) * n + F.sin(la) * u
    b = WGS84_A * (1 - WGS84_F)
    e2, ep2 = WGS84_F * (2 - WGS84_F), WGS84_A * WGS84_A / (b * b) - 1
    p = F.sqrt(x * x + y * y)
    t = F.atan2(z * WGS84_A, p * b)
    lat = F.atan2(z + ep2 * b * F.pow(F.sin(t), 3), p - e2 * WGS84_A * F.pow(F.cos(t), 3))
    turn = WGS84_A / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return F.degrees(lat), F.degrees(F.atan2(y, x)), p * F.cos(lat) + z * F.sin(lat) - turn * (1 - e2 * F.sin(lat) * F.sin(lat))


def bearing_segment(lat: Column, lon: Column, bearing_deg: Column, length: float) -> tuple[Column, Column, Column, Column]:
    """End points (lat, lon, lat, lon) of a segment centred on a point."""
    half = length / 2
    dlat = half * F.cos(F.radians(bearing_deg)) / METRES_PER_DEGREE
    dlon = half * F.sin(F.radians(bearing_deg)) / (METRES_PER_DEGREE * F.cos(F.radians(lat)))
    return lat - dlat, lon - dlon, lat + dlat, lon + dlon
