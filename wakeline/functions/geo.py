"""Geometry as column expressions. Angles are degrees, distances kilometres unless named otherwise."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean Earth radius for distances, sphere radius for destinations, length of a degree.
EARTH_KM, EARTH_M, KM_PER_DEGREE = 6371.0088, 6371000.0, 111.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # least() would take 1 for an unknown h.
    return F.when((lat1 + lon1 + lat2 + lon2).isNotNull(), 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h))))


def haversine_of(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """The same over arrays; NaN where a place is unknown."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def degrees_apart(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt(F.pow(lat1 - lat2, 2) + F.pow(lon1 - lon2, 2))


def local_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Equirectangular kilometres east and north of (lat0, lon0)."""
    return F.radians(lon - lon0) * F.cos(F.radians(lat0)) * EARTH_KM, F.radians(lat - lat0) * EARTH_KM


def to_segment(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """(distance, share t of the leg) from the origin to the leg (x1, y1)-(x2, y2); a leg without length counts as its start, t = 0."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    t = F.when(length2 == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(x1 * dx + y1 * dy) / length2)))
    return F.hypot(x1 + t * dx, y1 + t * dy), t


def destination(lat: Column, lon: Column, bearing: Column, metres: Column) -> tuple[Column, Column]:
    """Great-circle destination (lat, lon); the longitude is not wrapped."""
    p, a, b = F.radians(lat), metres / EARTH_M, F.radians(bearing)
    lat2 = F.asin(F.sin(p) * F.cos(a) + F.cos(p) * F.sin(a) * F.cos(b))
    lon2 = F.radians(lon) + F.atan2(F.sin(b) * F.sin(a) * F.cos(p), F.cos(a) - F.sin(p) * F.sin(lat2))
    return F.degrees(lat2), F.degrees(lon2)


def combined_score(km: Column, seconds: Column, alpha: float = 1.0, scale_km: float = 6.0, scale_hours: float = 3.0) -> Column:
    return km / scale_km + alpha * (seconds / 3600.0) / scale_hours
