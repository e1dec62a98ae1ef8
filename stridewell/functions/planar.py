"""Flat-map approximations for drawing a city."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Km per degree of latitude, and the latitude at which degrees of longitude are measured.
KM_PER_DEGREE = 111.32
LATITUDE = 40.7


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, latitude: float = LATITUDE) -> Column:
    """Distance on a flat map whose longitudes are scaled at one latitude."""
    return F.hypot((lat2 - lat1) * KM_PER_DEGREE, (lon2 - lon1) * KM_PER_DEGREE * F.cos(F.radians(F.lit(latitude))))


def padded(low: Column, high: Column, least: float, pad: float = 0.25) -> Column:
    """(low, high) of an interval widened by a share on both sides and to at least a size around its middle."""
    half = F.greatest((high - low) / 2 * (1 + 2 * pad), F.lit(least / 2))
    return F.struct(((low + high) / 2 - half).alias("low"), ((low + high) / 2 + half).alias("high"))
