"""Distances, angles and numeric steps as Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two circles of the earth are in use, and metres of a degree along a meridian.
EARTH_M, COARSE_PI = 6_373_000.0, 3.14
EARTH_KM = 6371.0
DEGREE_M = 111173.444444444


def coarse_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine with a coarse pi."""
    rad = lambda x: x * (COARSE_PI / 180)
    a = F.pow(F.sin(rad(lat2 - lat1) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin(rad(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    rad = lambda x: x * (math.pi / 180)
    a = F.pow(F.sin(rad(lat2 - lat1) / 2), 2) + F.cos(rad(lat1)) * F.cos(rad(lat2)) * F.pow(F.sin(rad(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def angle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, squared: bool = False) -> Column:
    """Degrees apart, longitudes around the circle: the sum of both differences, or the root of their squares."""
    lat, lon = F.abs(lat1 - lat2), F.least(F.abs(lon1 - lon2), 360 - F.abs(lon1 - lon2))
    return F.sqrt(lat * lat + lon * lon) if squared else lat + lon


def least_angle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, squared: bool = False) -> Column:
    """The smaller of the angle and that with the first side's coordinates swapped."""
    return F.least(angle(lat1, lon1, lat2, lon2, squared), angle(lon1, lat1, lat2, lon2, squared))


def north_and_east(distance: Column, lat1: Column, lat2: Column) -> tuple[Column, Column]:
    north = DEGREE_M * F.abs(lat1 - lat2)
    return north, F.sqrt(F.greatest(F.lit(0.0), distance * distance - north * north))


def log_step(x: Column) -> Column:
    """exp(round(ln(x + 1), 1)) - 0.5."""
    return F.exp(F.bround(F.ln(x + 1), 1)) - 0.5


def log_step_inside(x: Column) -> Column:
    """exp(round(ln(x + 1), 1) - 0.5)."""
    return F.exp(F.bround(F.ln(x + 1), 1) - 0.5)


def distance_step(x: Column) -> Column:
    """Logarithmic steps, to tens, at most 100,000."""
    return F.least(F.lit(100000.0), F.bround(log_step_inside(x) / 10) * 10)


def median_ratio(distance: Column, median: Column) -> Column:
    """Distance over a median, in logarithmic steps, at most 800."""
    return F.least(F.lit(800.0), F.exp(F.bround(F.ln(1 + distance / median), 1)) - 1)


def capped_ratio(x: Column, y: Column, small: float = 1e-1, most: float = 1e5) -> Column:
    """x / (y + small), at most `most`, which also stands for what isn't a number."""
    ratio = x / (y + small)
    return F.when(ratio <= most, ratio).otherwise(F.lit(most))


def other_hemisphere(lon1: Column, lon2: Column, lat1: Column, lat2: Column) -> Column:
    """lon2 with its sign changed, if that brings two places of nearly one latitude together and they are apart otherwise."""
    return F.when((F.abs(lon1 + lon2) < 0.1) & (F.abs(lat1 - lat2) < 0.1) & (F.abs(lon1 - lon2) > 1), -lon2).otherwise(lon2)


def cell(x: Column, width: float) -> Column:
    return F.floor(x / width).cast("long")
