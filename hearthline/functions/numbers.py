"""Numbers: lenient casts, distances, bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Earth's radius in km, side of a grid cell in degrees, cells each way.
EARTH_KM, CELL_DEGREES, REACH = 6371.0, 0.02, 2
#: Edges of the price bands.
PRICE_EDGES = (350_000, 600_000, 900_000, 1_400_000, 2_200_000)
_LARGEST = 1.7976931348623157e308


def to_double(c: Column) -> Column:
    """A finite number, or null."""
    x = c.try_cast("double")
    return F.when((x >= -_LARGEST) & (x <= _LARGEST), x)


def to_long(c: Column) -> Column:
    """Truncated toward zero, or null."""
    return to_double(c).cast("long")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(EARTH_KM) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def cell(degrees: Column) -> Column:
    return F.floor(degrees / F.lit(CELL_DEGREES))


def price_band(c: Column) -> Column:
    """0 to 5; an edge belongs to the band above it."""
    return reduce(lambda a, b: a + b, [(c >= F.lit(float(e))).cast("int") for e in PRICE_EDGES])


def rounded(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def whole(c: Column) -> Column:
    """Rounded half to even, as a whole number."""
    return F.bround(c, 0).cast("long")
