"""Web Mercator on fixed-point degrees (1e-7) and a 2^32 grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import hilbert

GRID = 4294967296.0
LAST = 4294967295


def clamp(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def mercator_x(lon: Column) -> Column:
    """Unit x of a longitude in degrees."""
    return clamp(lon / 360.0 + 0.5)


def mercator_y(lat: Column) -> Column:
    """Unit y of a latitude in degrees; at the south pole, where the logarithm fails, 1."""
    phi = lat * (math.pi / 180.0)
    return clamp(F.coalesce((1.0 - F.ln(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0, F.lit(1.0)))


def grid(unit: Column) -> Column:
    return F.least(F.floor(unit * GRID), F.lit(LAST).cast("long"))


def lonlat_to_xy(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Grid point of fixed-point degrees."""
    return grid(mercator_x(lon / 1e7)), grid(mercator_y(lat / 1e7))


def with_location(df: DataFrame, lon: Column, lat: Column) -> DataFrame:
    """``df`` with x, y and h of fixed-point degrees."""
    x, y = lonlat_to_xy(lon, lat)
    df = df.withColumns({"x": x, "y": y})
    return hilbert.with_h(df, df["x"], df["y"])


def _fixed(degrees: Column) -> Column:
    scaled = degrees * 1e7
    return F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)).cast("int")


def xy_to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees of a grid point; the grid is taken as 2^32 - 1 wide on the way back."""
    ux, uy = x.cast("double") / float(LAST), y.cast("double") / float(LAST)
    lat = 2.0 * F.atan(F.exp((1.0 - 2.0 * uy) * math.pi)) - math.pi / 2.0
    return (ux - 0.5) * 360.0, lat * (180.0 / math.pi)


def xy_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    lon, lat = xy_to_degrees(x, y)
    return _fixed(lon), _fixed(lat)
