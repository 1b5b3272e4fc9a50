"""Universal Transverse Mercator as column expressions: Krüger's series to the fourth order, metres within a millimetre
of the exact projection in a zone."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS 84 ellipsoid and the scale and offsets of the projection.
A, FLATTENING = 6_378_137.0, 1 / 298.257223563
SCALE, EAST_0, SOUTH_0 = 0.9996, 500_000.0, 10_000_000.0

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORTH = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BACK = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_E = 2 * math.sqrt(_N) / (1 + _N)


def zone(lon: Column) -> Column:
    """The zone of a longitude, 1 to 60."""
    return (F.floor((lon + 180) / 6) % 60 + 1).cast("int")


def to_utm(lat: Column, lon: Column, of_zone: Column) -> Column:
    """struct(x, y) in metres of a position in a zone; y counts from the equator, below it from 10,000 km."""
    turn = F.radians(lon - (of_zone * 6 - 183))
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for k, a in enumerate(_FORTH, 1):
        x = x + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        y = y + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return F.struct((EAST_0 + SCALE * _RADIUS * x).alias("x"), (SCALE * _RADIUS * y + F.when(lat < 0, SOUTH_0).otherwise(0.0)).alias("y"))


def from_utm(x: Column, y: Column, of_zone: Column, south: Column) -> Column:
    """struct(lat, lon) of a place in a zone."""
    xi = (y - F.when(south, SOUTH_0).otherwise(0.0)) / (SCALE * _RADIUS)
    eta = (x - EAST_0) / (SCALE * _RADIUS)
    a, b = xi, eta
    for k, c in enumerate(_BACK, 1):
        a = a - c * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        b = b - c * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    # The latitude of a conformal one, by rounds of a contraction with factor 0.007.
    lat, q = chi, F.atanh(F.sin(chi))
    for _ in range(5):
        lat = F.asin(F.tanh(q + _E * F.atanh(_E * F.sin(lat))))
    return F.struct(F.degrees(lat).alias("lat"), (F.degrees(F.atan2(F.sinh(b), F.cos(a))) + of_zone * 6 - 183).alias("lon"))
