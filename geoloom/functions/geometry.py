"""Geometry as Column expressions: areas, distances, directions, projections."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_area(ring: Column) -> Column:
    """Signed area of a ring array<struct<x, y>>, open or closed (shoelace)."""
    moved = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, moved, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v) / 2


def ring_length(ring: Column) -> Column:
    moved = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, moved, lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])), F.lit(0.0), lambda s, v: s + v)


def mean_width(ring: Column) -> Column:
    return 2 * F.abs(ring_area(ring)) / F.nullif(ring_length(ring), F.lit(0.0))


def bearing(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(bx - ax, by - ay)) + 360.0, F.lit(360.0))


def turn(a: Column, b: Column) -> Column:
    """Smallest angle between two bearings."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, F.lit(360.0) - d)


def rotated(x: Column, y: Column, degrees: float, scale: float = 1.0) -> tuple[Column, Column]:
    c, s = math.cos(math.radians(degrees)) * scale, math.sin(math.radians(degrees)) * scale
    return x * c - y * s, x * s + y * c


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    r = 6378137.0
    return F.radians(lon) * r, F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * r


def utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Transverse Mercator on WGS84 by the series in the third flattening, to well under a millimetre within the zone."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = eta + sum(al * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, al in enumerate(alpha, 1))
    north = xi + sum(al * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, al in enumerate(alpha, 1))
    return east * (0.9996 * big) + 500000.0, north * (0.9996 * big) + (10_000_000.0 if south else 0.0)


def smoothstep(v: Column, low: float, high: float) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low)))
    return t * t * (3 - 2 * t)


def excess_green(r: Column, g: Column, b: Column) -> Column:
    total = F.nullif(r + g + b, F.lit(0.0))
    return (2 * g - r - b) / total


def logistic(values: Column, weights: list[float], bias: float) -> Column:
    """Logistic score of a feature array."""
    w = F.array(*(F.lit(float(x)) for x in weights))
    return 1 / (1 + F.exp(-(F.aggregate(F.zip_with(values, w, lambda a, b: a.cast("double") * b), F.lit(float(bias)), lambda s, v: s + v))))


def metres(mm: Column | float, scale: float) -> Column:
    """Millimetres on paper to metres."""
    return (mm if isinstance(mm, Column) else F.lit(float(mm))) * (scale / 1000.0)
