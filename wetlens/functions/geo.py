"""Projection between longitude/latitude and the national grid, as Columns.

Krueger's series of order four for the transverse Mercator projection on GRS80
(central meridian 27 degrees, scale 0.9996, false easting 500 km).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A_GRS80, F_GRS80 = 6378137.0, 1 / 298.257222101
CENTRAL, SCALE, FALSE_EAST = 27.0, 0.9996, 500000.0
#: Limits of a usable ground point: 100000 < easting < 800000, 6600000 < northing < 7800000.
EAST, NORTH = (100000.0, 800000.0), (6600000.0, 7800000.0)

_n = F_GRS80 / (2 - F_GRS80)
_ECC = 2 * math.sqrt(_n) / (1 + _n)
RADIUS = SCALE * A_GRS80 / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
ALPHA = (
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180,
    13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440,
    61 * _n**3 / 240 - 103 * _n**4 / 140,
    49561 * _n**4 / 161280,
)
BETA = (
    _n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360,
    _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440,
    17 * _n**3 / 480 - 37 * _n**4 / 840,
    4397 * _n**4 / 161280,
)
DELTA = (
    2 * _n - 2 * _n**2 / 3 - 2 * _n**3 + 116 * _n**4 / 45,
    7 * _n**2 / 3 - 8 * _n**3 / 5 - 227 * _n**4 / 45,
    56 * _n**3 / 15 - 136 * _n**4 / 35,
    4279 * _n**4 / 630,
)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(terms) -> Column:
    total = None
    for t in terms:
        total = t if total is None else total + t
    return total


def to_grid(lon: Column, lat: Column) -> Column:
    """struct<e, n> in metres of longitude and latitude in degrees; NULL gives NULLs."""

    def conformal(p):
        s = F.sin(F.radians(p["lat"]))
        return F.struct(
            F.sinh(F.atanh(s) - F.lit(_ECC) * F.atanh(F.lit(_ECC) * s)).alias("t"),
            F.radians(p["lon"] - F.lit(CENTRAL)).alias("d"),
        )

    def sphere(q):
        return F.struct(
            F.atan2(q["t"], F.cos(q["d"])).alias("xi"),
            F.atanh(F.sin(q["d"]) / F.sqrt(F.lit(1.0) + q["t"] * q["t"])).alias("eta"),
        )

    def plane(s):
        xi, eta = s["xi"], s["eta"]
        e = eta + _sum(F.lit(a) * F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j)) for j, a in enumerate(ALPHA, 1))
        n = xi + _sum(F.lit(a) * F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j)) for j, a in enumerate(ALPHA, 1))
        return F.struct((F.lit(FALSE_EAST) + F.lit(RADIUS) * e).alias("e"), (F.lit(RADIUS) * n).alias("n"))

    point = F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))
    return _let(_let(_let(point, conformal), sphere), plane)


def to_lonlat(e: Column, n: Column) -> Column:
    """struct<lon, lat> in degrees of grid metres; NULL gives NULLs."""

    def sphere(p):
        xi, eta = p["xi"], p["eta"]
        return F.struct(
            (xi - _sum(F.lit(b) * F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j)) for j, b in enumerate(BETA, 1))).alias("xi"),
            (eta - _sum(F.lit(b) * F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j)) for j, b in enumerate(BETA, 1))).alias("eta"),
        )

    def conformal(s):
        return F.struct(
            F.asin(F.sin(s["xi"]) / F.cosh(s["eta"])).alias("chi"),
            F.atan2(F.sinh(s["eta"]), F.cos(s["xi"])).alias("d"),
        )

    def degrees(q):
        chi = q["chi"]
        lat = chi + _sum(F.lit(d) * F.sin(chi * (2.0 * j)) for j, d in enumerate(DELTA, 1))
        return F.struct((F.lit(CENTRAL) + F.degrees(q["d"])).alias("lon"), F.degrees(lat).alias("lat"))

    point = F.struct(
        (n.cast("double") / F.lit(RADIUS)).alias("xi"),
        ((e.cast("double") - F.lit(FALSE_EAST)) / F.lit(RADIUS)).alias("eta"),
    )
    return _let(_let(_let(point, sphere), conformal), degrees)


def _inside(e: Column, n: Column) -> Column:
    return (e > EAST[0]) & (e < EAST[1]) & (n > NORTH[0]) & (n < NORTH[1])


def _degrees(lon: Column, lat: Column) -> Column:
    return lon.between(-5.0, 59.0) & lat.between(50.0, 80.0)


def position(x: Column, y: Column) -> Column:
    """struct<e, n>: the ground point that x and y denote, else NULL.

    Tried in this order, the first inside the limits counts: easting and northing;
    the two exchanged; longitude and latitude in degrees; latitude and longitude.
    NULL, NaN, infinite and other values give NULL.
    """
    x, y = x.cast("double"), y.cast("double")

    def checked(p):
        return F.when(_inside(p["e"], p["n"]), p)

    def plain(e, n):
        return F.struct(e.alias("e"), n.alias("n"))

    return (
        F.when(_inside(x, y), plain(x, y))
        .when(_inside(y, x), plain(y, x))
        .when(_degrees(x, y), _let(to_grid(x, y), checked))
        .when(_degrees(y, x), _let(to_grid(y, x), checked))
    )
