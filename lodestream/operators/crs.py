"""Coordinates from one reference system to another, as built-in expressions.

Known codes: EPSG:4326 (longitude, latitude in degrees), EPSG:3857 (Web Mercator),
EPSG:32601 to 32660 and 32701 to 32760 (UTM on WGS 84), EPSG:25828 to 25838 (UTM on
ETRS89), EPSG:2154 (Lambert-93) and EPSG:3034 (the conic of Europe). Any other code
raises ``KernelError`` with the category ``crs``. Others can be given as a
``TransverseMercator`` or ``LambertConic`` of their own. x is always the easting or
longitude. WGS 84 and ETRS89 count as one datum.

The transverse Mercator is Krueger's series in the third flattening to the fourth
order, right to a tenth of a micrometre within ten degrees of the central meridian
and to a millimetre within 45; the conic is closed. Both invert the isometric
latitude by eight contractions, each of which gains two digits. A point that is null
or not finite, or that a projection cannot show (a latitude beyond 90, a pole on
Mercator or on the far side of a cone, over 45 degrees from the central meridian of
a transverse one), becomes null, and so does a null path.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream.operators.table import KernelError

#: Equatorial radius and flattening. Fixed values.
WGS84 = (6378137.0, 1 / 298.257223563)
GRS80 = (6378137.0, 1 / 298.257222101)
_REACH = 45.0


def _point(x: Column, y: Column, shown: Column) -> Column:
    finite = ~(F.isnan(x) | F.isnan(y) | (F.abs(x) == math.inf) | (F.abs(y) == math.inf))
    return F.when(shown & finite, F.struct(x.alias("x"), y.alias("y")))


def _let(value: Column, f) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _turned(degrees: Column) -> Column:
    """Into -180 up to 180."""
    return F.pmod(degrees + 180, F.lit(360.0)) - 180


def _eccentricity(flattening: float) -> float:
    return math.sqrt(flattening * (2 - flattening))


def _isometric(latitude: Column, e: float) -> Column:
    s = F.sin(F.radians(latitude))
    return F.atanh(s) - e * F.atanh(e * s)


def _isometric_of(latitude: float, e: float) -> float:
    s = math.sin(math.radians(latitude))
    return math.atanh(s) - e * math.atanh(e * s)


def _latitude(isometric: Column, e: float) -> Column:
    s = F.tanh(isometric)
    for _ in range(8):
        s = F.tanh(isometric + e * F.atanh(e * s))
    return F.degrees(F.asin(s))


@dataclass(frozen=True)
class Geographic:
    """Longitude and latitude in degrees."""

    def forward(self, p: Column) -> Column:
        return _point(p["x"], p["y"], F.abs(p["y"]) <= 90)

    inverse = forward


@dataclass(frozen=True)
class WebMercator:
    radius: float = WGS84[0]

    def forward(self, p: Column) -> Column:
        return _point(self.radius * F.radians(p["x"]), self.radius * F.atanh(F.sin(F.radians(p["y"]))), F.abs(p["y"]) < 90)

    def inverse(self, p: Column) -> Column:
        return _point(F.degrees(p["x"] / self.radius), F.degrees(F.asin(F.tanh(p["y"] / self.radius))), F.lit(True))


@dataclass(frozen=True)
class TransverseMercator:
    """Angles in degrees; the false origin in the unit of ``ellipsoid``'s radius."""

    ellipsoid: tuple[float, float]
    meridian: float
    latitude: float = 0.0
    scale: float = 0.9996
    easting: float = 500_000.0
    northing: float = 0.0

    def _terms(self) -> tuple[float, float, tuple[float, ...], tuple[float, ...]]:
        """Eccentricity, scaled radius of the rectifying sphere, Krueger's coefficients both ways (fixed values)."""
        major, flattening = self.ellipsoid
        n = flattening / (2 - flattening)
        there = (
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140,
            49561 * n**4 / 161280,
        )
        back = (
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840,
            4397 * n**4 / 161280,
        )
        return _eccentricity(flattening), self.scale * major / (1 + n) * (1 + n**2 / 4 + n**4 / 64), there, back

    def _origin(self) -> float:
        """What is taken from a northing: the meridian's arc up to ``latitude``."""
        e, radius, there, _ = self._terms()
        xi = math.atan(math.sinh(_isometric_of(self.latitude, e)))
        return radius * (xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(there, 1))) - self.northing

    def forward(self, p: Column) -> Column:
        e, radius, there, _ = self._terms()
        away = _turned(p["x"] - self.meridian)

        def placed(s: Column) -> Column:
            x = s["eta"] + sum(a * F.cos(2 * j * s["xi"]) * F.sinh(2 * j * s["eta"]) for j, a in enumerate(there, 1))
            y = s["xi"] + sum(a * F.sin(2 * j * s["xi"]) * F.cosh(2 * j * s["eta"]) for j, a in enumerate(there, 1))
            return _point(radius * x + self.easting, radius * y - self._origin(), s["shown"])

        def sphere(s: Column) -> Column:
            xi, eta = F.atan2(s["t"], F.cos(s["l"])), F.asinh(F.sin(s["l"]) / F.hypot(s["t"], F.cos(s["l"])))
            return _let(F.struct(xi.alias("xi"), eta.alias("eta"), s["shown"].alias("shown")), placed)

        shown = (F.abs(p["y"]) < 90) & (F.abs(away) <= _REACH)
        return _let(F.struct(F.sinh(_isometric(p["y"], e)).alias("t"), F.radians(away).alias("l"), shown.alias("shown")), sphere)

    def inverse(self, p: Column) -> Column:
        e, radius, _, back = self._terms()

        def placed(s: Column) -> Column:
            isometric = F.asinh(F.sin(s["xi"]) / F.hypot(F.sinh(s["eta"]), F.cos(s["xi"])))
            away = F.degrees(F.atan2(F.sinh(s["eta"]), F.cos(s["xi"])))
            return _point(_turned(away + self.meridian), _latitude(isometric, e), F.abs(away) <= _REACH + 1e-9)

        def sphere(s: Column) -> Column:
            xi = s["xi"] - sum(b * F.sin(2 * j * s["xi"]) * F.cosh(2 * j * s["eta"]) for j, b in enumerate(back, 1))
            eta = s["eta"] - sum(b * F.cos(2 * j * s["xi"]) * F.sinh(2 * j * s["eta"]) for j, b in enumerate(back, 1))
            return _let(F.struct(xi.alias("xi"), eta.alias("eta")), placed)

        return _let(F.struct(((p["y"] + self._origin()) / radius).alias("xi"), ((p["x"] - self.easting) / radius).alias("eta")), sphere)


@dataclass(frozen=True)
class LambertConic:
    """Conformal, with two standard parallels. Angles in degrees."""

    ellipsoid: tuple[float, float]
    parallels: tuple[float, float]
    meridian: float
    latitude: float
    easting: float
    northing: float

    def _terms(self) -> tuple[float, float, float, float]:
        """Eccentricity, the cone's constant, and the radii of isometric latitude 0 and of the origin."""
        major, flattening = self.ellipsoid
        e = _eccentricity(flattening)
        one, two = self.parallels
        width = lambda x: math.cos(math.radians(x)) / math.sqrt(1 - (e * math.sin(math.radians(x))) ** 2)
        n = math.sin(math.radians(one))
        if one != two:
            n = math.log(width(one) / width(two)) / (_isometric_of(two, e) - _isometric_of(one, e))
        radius = major * width(one) / n * math.exp(n * _isometric_of(one, e))
        return e, n, radius, radius * math.exp(-n * _isometric_of(self.latitude, e))

    def forward(self, p: Column) -> Column:
        e, n, radius, origin = self._terms()
        polar = F.struct((radius * F.exp(-n * _isometric(p["y"], e))).alias("rho"), F.radians(n * _turned(p["x"] - self.meridian)).alias("turn"))
        return _let(polar, lambda s: _point(self.easting + s["rho"] * F.sin(s["turn"]), self.northing + origin - s["rho"] * F.cos(s["turn"]), F.abs(p["y"]) < 90))

    def inverse(self, p: Column) -> Column:
        e, n, radius, origin = self._terms()
        sign = math.copysign(1.0, n)
        x, y = sign * (p["x"] - self.easting), sign * (origin - p["y"] + self.northing)
        away = F.degrees(F.atan2(x, y)) / n
        return _point(_turned(away + self.meridian), _latitude(-F.log(F.hypot(x, y) / abs(radius)) / n, e), F.abs(away) <= 180)


def system(code: str) -> Geographic | WebMercator | TransverseMercator | LambertConic:
    """The reference system of a code such as ``EPSG:32632``."""
    name, _, digits = code.partition(":")
    number = int(digits) if name.upper() == "EPSG" and digits.isascii() and digits.isdigit() else 0
    if number == 4326:
        return Geographic()
    if number == 3857:
        return WebMercator()
    if 32601 <= number <= 32660 or 32701 <= number <= 32760:
        return TransverseMercator(WGS84, (number % 100) * 6 - 183, northing=0.0 if number < 32700 else 10_000_000.0)
    if 25828 <= number <= 25838:
        return TransverseMercator(GRS80, (number % 100) * 6 - 183)
    if number == 2154:
        return LambertConic(GRS80, (49.0, 44.0), 3.0, 46.5, 700_000.0, 6_600_000.0)
    if number == 3034:
        return LambertConic(GRS80, (35.0, 65.0), 10.0, 52.0, 4_000_000.0, 2_800_000.0)
    raise KernelError("crs", f"unknown reference system: {code}")


def reproject(path: Column, source, target) -> Column:
    """An array of points from ``source`` to ``target``: codes, or systems."""
    start, end = (system(s) if isinstance(s, str) else s for s in (source, target))
    if start == end:
        return path
    return F.transform(path, lambda p: end.forward(p) if start == Geographic() else start.inverse(p) if end == Geographic() else _let(start.inverse(p), end.forward))
