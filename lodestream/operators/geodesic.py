"""Geodesics on WGS 84 for any two points, and areas of polygons with geodesic edges.

After Karney, "Algorithms for geodesics" (2013): the inverse problem is one unknown,
the azimuth at the point of the greater latitude, for which the longitude that the
geodesic reaches grows from 0 to 180 degrees. It is found within a bracket, so that
every pair has an answer, antipodes included. The integrals of distance, longitude
and area over the auxiliary sphere are smooth, and Gauss-Legendre quadrature gives
them to double precision without tables of series.

Spark has no such solver, so these are Pandas UDFs over whole Arrow batches; all
rows of a batch are solved together. Points are longitude and latitude in degrees,
in struct columns as in ``geo``. A null point, or one that is not finite or not on the
earth (latitude beyond 90), gives null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS 84: equatorial radius in metres, flattening.
MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
_MINOR = MAJOR * (1 - FLATTENING)
_E2 = FLATTENING * (2 - FLATTENING)
_EP2 = _E2 / (1 - _E2)
#: Square of the radius of a sphere of the same area.
_C2 = MAJOR**2 / 2 + _MINOR**2 / 2 * np.arctanh(np.sqrt(_E2)) / np.sqrt(_E2)
EARTH = 4 * np.pi * _C2
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(20)
_ROUNDS = 80


def _integral(f, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    half, middle = (end - start) / 2, (end + start) / 2
    return half * (f(middle[:, None] + half[:, None] * _NODES) * _WEIGHTS).sum(axis=1)


def _arc(alpha: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> dict[str, np.ndarray]:
    """The geodesic that leaves reduced latitude b1 at azimuth alpha, up to where it comes northward by b2."""
    sa, ca, s1, c1, s2, c2 = np.sin(alpha), np.cos(alpha), np.sin(b1), np.cos(b1), np.sin(b2), np.cos(b2)
    ca = np.where(alpha == np.pi / 2, 0.0, ca)
    sa0, ca0 = sa * c1, np.hypot(ca, sa * s1)
    gap = np.where(c1 < -s1, (c2 - c1) * (c1 + c2), (s1 - s2) * (s1 + s2))  # of the squared cosines, without cancellation
    ca2 = np.where((c1 == c2) & (np.abs(s1) == np.abs(s2)), np.abs(ca), np.sqrt(np.maximum((ca * c1) ** 2 + gap, 0)) / np.maximum(c2, 1e-300))
    sig1, sig2 = np.arctan2(s1, ca * c1), np.arctan2(s2, ca2 * c2)
    om1, om2 = np.arctan2(sa0 * s1, ca * c1), np.arctan2(sa0 * s2, ca2 * c2)
    sig2 = np.where(sig2 < sig1, sig1, sig2)
    return {"sa0": sa0, "ca0": ca0, "sig1": sig1, "sig2": sig2, "om12": np.maximum(om2 - om1, 0.0), "alpha2": np.arctan2(sa0, ca2 * c2), "k2": _EP2 * ca0 * ca0}


def _longitude(alpha: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    x = _arc(alpha, b1, b2)
    k2 = x["k2"][:, None]
    i3 = _integral(lambda s: (2 - FLATTENING) / (1 + (1 - FLATTENING) * np.sqrt(1 + k2 * np.sin(s) ** 2)), x["sig1"], x["sig2"])
    return x["om12"] - FLATTENING * x["sa0"] * i3


def _azimuth(b1: np.ndarray, b2: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Where ``_longitude`` is ``gap``: inverse quadratic steps inside a bracket that shrinks in every round."""
    low, high = np.zeros_like(gap), np.full_like(gap, np.pi)
    f_low, f_high = -gap, np.pi - gap  # straight to the north, straight to the south over the pole
    old, f_old = high.copy(), f_high.copy()
    part = np.full_like(gap, 0.5)
    best = np.where(np.abs(f_low) < np.abs(f_high), low, high)
    going = (gap > 0) & (gap < np.pi)
    a, fa, b, fb = low, f_low, high, f_high
    for _ in range(_ROUNDS):
        if not going.any():
            break
        i = np.flatnonzero(going)
        x = a[i] + part[i] * (b[i] - a[i])
        f = _longitude(x, b1[i], b2[i]) - gap[i]
        same = np.sign(f) == np.sign(fa[i])
        # the new place takes the side of its sign; the one it replaces stays as third point
        old[i], f_old[i] = np.where(same, a[i], b[i]), np.where(same, fa[i], fb[i])
        b[i], fb[i] = np.where(same, b[i], a[i]), np.where(same, fb[i], fa[i])
        a[i], fa[i] = x, f
        nearer = np.abs(fa[i]) < np.abs(fb[i])
        best[i] = np.where(nearer, a[i], b[i])
        width = np.abs(b[i] - a[i])
        limit = 2.5e-16 * np.maximum(np.abs(best[i]), 1e-300) / np.maximum(width, 1e-300)
        done = (f == 0) | (limit >= 0.5)
        with np.errstate(all="ignore"):
            xi, phi = (a[i] - b[i]) / (old[i] - b[i]), (fa[i] - fb[i]) / (f_old[i] - fb[i])
            quadratic = (phi**2 < xi) & ((1 - phi) ** 2 < 1 - xi)
            t = fa[i] / (fb[i] - fa[i]) * f_old[i] / (fb[i] - f_old[i]) + (old[i] - a[i]) / (b[i] - a[i]) * fa[i] / (f_old[i] - fa[i]) * fb[i] / (f_old[i] - fb[i])
        t = np.where(quadratic & np.isfinite(t), t, 0.5)
        part[i] = np.clip(t, np.minimum(limit, 0.5), np.maximum(1 - limit, 0.5))
        going[i[done]] = False
    return best


def inverse(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Metres between points, and the signed area between each geodesic and the equator; NaN for points that are none."""
    lon1, lat1, lon2, lat2 = (np.asarray(v, np.float64) for v in (lon1, lat1, lon2, lat2))
    good = np.isfinite(lon1) & np.isfinite(lon2) & (np.abs(lat1) <= 90) & (np.abs(lat2) <= 90)
    out = np.full((2, len(lon1)), np.nan)
    if not good.any():
        return out[0], out[1]
    x1, y1, x2, y2 = lon1[good], lat1[good], lon2[good], lat2[good]
    gap = np.remainder(x2 - x1 + 180, 360) - 180
    gap = np.where((gap == -180) & (x2 > x1), 180.0, gap)
    way = np.where(gap < 0, -1.0, 1.0)
    gap = np.radians(np.abs(gap))
    # the point of the greater latitude first, and in the south
    swap = np.abs(y1) < np.abs(y2)
    first, second = np.where(swap, y2, y1), np.where(swap, y1, y2)
    up = np.where(first > 0, -1.0, 1.0)
    reduced = lambda y: np.arctan2((1 - FLATTENING) * np.sin(np.radians(y)), np.where(np.abs(y) == 90, 0.0, np.cos(np.radians(y))))
    b1, b2 = reduced(first * up), reduced(second * up)
    b1 = np.where(b1 == 0, -0.0, b1)
    equator = (b1 == 0) & (gap <= (1 - FLATTENING) * np.pi)
    pole = np.abs(first) == 90  # any azimuth leads along a meridian
    alpha = np.zeros_like(gap)
    solve = ~equator & ~pole & (gap > 0) & (gap < np.pi)
    alpha[solve] = _azimuth(b1[solve], b2[solve], gap[solve])
    alpha = np.where(equator & (gap > 0), np.pi / 2, np.where(~equator & ~pole & (gap >= np.pi), np.pi, np.where(pole, gap, alpha)))
    x = _arc(np.where(pole, 0.0, alpha), b1, b2)
    k2 = x["k2"][:, None]
    meters = _MINOR * _integral(lambda s: np.sqrt(1 + k2 * np.sin(s) ** 2), x["sig1"], x["sig2"])
    meters = np.where(equator, MAJOR * gap, meters)

    def t(v: np.ndarray) -> np.ndarray:
        root = np.sqrt(np.maximum(v, 1e-300))
        return v + np.where(v > 0, np.sqrt(1 + v) / root * np.arcsinh(root), 1.0)

    def slope(v: np.ndarray) -> np.ndarray:
        """(t(e'^2) - t(v)) / (e'^2 - v); where they are near each other, the derivative halfway."""
        apart = _EP2 - v
        near = apart < 1e-7
        middle = (_EP2 + v) / 2
        with np.errstate(all="ignore"):
            step = 1e-5
            return np.where(near, (t(middle + step) - t(middle - step)) / (2 * step), (t(np.full_like(v, _EP2)) - t(v)) / np.where(near, 1.0, apart))

    i4 = -_integral(lambda s: slope(k2 * np.sin(s) ** 2) * np.sin(s) / 2, x["sig1"], x["sig2"])
    turn = np.where(pole, 0.0, x["alpha2"] - alpha)
    # from a pole the azimuths are the meridians' own: the geodesic leaves along one and stays on it
    area = _C2 * turn + _E2 * MAJOR**2 * x["ca0"] * x["sa0"] * i4
    area = np.where(equator, 0.0, np.where(pole, _C2 * -gap, area))
    out[0, good], out[1, good] = meters, area * way * up  # changing the ends over turns both the way and the sign
    return out[0], out[1]


def _between(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    meters = pd.Series(inverse(lon1, lat1, lon2, lat2)[0])
    return meters.astype(object).where(meters.notna(), None)


def _paths(lons: pd.Series, lats: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All steps of all paths (lon, lat, lon, lat), the row of each, and which rows are paths."""
    known = np.array([x is not None and len(x) > 0 for x in lons])
    rows = [(np.asarray(x, np.float64), np.asarray(y, np.float64)) for x, y, k in zip(lons, lats, known, strict=True) if k]
    empty = np.empty(0)
    steps = [np.concatenate([v[part] for v in (r[side] for r in rows)]) if rows else empty for part in (slice(None, -1), slice(1, None)) for side in (0, 1)]
    owner = np.repeat(np.flatnonzero(known), [len(r[0]) - 1 for r in rows]) if rows else np.empty(0, np.int64)
    return *steps, owner, known


def _length(lons: pd.Series, lats: pd.Series) -> pd.Series:
    lon1, lat1, lon2, lat2, owner, known = _paths(lons, lats)
    total = np.bincount(owner, inverse(lon1, lat1, lon2, lat2)[0], minlength=len(lons))
    out = pd.Series(np.where(known, total, np.nan))
    return out.astype(object).where(out.notna(), None)


def _area(lons: pd.Series, lats: pd.Series) -> pd.Series:
    lon1, lat1, lon2, lat2, owner, known = _paths(lons, lats)
    total = np.bincount(owner, inverse(lon1, lat1, lon2, lat2)[1], minlength=len(lons))
    # a ring that crosses the prime meridian an odd number of times goes around a pole
    norm = lambda v: np.remainder(v + 180, 360) - 180
    a, b, gap = norm(lon1), norm(lon2), norm(lon2 - lon1)
    crossed = np.where((a <= 0) & (b > 0) & (gap > 0), 1, np.where((b <= 0) & (a > 0) & (gap < 0), -1, 0))
    odd = np.bincount(owner, crossed, minlength=len(lons)).astype(np.int64) % 2 == 1
    total = np.where(odd, total + np.where(total < 0, 1, -1) * EARTH / 2, total)
    total = np.abs(total)
    out = pd.Series(np.where(known, np.minimum(total, EARTH - total), np.nan))
    return out.astype(object).where(out.notna(), None)


def _axes(path: Column) -> tuple[Column, Column]:
    return F.transform(path, lambda p: p["x"]), F.transform(path, lambda p: p["y"])


def geodesic_distance(p: Column, q: Column) -> Column:
    """Metres along the shortest geodesic."""
    return F.pandas_udf(_between, "double")(p["x"], p["y"], q["x"], q["y"])


def geodesic_line_length(path: Column) -> Column:
    """Metres of all steps of a path; 0 for one point, null for none or where a point is none."""
    return F.pandas_udf(_length, "double")(*_axes(path))


def geodesic_area(ring: Column) -> Column:
    """Square metres inside a simple ring with geodesic edges, whatever its direction: the smaller of both sides of it."""
    return F.pandas_udf(_area, "double")(*_axes(ring))
