"""Geodesics against published lines, exact cases and each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.operators import geodesic as D

#: Published inverse problems on WGS 84: lat, lon, lat, lon, metres.
LINES = [
    (40.6, -73.8, 51.6, -0.5, 5551759.400319), (-41.32, 174.81, 40.96, -5.50, 19959679.267354), (-30.0, 0.0, 29.9, 179.8, 19989832.827610),
    (-30.12345, 0.0, -30.12344, 0.00005, 4.944208), (40.0, 0.0, 41.79331020506, 137.84490004377, 10_000_000.0), (0.0, 0.0, 0.0, 180.0, 20003931.458625), (0.0, 0.0, 90.0, 0.0, 10001965.729313),
]


def metres(rows):
    lat1, lon1, lat2, lon2 = np.array(rows, float).T[:4]
    return D.inverse(lon1, lat1, lon2, lat2)[0]


def test_published_lines():
    assert metres(LINES) == pytest.approx([r[4] for r in LINES], abs=1e-5)


def test_exact_cases():
    y = np.linspace(-90, 90, 37)
    rng = np.random.default_rng(1)
    x = rng.uniform(-180, 180, 37)
    half = D.inverse([0.0], [0.0], [180.0], [0.0])[0][0]
    assert D.inverse(x, y, x + 180, -y)[0] == pytest.approx(np.full(37, half), abs=1e-6)  # antipodes lie half a meridian apart
    assert D.inverse(x, y, x, y)[0] == pytest.approx(np.zeros(37), abs=1e-8)
    grid = np.linspace(0, 179, 50)
    assert D.inverse(np.zeros(50), np.zeros(50), grid, np.zeros(50))[0] == pytest.approx(D.MAJOR * np.radians(grid), abs=1e-7)
    fine = np.radians(np.linspace(-50, 70, 200_001))
    radius = D.MAJOR * (1 - D._E2) / (1 - D._E2 * np.sin(fine) ** 2) ** 1.5
    arc = np.sum((radius[:-2:2] + 4 * radius[1:-1:2] + radius[2::2]) * (np.radians(120) / 200_000) / 3)
    assert D.inverse([13.0], [-50.0], [13.0], [70.0])[0][0] == pytest.approx(arc, abs=1e-6)
    bad = D.inverse([0.0, np.nan, 0.0], [91.0, 0.0, 0.0], [0.0, 0.0, np.inf], [0.0, 0.0, 0.0])[0]
    assert np.isnan(bad).all()


def test_near_antipodes_are_solved_and_consistent():
    """Symmetry, the triangle inequality by points on the way, and bounds: never null, never beyond half a meridian."""
    rng = np.random.default_rng(2)
    n = 4000
    y1, x1 = rng.uniform(-90, 90, n), rng.uniform(-180, 180, n)
    y2, x2 = np.clip(-y1 + rng.normal(0, 0.6, n), -90, 90), x1 + 180 + rng.normal(0, 0.6, n)
    there, back = D.inverse(x1, y1, x2, y2)[0], D.inverse(x2, y2, x1, y1)[0]
    assert np.isfinite(there).all() and there == pytest.approx(back, abs=1e-6)
    assert (there <= 20003931.4586255).all() and (there > 1.95e7).all()
    y3, x3 = rng.uniform(-90, 90, n), rng.uniform(-180, 180, n)
    assert (there <= D.inverse(x1, y1, x3, y3)[0] + D.inverse(x3, y3, x2, y2)[0] + 1e-6).all()
    mirrored = D.inverse(-x1, -y1, -x2, -y2)[0]
    assert there == pytest.approx(mirrored, abs=1e-6)


def ring_frame(spark, rings):
    return spark.createDataFrame([(k, r) for k, r in enumerate(rings)], "k int, ring array<struct<x:double,y:double>>")


def test_areas(spark):
    octant = [(0.0, 0.0), (90.0, 0.0), (0.0, 90.0), (0.0, 0.0)]
    cap = [(float(x), 60.0) for x in range(-180, 181, 2)]
    antarctica = [(-58.0, -63.1), (-74.0, -72.9), (-102.0, -71.9), (-102.0, -74.9), (-131.0, -74.3), (-163.0, -77.5), (163.0, -77.4), (172.0, -71.7), (140.0, -65.9), (113.0, -65.7), (88.0, -66.6), (59.0, -66.9), (25.0, -69.8), (-4.0, -70.0), (-14.0, -71.0), (-33.0, -77.3), (-46.0, -77.9), (-61.0, -74.7), (-58.0, -63.1)]
    small = [(10.0, 50.0), (10.001, 50.0), (10.001, 50.001), (10.0, 50.001), (10.0, 50.0)]
    df = ring_frame(spark, [octant, octant[::-1], antarctica, cap, small, None, []])
    got = [r.a for r in df.select("k", D.geodesic_area(F.col("ring")).alias("a")).orderBy("k").collect()]
    assert got[:2] == pytest.approx([D.EARTH / 8] * 2, rel=1e-12) and got[5:] == [None, None]
    assert got[2] == pytest.approx(13662703680020.1, abs=2.0)  # published
    cut = ring_frame(spark, [[(0.0, 10.0), (30.0, 20.0), (0.0, 90.0), (0.0, 10.0)], [(0.0, 10.0), (30.0, 20.0), (30.0, 0.0), (0.0, 0.0), (0.0, 10.0)], [(0.0, 0.0), (30.0, 0.0), (0.0, 90.0), (0.0, 0.0)]])
    upper, lower, whole = (r.a for r in cut.select("k", D.geodesic_area(F.col("ring")).alias("a")).orderBy("k").collect())
    assert upper + lower == pytest.approx(whole, rel=1e-12) and whole == pytest.approx(D.EARTH / 24, rel=1e-12)
    b = np.arctanh(np.sqrt(D._E2) * np.sin(np.radians(60))) / np.sqrt(D._E2)
    beyond = np.pi * D.MAJOR**2 * (1 - D._E2) * (np.sin(np.radians(60)) / (1 - D._E2 * np.sin(np.radians(60)) ** 2) + b)
    assert got[3] == pytest.approx(D.EARTH / 2 - beyond, rel=2e-4)  # the parallel bulges beyond its chords
    square = 111229.0 * 0.001 * 111320 * np.cos(np.radians(50.0005)) * 0.001
    assert got[4] == pytest.approx(square, rel=5e-3)


def test_columns(spark):
    df = spark.createDataFrame([(0.0, 0.0, 179.7, 0.5), (None, 0.0, 1.0, 1.0), (0.0, 95.0, 1.0, 1.0)], "a double, b double, c double, d double")
    got = [r.d for r in df.select(D.geodesic_distance(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("c").alias("x"), F.col("d").alias("y"))).alias("d")).collect()]
    assert got[0] == pytest.approx(19944127.421, abs=1e-2) and got[1:] == [None, None]
    lines = ring_frame(spark, [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], [(5.0, 5.0)], [], None])
    assert [r.n for r in lines.select("k", D.geodesic_line_length(F.col("ring")).alias("n")).orderBy("k").collect()] == [pytest.approx(D.MAJOR * np.radians(1) + 110574.38855780, abs=1e-4), 0.0, None, None]
