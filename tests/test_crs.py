"""Reference systems against published points, and both ways."""

import pytest
from pyspark.sql import functions as F

from lodestream.operators import crs
from lodestream.operators import geo as G
from lodestream.operators.table import KernelError


def moved(spark, points, source, target):
    df = spark.createDataFrame([([(float(x), float(y)) if x is not None else None for x, y in points],)], "p array<struct<x:double,y:double>>")
    return [None if p is None else (p.x, p.y) for p in df.select(crs.reproject(F.col("p"), source, target).alias("p")).first().p]


def test_published_points(spark):
    assert moved(spark, [(44.4, 33.3)], "EPSG:4326", "EPSG:32638")[0] == pytest.approx((444140.54, 3684706.36), abs=0.005)
    # worked examples of the registry's guidance note 7-2
    british = crs.TransverseMercator((6377563.396, 1 / 299.32496), -2.0, 49.0, 0.9996012717, 400_000.0, -100_000.0)
    assert moved(spark, [(0.5, 50.5)], "EPSG:4326", british)[0] == pytest.approx((577274.99, 69740.50), abs=0.01)
    texan = crs.LambertConic((20925832.16, 1 / 294.97870), (28 + 23 / 60, 30 + 17 / 60), -99.0, 27 + 50 / 60, 2_000_000.0, 0.0)
    assert moved(spark, [(-96.0, 28.5)], "EPSG:4326", texan)[0] == pytest.approx((2963503.91, 254759.80), abs=0.02)
    assert moved(spark, [(3.0, 46.5)], "EPSG:4326", "EPSG:2154")[0] == pytest.approx((700_000, 6_600_000), abs=1e-6)
    assert moved(spark, [(10.0, 52.0)], "EPSG:4326", "EPSG:3034")[0] == pytest.approx((4_000_000, 2_800_000), abs=1e-6)


@pytest.mark.parametrize("code, west, east, south, north", [("EPSG:32632", -10, 28, -80, 84), ("EPSG:32701", -180, -160, -80, 0), ("EPSG:25832", 0, 18, 30, 84), ("EPSG:2154", -20, 30, 20, 75), ("EPSG:3034", -40, 60, 10, 80), ("EPSG:3857", -180, 179, -85, 85)])
def test_round_trips(spark, code, west, east, south, north):
    points = [(west + (east - west) * i / 12, south + (north - south) * j / 12) for i in range(13) for j in range(13)]
    there = moved(spark, points, "EPSG:4326", code)
    for p, q in zip(points, moved(spark, there, code, "EPSG:4326"), strict=True):
        apart = (q[0] - p[0] + 180) % 360 - 180, q[1] - p[1]  # -180 and 180 are one meridian
        assert apart == pytest.approx((0, 0), abs=5e-9)  # half a millimetre
    # by way of another system
    if code == "EPSG:2154":
        other = moved(spark, there[60:100], code, "EPSG:3034")
        for p, q in zip(there[60:100], moved(spark, other, "EPSG:3034", code), strict=True):
            assert q == pytest.approx(p, abs=1e-3)


def test_a_degree_along_the_meridian_is_its_arc(spark):
    (_, y0), (_, y1) = moved(spark, [(9, 0), (9, 90 - 1e-9)], "EPSG:4326", "EPSG:32632")
    assert (y1 - y0) / 0.9996 == pytest.approx(10001965.729, abs=0.002)  # a quarter of the meridian


def test_points_that_cannot_be_shown(spark):
    odd = [(None, None), (float("nan"), 1.0), (9.0, 91.0), (9.0, 90.0), (100.0, 0.0)]
    assert moved(spark, odd, "EPSG:4326", "EPSG:32632") == [None] * 5
    assert moved(spark, odd[:4], "EPSG:4326", "EPSG:3857") == [None] * 4
    assert moved(spark, [(181.0, 10.0)], "EPSG:4326", "EPSG:32701")[0] == pytest.approx(moved(spark, [(-179.0, 10.0)], "EPSG:4326", "EPSG:32701")[0])
    for code in ("EPSG:32661", "EPSG:1", "EPSG:", "ESRI:102", "wgs84"):
        with pytest.raises(KernelError) as error:
            crs.reproject(F.array(G.point(F.lit(0.0), F.lit(0.0))), "EPSG:4326", code)
        assert error.value.category == "crs"
    df = spark.createDataFrame([(None,), ([],)], "p array<struct<x:double,y:double>>")
    assert [r.p for r in df.select(crs.reproject(F.col("p"), "EPSG:4326", "EPSG:32632").alias("p")).collect()] == [None, []]
