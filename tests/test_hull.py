"""Concave hulls, and nearest points with k and without matches."""

from math import dist

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.operators import geo as G
from lodestream.operators import hull as H

ELL = [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (4, 1), (4, 2), (3, 2), (2, 2), (2, 3), (2, 4), (1, 4), (0, 4), (0, 3), (0, 2), (0, 1)]


def shapes(spark, rows):
    return spark.createDataFrame([(k, None if r is None else [{"x": x, "y": y} for x, y in r]) for k, r in rows], f"k int, p {G.PATH}")


def ring(row):
    return row and [(p["x"], p["y"]) for p in row]


def test_concave_hull(spark):
    float_ell = [(float(x), float(y)) for x, y in ELL]
    rows = [(0, float_ell), (1, None), (2, []), (3, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]), (4, [(0.0, 0.0), (4.0, 0.0), (0.0, 3.0), (1.0, 1.0)]), (5, float_ell * 2 + [(None, 1.0)])]
    found = {r.k: ring(r.h) for r in shapes(spark, rows).select("k", H.concave_hull(F.col("p"), max_edge=1.2).alias("h")).collect()}
    assert found[1] is found[2] is found[3] is None
    assert set(found[0]) == set(float_ell) and found[0][0] == found[0][-1] and found[5] == found[0]
    convex = {r.k: ring(r.h) for r in shapes(spark, rows).select("k", H.concave_hull(F.col("p"), ratio=1.0).alias("h")).collect()}
    assert (2.0, 2.0) not in convex[0] and convex[4] == [(0.0, 0.0), (4.0, 0.0), (0.0, 3.0), (0.0, 0.0)]
    assert shapes(spark, []).select(H.concave_hull(F.col("p"), ratio=0.5)).count() == 0
    with pytest.raises(ValueError):
        H.concave_hull(F.col("p"))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=3, max_size=25), st.floats(0, 1))
def test_triangulation_is_delaunay_and_hulls_are_simple(points, ratio):
    points = sorted((float(x), float(y)) for x, y in points)
    third = H._delaunay(points)
    if not third:
        assert H._hull(points, ratio, None) is None
        return
    for (a, b), c in third.items():
        assert H._turn(a, b, c) > 0 and third[b, c] == a
        assert not any(H._in_circle(a, b, c, p) for p in points)
    assert {p for e in third for p in e} == set(points)
    hull = H._hull(points, ratio, None)
    assert hull[0] == hull[-1] and len(set(hull)) == len(hull) - 1
    assert sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(hull, hull[1:])) > 0


def test_nearest_k_and_unmatched(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0)], "k int, x double, y double").select("k", G.point("x", "y").alias("p"))
    right = [(1, 1.0, 0.0), (2, 0.0, 1.0), (3, 2.0, 0.0), (4, 9.0, 0.0)]
    sites = spark.createDataFrame(right, "r int, x double, y double").select("r", G.point("x", "y").alias("q"))
    found = {(r.k, r.rank, r.r, r.distance) for r in G.nearest(left, sites, "k", "r", "p", "q", 5.0, k=2).collect()}
    assert found == {(1, 1, 1, 1.0), (1, 2, 2, 1.0)}
    kept = {(r.k, r.r, r.distance) for r in G.nearest(left, sites, "k", "r", "p", "q", 5.0, how="left").collect()}
    assert kept == {(1, 1, dist((0, 0), (1, 0))), (2, None, None)}
