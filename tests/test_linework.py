"""Sewn lines, faces and repaired rings on small shapes with known results."""

import random

from pyspark.sql import functions as F

from lodestream.operators import geo as G
from lodestream.operators import linework as L

KINDS = f"g int, k long, path {G.PATH}"


def table(spark, lines):
    return spark.createDataFrame([(g, k, None if p is None else [{"x": float(x), "y": float(y)} for x, y in p]) for g, k, p in lines], KINDS)


def points(path):
    return [(p.x, p.y) for p in path]


def test_chain_ring_and_junction_merge(spark):
    chain = [[(x, 0), (x + 1, 0)] for x in range(30)]
    ring = [[(0, 9), (1, 9)], [(1, 10), (1, 9)], [(1, 10), (0, 9)]]
    star = [[(50, 50), (51, 50)], [(50, 50), (50, 51)], [(50, 50), (49, 50)]]
    rng = random.Random(3)
    lines = [(1, k, p[::-1] if rng.random() < 0.5 else p) for k, p in enumerate(rng.sample(chain, 30) + ring + star)]
    got = L.line_merge(table(spark, [*lines, (2, 900, [(3, 0), (3, 5)]), (2, 901, None), (2, 902, [])]), ["g"], "k", "path").collect()
    assert sorted(len(r.path) for r in got) == [2, 2, 2, 2, 4, 31]
    long = points(max((r.path for r in got), key=len))
    assert long in ([(float(x), 0.0) for x in range(31)], [(float(x), 0.0) for x in range(30, -1, -1)])
    closed = next(points(r.path) for r in got if len(r.path) == 4)
    assert closed[0] == closed[-1] and set(closed) == {(0, 9), (1, 9), (1, 10)}
    assert {r.g for r in got if r.k == 900} == {2}


def test_faces_of_a_grid_with_dangles(spark):
    grid = [[(x, y), (x + 1, y)] for x in range(3) for y in range(3)] + [[(x, y), (x, y + 1)] for x in range(4) for y in range(2)]
    loose = [[(0, 0), (-1, -1)], [(-1, -1), (-2, -1)], [(-1, -1), (-1, -2)], [(20, 20), (21, 21)]]
    lines = [(g, k, p) for g in (1, 2) for k, p in enumerate(grid + loose)]
    got = L.polygonize(table(spark, lines), ["g"], "k", "path").withColumn("area", G.area(F.col("ring"))).collect()
    assert sorted((r.g, r.area, len(r.ring)) for r in got) == [(g, 1.0, 5) for g in (1, 2) for _ in range(6)]
    assert len({(r.g, min(points(r.ring))) for r in got}) == 12
    assert L.polygonize(table(spark, []), ["g"], "k", "path").collect() == []


def test_bow_tie_becomes_two_triangles(spark):
    rings = [(0, 1, [(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)]), (0, 2, [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]), (0, 3, [(0, 0), (4, 0), (9, 0), (4, 0), (4, 4), (0, 4), (0, 0)]), (0, 4, None), (0, 5, [(0, 0), (3, 0), (0, 0)])]
    got = L.make_valid(table(spark, rings).drop("g"), "k", "path").withColumn("area", G.area(F.col("path"))).collect()
    assert sorted((r.k, r.area) for r in got) == [(1, 4.0), (1, 4.0), (2, 16.0), (3, 16.0)]
