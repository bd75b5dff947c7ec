"""Nearest neighbours, distances and joins by distance against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.operators import geo as G
from lodestream.operators import neighbours as N


def frame(spark, xy, key, p):
    rows = [(i, *(None if v is None else float(v) for v in (xy_ or (None, None)))) for i, xy_ in xy]
    return spark.createDataFrame(rows, f"{key} long, x double, y double").select(key, F.when(F.col("x").isNotNull(), G.point("x", "y")).alias(p))


def brute(left, right, k):
    out = {}
    for i, p in left:
        if p is None:
            continue
        d = sorted((float(np.hypot(p[0] - q[0], p[1] - q[1])), j) for j, q in right if q is not None)
        out[i] = [(j, float(f"{x:.9g}")) for x, j in d[:k]]
    return out


@pytest.mark.parametrize("k, leaf", [(1, 64), (3, 4), (60, 8)])
def test_nearest_without_a_limit(spark, k, leaf, monkeypatch):
    monkeypatch.setattr(N, "LEAF", leaf)
    rng = np.random.default_rng(k)
    crowd = np.round(rng.normal(500, 1e-3, (450, 2)), 6)  # nine tenths of all points in one small place
    right = list(enumerate([*map(tuple, crowd), *map(tuple, rng.uniform(0, 1000, (40, 2))), (-1e6, 3e5), (7.0, 7.0), (7.0, 7.0), (7.0, 7.0), None]))
    left = list(enumerate([*map(tuple, rng.uniform(0, 1000, (60, 2))), *map(tuple, crowd[:20]), (1e7, -1e7), (7.0, 7.0), (-1e6, 3e5), None]))
    a, b = frame(spark, left, "k", "p"), frame(spark, right, "j", "q")
    got = {}
    for r in sorted(N.nearest(a, b, "k", "j", "p", "q", k).collect(), key=lambda r: r.rank):
        got.setdefault(r.k, []).append((r.j, float(f"{r.distance:.9g}")))
    assert got == brute(left, right, k)
    kept = N.nearest(a, b, "k", "j", "p", "q", k, how="left").where("j IS NULL").collect()
    assert [r.k for r in kept] == [left[-1][0]]


def test_nearest_of_few_points(spark):
    a = frame(spark, [(1, (0, 0)), (2, (5, 5))], "k", "p")
    none, one = frame(spark, [(1, None)], "j", "q"), frame(spark, [(4, (3, 4)), (3, (3, 4))], "j", "q")
    assert N.nearest(a, none, "k", "j", "p", "q").collect() == [] and N.nearest(a, none, "k", "j", "p", "q", how="left").count() == 2
    assert sorted((r.k, r.j, r.distance) for r in N.nearest(a, one, "k", "j", "p", "q").where("k = 1").collect()) == [(1, 3, 5.0)]
    assert [(r.j, r.rank) for r in N.nearest(a, one, "k", "j", "p", "q", 5).where("k = 2").orderBy("rank").collect()] == [(3, 1), (4, 2)]
    assert N.nearest(a.limit(0), one, "k", "j", "p", "q").collect() == []


def segment_distance(a, b, c, d):
    def to(p, u, v):
        w = (v[0] - u[0], v[1] - u[1])
        n = w[0] ** 2 + w[1] ** 2
        f = 0 if n == 0 else max(0, min(1, ((p[0] - u[0]) * w[0] + (p[1] - u[1]) * w[1]) / n))
        return np.hypot(u[0] + w[0] * f - p[0], u[1] + w[1] * f - p[1])

    cross = lambda o, u, v: (u[0] - o[0]) * (v[1] - o[1]) - (u[1] - o[1]) * (v[0] - o[0])
    if cross(a, b, c) * cross(a, b, d) < 0 and cross(c, d, a) * cross(c, d, b) < 0:
        return 0.0
    return min(to(a, c, d), to(b, c, d), to(c, a, b), to(d, a, b))


def brute_distance(a, b):
    inside = lambda ring, p: len(ring) > 3 and ring[0] == ring[-1] and sum((u[1] > p[1]) != (v[1] > p[1]) and p[0] < (v[0] - u[0]) * (p[1] - u[1]) / (v[1] - u[1]) + u[0] for u, v in zip(ring, ring[1:])) % 2 == 1  # noqa: E731, B905
    if inside(a, b[0]) or inside(b, a[0]):
        return 0.0
    pieces = lambda p: list(zip(p, p[1:])) or [(p[0], p[0])]  # noqa: E731, B905
    return min(segment_distance(*s, *t) for s in pieces(a) for t in pieces(b))


def some_shapes(rnd, n):
    """Points, lines and concave rings."""
    out = []
    for k in range(n):
        x, y = rnd.uniform(0, 40), rnd.uniform(0, 40)
        if k % 3 == 0:
            out.append([(x, y)])
        elif k % 3 == 1:
            out.append([(x + rnd.uniform(-4, 4), y + rnd.uniform(-4, 4)) for _ in range(4)])
        else:
            w = rnd.uniform(1, 5)
            out.append([(x, y), (x + w, y), (x + w, y + w), (x + w / 2, y + w / 4), (x, y + w), (x, y)])
    return out


def test_shape_distances_and_joins(spark):
    rnd = random.Random(6)
    a, b = some_shapes(rnd, 45), some_shapes(rnd, 45)
    path = lambda shapes, key, name: spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], f"{key} long, {name} array<struct<x:double,y:double>>")
    left, right = path(a, "k", "a"), path(b, "j", "b")
    want = {(i, j): float(brute_distance(s, t)) for i, s in enumerate(a) for j, t in enumerate(b)}
    got = {(r.k, r.j): r.d for r in left.crossJoin(right).select("k", "j", N.shape_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-9) for x in want)
    for within, size in ((1.5, 3.0), (6.0, 2.0), (0.0, 5.0)):
        near = {x for x, d in want.items() if d <= within}
        some = {i for i, _ in near}
        found = lambda how: [(r.k, r.asDict().get("j")) for r in N.sjoin(left, right, "a", "b", size, within=within, how=how, key="k").collect()]  # noqa: B023, E731
        assert sorted(found("inner")) == sorted(near)
        assert sorted(found("left"), key=str) == sorted([*near, *((i, None) for i in range(len(a)) if i not in some)], key=str)
        assert sorted(i for i, _ in found("semi")) == sorted(some) and sorted(i for i, _ in found("anti")) == sorted(set(range(len(a))) - some)
    empty = path([[], None], "k", "a")
    assert N.sjoin(empty, right, "a", "b", 3.0, within=2.0).count() == 0 and N.sjoin(empty, right, "a", "b", 3.0, within=2.0, how="left", key="k").count() == 2
    with pytest.raises(ValueError):
        N.sjoin(left, right, "a", "b", 3.0, how="left")
