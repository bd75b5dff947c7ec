"""Faults of coverages, planted and against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lodestream.operators import coverage as V
from lodestream.operators import shapes as P


def coverage(spark, shapes):
    df = spark.createDataFrame([(k, w) for k, w in shapes], "k int, w string")
    return df.select("k", P.from_wkt(F.col("w")).alias("shape"))


def square(x, y, w=1, h=1, *holes):
    rings = [[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)], *holes]
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{a} {b}" for a, b in r) + ")" for r in rings) + ")"


def test_a_clean_coverage_has_no_fault(spark):
    df = coverage(spark, [(i * 6 + j, square(i, j)) for i in range(6) for j in range(6)] + [(100, None), (101, "POINT (1 1)"), (102, "POLYGON EMPTY")])
    for size in (0.7, 10.0):
        assert V.overlaps(df, "k", "shape", size).count() == 0 and V.unmatched(df, "k", "shape", size).count() == 0
    assert V.faults(df, "k", "shape", 1.0).count() == 0


@pytest.mark.parametrize("size", [0.5, 50.0])
def test_planted_faults_are_all_found(spark, size):
    hole = [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]
    shapes = [(1, square(0, 0, 3, 3, hole)), (2, square(3, 0, 2, 1)), (3, square(3, 1, 2, 2)), (4, square(0, 3, 5, 1)), (5, square(1.25, 1, 0.5, 1)), (6, square(4.5, 3.5, 1, 1))]
    found = V.faults(coverage(spark, shapes), "k", "shape", size).collect()
    assert [(r.key, r.other, round(r.measure, 9)) for r in found if r.fault == "overlap"] == [(4, 6, 0.25)]
    assert sorted((min(p.x for p in r.place), round(r.measure, 9)) for r in found if r.fault == "gap") == [(1.0, 0.25), (1.75, 0.25)]
    loose = sorted((r.key, r.other, r.place[0].x, r.place[0].y) for r in found if r.fault == "vertex")
    assert loose == [(1, 2, 3, 1), (1, 3, 3, 1), (1, 5, 1.25, 1), (1, 5, 1.25, 2), (1, 5, 1.75, 1), (1, 5, 1.75, 2), (4, 1, 3, 3), (4, 3, 3, 3)]


def test_holes_and_parts_take_their_part_of_an_overlap(spark):
    hole = [(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)]
    df = coverage(spark, [(1, square(0, 0, 4, 4, hole)), (2, square(1.5, 1.5, 1, 1)), (3, square(2, 2, 4, 4)), (4, "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((3.5 3.5, 5 3.5, 5 5, 3.5 5, 3.5 3.5)))")])
    got = {(r.key, r.other): round(r.area, 9) for r in V.overlaps(df, "k", "shape", 1.0).collect()}
    assert got == {(1, 3): 3.0, (1, 4): 1.25, (2, 3): 0.25, (3, 4): 2.25}


def test_near_misses_within_a_tolerance(spark):
    df = coverage(spark, [(1, square(0, 0)), (2, square(1.01, 0)), (3, square(0, 1.2))])
    got = {(r.key, r.other, r.place.x, r.place.y): round(r.distance, 9) for r in V.unmatched(df, "k", "shape", 0.3, 0.05).collect()}
    assert got == {(1, 2, 1.01, 0.0): 0.01, (1, 2, 1.01, 1.0): 0.01, (2, 1, 1.0, 0.0): 0.01, (2, 1, 1.0, 1.0): 0.01}
    assert V.unmatched(df, "k", "shape", 0.3).count() == 0


def ring(points):
    return "(" + ", ".join(f"{x} {y}" for x, y in [*points, points[0]]) + ")"


def jittered(n, rnd, wiggle):
    """A coverage of n x n plots whose borders bend at six places each, by up to ``wiggle``."""
    corner = {(i, j): (i + rnd.uniform(-0.1, 0.1), j + rnd.uniform(-0.1, 0.1)) for i in range(n + 1) for j in range(n + 1)}

    def border(a, b):
        (x, y), (u, v) = corner[a], corner[b]
        return [(round(x + (u - x) * k / 7 + rnd.uniform(-wiggle, wiggle) * (v != y), 6), round(y + (v - y) * k / 7 + rnd.uniform(-wiggle, wiggle), 6)) for k in range(1, 7)]

    corner = {k: (round(x, 6), round(y, 6)) for k, (x, y) in corner.items()}
    right = {(i, j): border((i, j), (i + 1, j)) for i in range(n) for j in range(n + 1)}
    up = {(i, j): border((i, j), (i, j + 1)) for i in range(n + 1) for j in range(n)}
    return {
        (i, j): [corner[i, j], *right[i, j], corner[i + 1, j], *up[i + 1, j], corner[i + 1, j + 1], *right[i, j + 1][::-1], corner[i, j + 1], *up[i, j][::-1]]
        for i in range(n)
        for j in range(n)
    }


def places(shape):
    return [(p.x, p.y) for m in shape.members for part in m.parts for r in part for p in r]


@pytest.mark.parametrize("tolerance", [0.02, 0.3])
def test_a_simplified_coverage_has_no_fault(spark, tolerance):
    plots = jittered(4, random.Random(3), 0.07)
    before = coverage(spark, [(10 * i + j, f"POLYGON ({ring(r)})") for (i, j), r in plots.items()])
    assert V.faults(before, "k", "shape", 0.7).count() == 0
    after = V.simplify(before, "k", "shape", 0.7, tolerance).cache()
    assert V.faults(after, "k", "shape", 0.7).count() == 0
    got = {r.k: places(r.shape) for r in after.collect()}
    given = {10 * i + j: r for (i, j), r in plots.items()}
    assert set(got) == set(given) and all(set(got[k]) <= set(given[k]) for k in given)
    assert sum(map(len, got.values())) < (0.5 if tolerance > 0.1 else 0.95) * sum(map(len, given.values()))
    corner = {p for i, j in plots for p in (plots[i, j][0],)}
    assert all((p in got[k]) == (p in given[k]) for p in corner - {plots[0, 0][0]} for k in given)
    total = lambda df: df.select(F.sum(P.area(F.col("shape")))).first()[0]
    assert abs(total(after) - total(before)) <= tolerance * 16


def test_islands_holes_and_crossings_keep_their_places(spark):
    """A border that bends around an island stays on its side; small islands, holes and thin strips do not vanish."""
    island = [(4.9, 1.05), (5.1, 1.05), (5.1, 1.1), (4.9, 1.1)]
    bend = [(10, 1), (7, 1), (5, 1.4), (3, 1), (0, 1)]
    lower = [(0, 0), (10, 0), *bend]
    upper = [(0, 1), (3, 1), (5, 1.4), (7, 1), (10, 1), (10, 3), (0, 3)]
    hole = [(4, 0.4), (4, 0.5), (4.05, 0.5), (4.05, 0.4)]
    strip = [(20, 0), (30, 0), (30, 0.02), (25, 0.01), (20, 0.02)]
    shapes = [
        (1, f"POLYGON ({ring(lower)}, {ring(island[::-1])}, {ring(hole)})"), (2, f"POLYGON ({ring(upper)})"), (3, f"POLYGON ({ring(island)})"),
        (4, f"MULTIPOLYGON (({ring(strip)}), ({ring([(40, 0), (41, 0), (41, 0.5), (41, 1), (40, 1)])}))"), (5, None), (6, "POLYGON EMPTY"), (7, "POINT (1 1)"),
    ]
    df = coverage(spark, shapes)
    for tolerance in (0.0, 0.5, 100.0):
        after = V.simplify(df, "k", "shape", 2.0, tolerance).cache()
        got = {r.k: r.shape for r in after.collect()}
        assert set(got) == {1, 2, 3, 4}
        assert V.overlaps(after, "k", "shape", 2.0).count() == 0
        assert {round(r.area, 9) for r in V.gaps(after, "shape", 2.0).collect()} == {0.005}
        # without the bend, the island would lie in 2
        assert (5, 1.4) in places(got[1]) and (5, 1.4) in places(got[2])
        assert len(got[1].members[0].parts[0]) == 3 and len(got[4].members[0].parts) == 2 and set(places(got[3])) == set(island)
        assert (41, 0.5) not in places(got[4])
    assert V.simplify(df.limit(0), "k", "shape", 1.0, 1.0).collect() == []


def test_neighbours_without_shared_vertices_share_them_afterwards(spark):
    df = coverage(spark, [(1, square(0, 0, 2, 2)), (2, square(2, 0, 1, 1)), (3, square(2, 1, 1, 1))])
    after = V.simplify(df, "k", "shape", 1.5, 0.25).cache()
    assert V.faults(after, "k", "shape", 1.5).count() == 0
    assert sorted((r.k, len(places(r.shape))) for r in after.collect()) == [(1, 6), (2, 5), (3, 5)]
