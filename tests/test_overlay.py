"""Predicates, overlays and further shapes against known answers and sampled points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.operators import geo as G
from lodestream.operators import overlay as O

SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
#: Not convex: a square with its upper middle cut out.
CUP = [(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6), (0, 0)]


def shape(points):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points)) if points else F.array().cast(G.PATH)


def moved(points, dx, dy):
    return [(x + dx, y + dy) for x, y in points]


def value(spark, *columns):
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_common_area_of_rings_that_are_not_convex(spark):
    a, b = shape(CUP), shape(moved(SQUARE, 1, 1))
    assert value(spark, O.common_area(a, b), O.common_area(b, a), O.common_area(a, a)) == pytest.approx((10, 10, 28))
    assert value(spark, O.areas(O.difference(a, b)), O.areas(O.intersection(a, b)), O.areas(O.union(a, b)), O.areas(O.symmetric_difference(shape(SQUARE), b))) == pytest.approx((18, 10, 34, 14))


def test_predicates(spark):
    s, c = shape(SQUARE), shape(CUP)
    inner, edge, beside, away, gap = (shape(moved([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], *d)) for d in ((1, 1), (0, 0), (4, 0), (9, 9), (2.5, 4)))
    assert value(spark, O.intersects(s, inner), O.intersects(s, beside), O.intersects(s, away), O.disjoint(c, gap), O.covers(s, edge), O.covered_by(edge, s), O.covers(s, beside)) == (True, True, False, True, True, True, False)
    assert value(spark, O.contains_properly(s, inner), O.contains_properly(s, edge), O.touches(s, beside), O.touches(s, inner), O.touches(s, away), O.overlaps(s, c), O.overlaps(s, inner)) == (True, False, True, False, False, True, False)
    assert value(spark, O.equals_topo(s, shape([(4, 4), (4, 2), (4, 0), (0, 0), (0, 4), (4, 4)])), O.equals_topo(s, c), O.equals_topo(s, shape([]))) == (True, False, False)
    through, inside, outside = shape([(-1, 3), (9, 3)]), shape([(1, 1), (2, 2)]), shape([(2.5, 5), (3.5, 5)])
    assert value(spark, O.crosses(through, s), O.crosses(inside, s), O.crosses(outside, c), O.crosses(through, shape([(1, 0), (1, 9)]), False), O.crosses(through, shape([(1, 3), (1, 9)]), False)) == (True, False, False, True, False)


def test_nulls_and_empty_shapes(spark):
    null, none, s = F.lit(None).cast(G.PATH), shape([]), shape(SQUARE)
    assert value(spark, O.intersection(null, s), O.difference(s, null), O.common_area(s, null), O.convex_hull(null), O.simplify(null, 1.0), O.frechet_distance(null, s), O.snap(null, s, 1.0), O.clean_topology(null)) == (None,) * 8
    assert value(spark, F.size(O.intersection(none, s)), O.common_area(none, s), F.size(O.convex_hull(none)), F.size(O.simplify(none, 1.0)), O.areas(O.difference(s, none))) == (0, 0.0, 0, 0, 16.0)


def test_hull_buffer_and_inner_point(spark):
    rng = np.random.default_rng(5)
    pts = [tuple(p) for p in rng.integers(0, 20, (60, 2))]
    hull = [(p.x, p.y) for p in value(spark, O.convex_hull(shape(pts)))]
    assert hull[0] == hull[-1] and set(hull) <= {(float(x), float(y)) for x, y in pts}
    for (ax, ay), (bx, by) in zip(hull, hull[1:]):
        assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0 for x, y in pts)
    assert value(spark, O.areas(O.buffer(shape([(0, 0)]), 2.0, 64)), O.areas(O.buffer(shape(SQUARE), 1.0, 64))) == pytest.approx((4 * np.pi, 32 + np.pi), rel=1e-3)
    assert value(spark, G.covers_point(shape(CUP), O.point_on_surface(shape(CUP)), False))


def test_line_work(spark):
    line = shape([(0, 0), (3, 0), (3, 4)])
    assert [tuple(p) for p in value(spark, O.line_substring(line, F.lit(1.0), F.lit(5.0)))] == [(1, 0), (3, 0), (3, 2)]
    assert value(spark, O.frechet_distance(line, shape([(0, 1), (3, 1), (3, 5)])), O.frechet_distance(line, shape([(3, 4), (3, 0), (0, 0)]))) == pytest.approx((1, 5))
    assert [tuple(p) for p in value(spark, O.snap(line, shape([(0.1, 0), (9, 9)]), 0.5))] == [(0.1, 0), (3, 0), (3, 4)]
    shared = value(spark, O.shared_paths(line, shape([(2, 0), (1, 0), (1, 9)])))
    assert [(tuple(s.p), tuple(s.q), s.forward) for s in shared] == [((1, 0), (2, 0), False)]
    assert [tuple(p) for p in value(spark, O.simplify(shape([(0, 0), (1, 0.1), (2, 0), (3, 5), (4, 0)]), 0.5))] == [(0, 0), (2, 0), (3, 5), (4, 0)]
    assert value(spark, F.size(O.boundary(line)), F.size(O.boundary(shape(SQUARE)))) == (2, 5)
    assert sorted(O_area for O_area in value(spark, F.transform(O.split(shape(SQUARE), *(F.get(shape([(1, -9), (1, 9)]), i) for i in (0, 1))), O.area))) == pytest.approx([4, 12])


def test_diagnostics_and_cleaning(spark):
    bow, spike = [(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)], [(0, 0), (4, 0), (9, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    assert value(spark, *(O.diagnostics(shape(p))["reason"] for p in (SQUARE, CUP, bow, SQUARE[:4], SQUARE[:3]))) == (None, None, "crosses itself", "not closed", "too few points")
    assert value(spark, F.size(O.clean_topology(shape(spike))), O.area(O.clean_topology(shape(spike)))) == (5, 16.0)


def test_the_earth(spark):
    at = lambda x, y: F.get(shape([(x, y)]), 0)
    got = value(spark, O.geodesic_distance(at(0, 0), at(1, 0)), O.geodesic_distance(at(10, 0), at(20, 90)), O.geodesic_distance(at(179.5, 0), at(-179.5, 0)), O.geodesic_distance(at(3, 4), at(3, 4)))
    assert got == pytest.approx((111319.4908, 10001965.7293, 111319.4908, 0.0), abs=1e-3)
    assert value(spark, O.geodesic_distance(at(0, 0), at(179.7, 0.5))) == pytest.approx(19944127.421, abs=1e-2)
    assert value(spark, O.geodesic_area(shape([(0, 0), (90, 0), (90, 90), (0, 90), (0, 0)]))) == pytest.approx(510065621724088.44 / 8, rel=1e-9)
    back = value(spark, O.from_web_mercator(O.to_web_mercator(shape([(12.5, 41.9)]))))
    assert tuple(back[0]) == pytest.approx((12.5, 41.9))
    assert value(spark, F.get(O.to_web_mercator(shape([(180, 0)])), 0)["x"]) == pytest.approx(20037508.342789244)


def _simplified(points, tolerance):
    """Douglas-Peucker by recursion."""
    if len(points) < 3:
        return points
    a, b = np.array(points[0], float), np.array(points[-1], float)
    p = np.array(points[1:-1], float) - a
    far = ((b - a) ** 2).sum()
    t = np.clip(p @ (b - a) / far, 0, 1) if far else np.zeros(len(p))
    away = np.hypot(*(p - t[:, None] * (b - a)).T)
    k = int(away.argmax())
    return [points[0], points[-1]] if away[k] <= tolerance else _simplified(points[: k + 2], tolerance)[:-1] + _simplified(points[k + 1 :], tolerance)


def test_simplify_against_recursion(spark):
    rng = np.random.default_rng(11)
    for n in (2, 3, 40, 120):
        pts = [(float(x), float(y)) for x, y in zip(np.arange(n), rng.normal(0, 2, n).round(3))]
        assert [tuple(p) for p in value(spark, O.simplify(shape(pts), 1.5))] == _simplified(pts, 1.5)
    assert [tuple(p) for p in value(spark, O.simplify(G.densify(shape([(0, 0), (4, 0), (4, 4)]), 1.0), 0.01))] == [(0, 0), (4, 0), (4, 4)]


ELL = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0)]


def test_overlays_of_concave_rings(spark):
    box, ell, cup = shape(SQUARE), shape(ELL), shape(CUP)
    turned = shape(list(reversed(ELL)))
    assert value(spark, *(O.areas(x) for x in (O.intersection(box, ell), O.difference(box, ell), O.union(box, ell), O.symmetric_difference(box, ell), O.intersection(box, turned), O.difference(ell, box)))) == pytest.approx((7, 9, 16, 9, 7, 0))
    for a, b in ((cup, ell), (ell, cup), (cup, shape(moved(ELL, 1.5, 1.25)))):
        assert value(spark, O.areas(O.intersection(a, b)), O.areas(O.difference(a, b)), O.areas(O.union(a, b))) == pytest.approx(value(spark, O.common_area(a, b), O.area(a) - O.common_area(a, b), O.area(a) + O.area(b) - O.common_area(a, b)))
    outline_and_hole = F.array(box, shape(moved([(0, 0), (1, 0), (1, 2), (0, 2), (0, 0)], 1, 1)))
    assert value(spark, O.areas(O.pieces_of(outline_and_hole)), O.areas(O.pieces(ell)), F.size(O.pieces(box))) == pytest.approx((14, 7, 1))
    assert value(spark, O.areas(O.split(ell, F.get(shape([(2, 0)]), 0), F.get(shape([(2, 1)]), 0)))) == pytest.approx(7)


def test_buffers_of_concave_shapes(spark):
    assert value(spark, O.areas(O.buffer(shape(ELL), 0.001))) == pytest.approx(7.016, abs=1e-4)
    # a corner: two strips of 4 x 2, the square where they meet once, three quarters of a circle there and half a circle at each end
    corner = shape([(0, 0), (4, 0), (4, 4)])
    assert value(spark, O.areas(O.buffer(corner, 1.0, 32))) == pytest.approx(16 - 1 + np.pi / 4 + np.pi, rel=1e-3)


def test_predicates_of_lines(spark):
    box, ell = shape(SQUARE), shape(ELL)
    inside, away, along, out = shape([(1, 1), (2, 3)]), shape([(90, 90), (91, 91)]), shape([(0, 0), (4, 0)]), shape([(2, 2), (5, 2)])
    notch = shape([(0.5, 3.5), (3.5, 0.5)])  # both ends in the L, its middle not
    assert value(spark, *(O.covers(a, b) for a, b in ((box, inside), (box, away), (box, along), (box, out), (ell, notch), (along, shape([(1, 0), (2, 0)])), (along, inside), (inside, box), (box, shape([(4, 4)]))))) == (True, False, True, False, False, True, False, False, True)
    assert value(spark, *(O.touches(a, b) for a, b in ((box, along), (box, inside), (out, box), (shape([(4, 1), (9, 1)]), box), (along, shape([(4, 0), (5, 5)])), (along, shape([(2, -1), (2, 1)])), (along, shape([(2, 0), (2, 1)])), (along, away)))) == (True, False, False, True, True, False, True, False)
    assert value(spark, *(O.overlaps(a, b) for a, b in ((along, shape([(2, 0), (6, 0)])), (along, shape([(1, 0), (2, 0)])), (along, box)))) == (True, False, False)
