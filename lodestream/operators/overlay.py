"""Predicates, overlays and further shapes on coordinate arrays, as built-in expressions.

Shapes are those of ``geo``; a closed ring counts as an area. Areas of common
parts are exact for any simple rings (signed triangles). Overlays that return
shapes take any simple rings, cut them into convex pieces where they are not
convex, and return arrays of rings whose interiors do not meet. Areas up to
``EPS`` count as none. Null in, null out.
"""

from __future__ import annotations

from math import cos, pi, sin

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream.operators.geodesic import MAJOR, geodesic_area, geodesic_distance, geodesic_line_length  # noqa: F401  part of this module's kernels
from lodestream.operators.geo import PATH, _let, _segments, _signed_area, _total, area, box_gap, centroid, covers_point, distance, is_box, length, line_interpolate_point

EPS = 1e-9


def free_name(df, name: str) -> str:
    """``name``, with as many underscores before it as it takes for no column of ``df`` to have it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _none(kind: str = PATH) -> Column:
    return F.array().cast(kind)


def _cross(a: Column, b: Column, p: Column) -> Column:
    """Positive where p lies left of the line from a to b."""
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def _open(ring: Column) -> Column:
    return _let(ring, lambda r: F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))))


def _closed(points: Column) -> Column:
    return _let(points, lambda z: F.concat(z, F.slice(z, 1, 1)))


def _ccw(ring: Column) -> Column:
    return _let(ring, lambda r: F.when(_signed_area(r) < 0, F.reverse(r)).otherwise(r))


# --- cutting
def _sided(points: Column, a: Column, b: Column) -> Column:
    """Each point (p) with the side (u) of the line from a to b that it is on: positive on the left."""
    return F.transform(points, lambda p: F.struct(p.alias("p"), _cross(a, b, p).alias("u")))


def _half(sided: Column, way: int = 1) -> Column:
    """The part of an open ring on the left of a line, or (``way`` -1) on its right; ``sided`` is an element of a lambda."""
    def part(p: Column, q: Column) -> Column:
        u, v, a, b = way * p["u"], way * q["u"], p["p"], q["p"]
        cut = _xy(a["x"] + (b["x"] - a["x"]) * (u / (u - v)), a["y"] + (b["y"] - a["y"]) * (u / (u - v)))
        return F.when(u * v < 0, F.when(u >= 0, F.array(a, cut)).otherwise(F.array(cut))).when(u >= 0, F.array(a)).otherwise(_none())

    z = sided
    cut = F.flatten(F.zip_with(z, F.concat(F.slice(z, F.lit(2), F.greatest(F.size(z) - 1, F.lit(0))), F.slice(z, 1, 1)), part))
    all_ = F.when(F.forall(z, lambda p: way * p["u"] >= 0), F.transform(z, lambda p: p["p"]))
    return all_.when(F.forall(z, lambda p: way * p["u"] < 0), _none()).otherwise(cut)


def _left(points: Column, a: Column, b: Column) -> Column:
    """The part of an open ring on the left of the line from a to b."""
    return _let(_sided(points, a, b), lambda z: _half(z))


def _sound(points: Column) -> Column:
    """An open ring closed, or no points where it has no area."""
    return _let(_closed(points), lambda r: F.when(area(r) <= EPS, _none()).otherwise(r))


def is_convex(ring: Column) -> Column:
    at = lambda r, i: F.get(r, F.pmod(i, F.size(r)))
    return _let(_open(_ccw(ring)), lambda r: F.forall(F.transform(r, lambda p, i: _cross(at(r, i - 1), p, at(r, i + 1))), lambda turn: turn >= 0))


def pieces(ring: Column) -> Column:
    """Convex rings that make up a ring: itself, or upright trapezoids between neighbouring corners."""
    return _let(ring, lambda r: F.when(F.size(r) == 0, _none(f"array<{PATH}>")).when(is_box(r) | is_convex(r), F.array(r)).otherwise(pieces_of(F.array(r))))


def pieces_of(rings: Column) -> Column:
    """Convex rings that make up the area of several rings by the even-odd rule: an outline and its holes, or many outlines."""
    def slabs(z: Column) -> Column:
        spans = _let(F.sort_array(F.array_distinct(F.transform(z, lambda s: s["a"]["x"]))), lambda xs: F.zip_with(xs, F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))), lambda u, v: F.struct(u.alias("u"), v.alias("v"))))
        return F.flatten(F.transform(F.filter(spans, lambda w: w["v"].isNotNull()), lambda w: between(z, w["u"], w["v"])))

    def between(z: Column, u: Column, v: Column) -> Column:
        over = F.filter(z, lambda s: (F.least(s["a"]["x"], s["b"]["x"]) <= u) & (F.greatest(s["a"]["x"], s["b"]["x"]) >= v))
        y = lambda s, x: s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * ((x - s["a"]["x"]) / (s["b"]["x"] - s["a"]["x"]))
        heights = F.sort_array(F.transform(over, lambda s: F.struct(y(s, (u + v) / 2).alias("middle"), y(s, u).alias("at_u"), y(s, v).alias("at_v"))))

        def paired(h: Column) -> Column:
            both = F.filter(F.transform(h, lambda low, i: F.struct(low.alias("low"), F.get(h, i + 1).alias("high"), (i % 2 == 0).alias("opens"))), lambda w: w["opens"] & w["high"].isNotNull())
            return F.transform(both, lambda w: F.array_distinct(F.array(_xy(u, w["low"]["at_u"]), _xy(v, w["low"]["at_v"]), _xy(v, w["high"]["at_v"]), _xy(u, w["high"]["at_u"]))))

        return _let(heights, paired)

    edges = F.filter(F.flatten(F.transform(rings, _segments)), lambda s: s["a"]["x"] != s["b"]["x"])
    return F.filter(F.transform(_let(edges, slabs), _sound), lambda r: F.size(r) > 0)


def clip_convex(ring: Column, mask: Column) -> Column:
    """One ring: the area both cover (``mask`` convex); no points where they only touch."""
    start = F.when(F.size(mask) == 0, _none()).otherwise(_open(ring))
    return F.aggregate(_segments(_ccw(mask)), start, lambda r, s: _left(r, s["a"], s["b"]), _sound)


def _without(ring: Column, mask: Column) -> Column:
    """A convex ring without a convex one: array of convex rings."""
    start = F.struct(_open(ring).alias("rest"), _none(f"array<{PATH}>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        cut = _let(_sided(s["rest"], e["a"], e["b"]), lambda z: F.struct(_half(z).alias("rest"), F.concat(s["out"], F.array(_half(z, -1))).alias("out")))
        return F.when(F.size(s["rest"]) > 0, cut).otherwise(s)

    return F.aggregate(_segments(_ccw(mask)), start, step, lambda s: F.filter(F.transform(s["out"], _sound), lambda r: F.size(r) > 0))


def _without_all(rings: Column, masks: Column) -> Column:
    return F.aggregate(masks, rings, lambda rest, m: F.flatten(F.transform(rest, lambda r: _without(r, m))))


def intersection(ring: Column, mask: Column) -> Column:
    """The area both cover: array of convex rings."""
    return _let(pieces(ring), lambda own: F.filter(F.flatten(F.transform(pieces(mask), lambda m: F.transform(own, lambda r: clip_convex(r, m)))), lambda r: F.size(r) > 0))


def difference(ring: Column, mask: Column) -> Column:
    """``ring`` without ``mask``: array of convex rings."""
    return _without_all(pieces(ring), pieces(mask))


def union(a: Column, b: Column) -> Column:
    """``b`` and what ``a`` has beside it: array of rings."""
    return F.concat(F.array(b), difference(a, b))


def symmetric_difference(a: Column, b: Column) -> Column:
    return _let(pieces(a), lambda p: _let(pieces(b), lambda q: F.concat(_without_all(p, q), _without_all(q, p))))


def split(ring: Column, a: Column, b: Column) -> Column:
    """A ring cut along the line through a and b: array of rings, a concave one in convex pieces."""
    halves = lambda p: _let(_open(p), lambda r: F.array(_sound(_left(r, a, b)), _sound(_left(r, b, a))))
    return F.filter(F.flatten(F.transform(pieces(ring), halves)), lambda r: F.size(r) > 0)


def areas(rings: Column) -> Column:
    return _total(F.transform(rings, area))


# --- common area of any simple rings
def _spans(ring: Column, base: Column) -> Column:
    """Edges that are not upright: from u to v, with their heights over ``base`` there, and their direction."""
    def span(s: Column) -> Column:
        ahead = s["a"]["x"] < s["b"]["x"]
        low, high = (F.when(ahead, s[k]).otherwise(s[m]) for k, m in (("a", "b"), ("b", "a")))
        return F.struct(low["x"].alias("u"), high["x"].alias("v"), (low["y"] - base).alias("at_u"), (high["y"] - base).alias("at_v"), F.when(ahead, 1.0).otherwise(-1.0).alias("way"))

    return F.transform(F.filter(_segments(ring), lambda s: s["a"]["x"] != s["b"]["x"]), span)


def common_area(a: Column, b: Column) -> Column:
    """A ring is the sum of the strips below its edges, down to a common base and signed by direction; two strips share what is below the lower edge."""
    def shared_strip(s: Column, t: Column) -> Column:
        u, v = F.greatest(s["u"], t["u"]), F.least(s["v"], t["v"])
        y = lambda e, x: e["at_u"] + (e["at_v"] - e["at_u"]) * ((x - e["u"]) / (e["v"] - e["u"]))
        ends = F.struct((v - u).alias("w"), y(s, u).alias("p"), y(t, u).alias("q"), y(s, v).alias("r"), y(t, v).alias("s"))

        def below(z: Column) -> Column:
            left, right, d, e = F.least(z["p"], z["q"]), F.least(z["r"], z["s"]), z["p"] - z["q"], z["r"] - z["s"]
            crossed = _let(d / (d - e), lambda f: _let(z["p"] + (z["r"] - z["p"]) * f, lambda m: f * (left + m) + (1 - f) * (m + right)))
            return z["w"] / 2 * F.when(d * e < 0, crossed).otherwise(left + right)

        return F.when(u < v, s["way"] * t["way"] * _let(ends, below)).otherwise(0.0)

    lowest = lambda r: F.array_min(F.transform(r, lambda p: p["y"]))

    def general(r: Column, q: Column) -> Column:
        strips = lambda base: _let(_spans(q, base), lambda of_q: _total(F.transform(_spans(r, base), lambda s: _total(F.transform(of_q, lambda t: shared_strip(s, t))))))
        return _let(F.least(lowest(r), lowest(q)), strips)

    shared = lambda k: F.greatest(-box_gap(a, b, k), F.lit(0.0))
    way = lambda r: F.signum(_cross(F.get(r, F.lit(0)), F.get(r, F.lit(1)), F.get(r, F.lit(2))))  # noqa: E731  areas of rings of unlike direction count as negative
    return F.when(a.isNotNull() & b.isNotNull(), F.when(is_box(a) & is_box(b), way(a) * way(b) * shared("x") * shared("y")).otherwise(general(a, b)))


# --- predicates
def _meet(s: Column, t: Column) -> Column:
    """Whether two segments share a point."""
    box = F.lit(True)
    for k in ("x", "y"):
        box &= (F.greatest(s["a"][k], s["b"][k]) >= F.least(t["a"][k], t["b"][k])) & (F.greatest(t["a"][k], t["b"][k]) >= F.least(s["a"][k], s["b"][k]))
    return box & (_cross(t["a"], t["b"], s["a"]) * _cross(t["a"], t["b"], s["b"]) <= 0) & (_cross(s["a"], s["b"], t["a"]) * _cross(s["a"], s["b"], t["b"]) <= 0)


def _edges_meet(a: Column, b: Column) -> Column:
    return _let(_segments(b), lambda of_b: F.exists(_segments(a), lambda s: F.exists(of_b, lambda t: _meet(s, t))))


def intersects(a: Column, b: Column, a_is_area: bool = True, b_is_area: bool = True) -> Column:
    hit = _edges_meet(a, b)
    if a_is_area:
        hit |= covers_point(a, F.get(b, F.lit(0)))
    if b_is_area:
        hit |= covers_point(b, F.get(a, F.lit(0)))
    return hit


def disjoint(a: Column, b: Column, a_is_area: bool = True, b_is_area: bool = True) -> Column:
    return ~intersects(a, b, a_is_area, b_is_area)


def is_area(shape: Column) -> Column:
    return (F.size(shape) >= 4) & (F.get(shape, F.lit(0)) == F.get(shape, F.size(shape) - 1))


def _near(path: Column, p: Column) -> Column:
    """Whether ``p`` is on a path, up to ``EPS``."""
    def near(s: Column) -> Column:
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        long = dx * dx + dy * dy
        f = F.when(long > 0, F.least(F.greatest(((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy) / long, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        return F.hypot(s["a"]["x"] + dx * f - p["x"], s["a"]["y"] + dy * f - p["y"]) <= EPS

    return F.exists(_segments(path), near)


def _shared_length(a: Column, b: Column) -> Column:
    return _total(F.transform(shared_paths(a, b), lambda z: distance(z["p"], z["q"])))


def covers(a: Column, b: Column) -> Column:
    """No part of ``b`` (an area, a path or one point) lies outside ``a`` (an area or a path that does not run over itself)."""
    return _let(a, lambda r: _let(b, lambda q: _covers(r, q)))


def _covers(a: Column, b: Column) -> Column:
    point = F.get(b, F.lit(0))
    line = F.forall(_inside_flags(b, a, boundary=True), lambda inside: inside)
    of_area = F.when(is_area(b), common_area(a, b) >= area(b) - EPS).when(F.size(b) == 1, covers_point(a, point)).otherwise(line & covers_point(a, point))
    of_line = F.when(is_area(b), F.lit(False)).when(F.size(b) == 1, _near(a, point)).otherwise(_shared_length(a, b) >= length(b) - EPS)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(is_area(a), of_area).otherwise(of_line))


def covered_by(a: Column, b: Column) -> Column:
    return covers(b, a)


def contains_properly(a: Column, b: Column) -> Column:
    return covers(a, b) & ~_edges_meet(a, b)


def overlaps(a: Column, b: Column) -> Column:
    """Two areas, or two lines, that share a part of their own kind, each with more besides."""
    def of_both(a: Column, b: Column) -> Column:
        part = lambda of, measure: _let(of, lambda v: (v > EPS) & (v < F.least(measure(a), measure(b)) - EPS))
        of_areas, of_lines = part(common_area(a, b), area), part(_shared_length(a, b), length)
        return F.when(is_area(a) & is_area(b), of_areas).when(~is_area(a) & ~is_area(b), of_lines).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.lit(False)))

    return _let(a, lambda r: _let(b, lambda q: of_both(r, q)))


def touches(a: Column, b: Column) -> Column:
    """They meet, but not inside each other (the inside of a line: all but its ends)."""
    ends = lambda p: F.array(F.get(p, F.lit(0)), F.get(p, F.size(p) - 1))
    met = F.concat(F.filter(a, lambda p: _near(b, p)), F.filter(b, lambda p: _near(a, p)))
    of_lines = (F.size(met) > 0) & (_shared_length(a, b) <= EPS) & ~crosses(a, b, False) & F.forall(met, lambda p: F.exists(F.concat(ends(a), ends(b)), lambda q: distance(p, q) <= EPS))
    beside = lambda line, ring: intersects(line, ring, False, True) & ~F.array_contains(_inside_flags(line, ring), True)
    return (
        F.when(is_area(a) & is_area(b), intersects(a, b) & (common_area(a, b) <= EPS))
        .when(is_area(a), beside(b, a))
        .when(is_area(b), beside(a, b))
        .otherwise(of_lines)
    )


def clean_topology(ring: Column) -> Column:
    """Without repeated points, points in line with their neighbours, and spikes of one point."""
    distinct = F.aggregate(_open(ring), _none(), lambda s, p: F.when((F.size(s) > 0) & (F.get(s, F.size(s) - 1) == p), s).otherwise(F.concat(s, F.array(p))))
    at = lambda r, i: F.get(r, F.pmod(i, F.size(r)))
    bends = F.aggregate(F.array(F.lit(0)), distinct, lambda r, _: F.filter(r, lambda p, i: _cross(at(r, i - 1), p, at(r, i + 1)) != 0), _closed)
    return F.when(ring.isNotNull(), bends)


def _canonical(ring: Column) -> Column:
    """Counter-clockwise from the least point."""
    turned = lambda r: F.concat(F.slice(r, F.array_position(r, F.array_min(r)).cast("int"), F.size(r)), F.slice(r, F.lit(1), F.array_position(r, F.array_min(r)).cast("int") - 1))
    return F.aggregate(F.array(F.lit(0)), _open(_ccw(clean_topology(ring))), lambda r, _: F.when(F.size(r) > 0, turned(r)).otherwise(r))


def equals_topo(a: Column, b: Column) -> Column:
    """Same points whatever the start, direction or points in line."""
    return _canonical(a) == _canonical(b)


def _inside_flags(line: Column, ring: Column, boundary: bool = False) -> Column:
    """For each stretch of a line between places where it passes the ring: is its middle inside, or (with ``boundary``) on the ring?"""
    def flags(s: Column) -> Column:
        at = lambda t: _cross(t["a"], t["b"], s["a"]) / (_cross(t["a"], t["b"], s["a"]) - _cross(t["a"], t["b"], s["b"]))
        cuts = F.transform(F.filter(_segments(ring), lambda t: _meet(s, t) & (_cross(t["a"], t["b"], s["a"]) != _cross(t["a"], t["b"], s["b"]))), at)
        ends = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts)))
        spans = F.filter(F.zip_with(ends, F.slice(ends, F.lit(2), F.size(ends) - 1), lambda u, v: F.struct(u.alias("u"), v.alias("v"))), lambda z: z["v"] - z["u"] > EPS)
        middle = lambda z: _xy(s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * (z["u"] + z["v"]) / 2, s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * (z["u"] + z["v"]) / 2)
        inside = lambda p: (covers_point(ring, p) | _near(ring, p)) if boundary else (covers_point(ring, p, boundary=False) & ~_near(ring, p))
        return F.transform(spans, lambda z: _let(middle(z), inside))

    return F.flatten(F.transform(_segments(line), flags))


def crosses(line: Column, other: Column, is_area: bool = True) -> Column:
    """A line partly inside and partly outside a ring; or two lines that pass through each other."""
    if is_area:
        inside = _inside_flags(line, other)
        return F.array_contains(inside, True) & F.array_contains(inside, False)
    return F.exists(_segments(line), lambda s: F.exists(_segments(other), lambda t: (_cross(t["a"], t["b"], s["a"]) * _cross(t["a"], t["b"], s["b"]) < 0) & (_cross(s["a"], s["b"], t["a"]) * _cross(s["a"], s["b"], t["b"]) < 0)))


# --- further shapes and measures
def boundary(shape: Column) -> Column:
    """A ring's own path; the two ends of an open path."""
    ends = F.array(F.get(shape, F.lit(0)), F.get(shape, F.size(shape) - 1))
    return F.when(F.get(ends, F.lit(0)) == F.get(ends, F.lit(1)), shape).otherwise(ends)


def convex_hull(points: Column) -> Column:
    """Counter-clockwise closed ring; collinear points give a path there and back.

    Along a convex chain the test for the next point fails from some place on,
    so a filter over the chain removes what it hides.
    """
    chain = lambda pts: F.aggregate(pts, _none(), lambda s, p: F.concat(F.filter(s, lambda v, i: (i == 0) | (_cross(F.get(s, i - 1), v, p) > 0)), F.array(p)))
    return _let(F.array_sort(F.array_distinct(points)), lambda ordered: F.concat(_open(chain(ordered)), chain(F.reverse(ordered))))


def hull_buffer(shape: Column, by: float, quad_segs: int = 8) -> Column:
    """All within ``by`` of a shape's convex hull (a point, segment or convex ring itself), circles having 4 x ``quad_segs`` corners.

    The sum of two convex rings: the edges of both, in order of direction, from the sum of their lowest points.
    """
    n = 4 * quad_segs
    circle = F.array(*(_xy(F.lit(by * cos(2 * pi * (k % n) / n)), F.lit(by * sin(2 * pi * (k % n) / n))) for k in range(n + 1)))
    lowest = lambda ring: F.array_min(F.transform(ring, lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))))

    def edges(ring: Column) -> Column:
        moved = F.filter(_segments(ring), lambda s: s["a"] != s["b"])
        return F.transform(moved, lambda s: F.struct(F.pmod(F.atan2(s["b"]["y"] - s["a"]["y"], s["b"]["x"] - s["a"]["x"]), F.lit(2 * pi)).alias("turn"), (s["b"]["x"] - s["a"]["x"]).alias("dx"), (s["b"]["y"] - s["a"]["y"]).alias("dy")))

    def add(ring: Column) -> Column:
        walk = lambda start: F.aggregate(F.array_sort(F.concat(edges(ring), edges(circle))), F.array(start), lambda s, e: F.concat(s, F.array(_xy(F.get(s, F.size(s) - 1)["x"] + e["dx"], F.get(s, F.size(s) - 1)["y"] + e["dy"]))), lambda s: _closed(_open(s)))
        return _let(_xy(lowest(ring)["x"] + lowest(circle)["x"], lowest(ring)["y"] + lowest(circle)["y"]), walk)

    return _let(convex_hull(shape), lambda ring: F.when(F.size(ring) == 0, _none()).otherwise(add(ring)))


def buffer(shape: Column, by: float, quad_segs: int = 8) -> Column:
    """All within ``by`` of a point, path or ring: array of rings whose interiors do not meet, circles having 4 x ``quad_segs`` corners.

    One ring around a point, a segment or a convex ring; else the ring's pieces and
    what each side's own surroundings add to them.
    """
    around = F.transform(_segments(shape), lambda s: hull_buffer(F.array(s["a"], s["b"]), by, quad_segs))
    start = F.when(is_area(shape), pieces(shape)).otherwise(_none(f"array<{PATH}>"))
    parts = F.aggregate(around, start, lambda out, m: F.concat(out, _without_all(F.array(m), out)))
    one = (F.size(shape) <= 2) | (is_area(shape) & is_convex(shape))
    return F.when(F.size(shape) == 0, _none(f"array<{PATH}>")).when(one, F.array(hull_buffer(shape, by, quad_segs))).otherwise(parts)


def point_on_surface(ring: Column) -> Column:
    """The middle of the widest stretch inside, halfway between the two middle heights of its points."""
    def level(ys: Column) -> Column:
        k = F.floor((F.size(ys) - 1) / 2).cast("int")
        return (F.get(ys, k) + F.get(ys, k + 1)) / 2

    def at(r: Column, y: Column) -> Column:
        xs = F.array_sort(F.transform(F.filter(_segments(r), lambda s: (s["a"]["y"] > y) != (s["b"]["y"] > y)), lambda s: s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"])))
        spans = _let(xs, lambda xs: F.filter(F.transform(xs, lambda x, i: F.struct((F.get(xs, i + 1) - x).alias("wide"), (x + (F.get(xs, i + 1) - x) / 2).alias("x"), (i % 2 == 0).alias("in"))), lambda z: z["in"] & z["wide"].isNotNull()))
        return _let(spans, lambda z: F.when(F.size(z) > 0, _xy(F.array_max(z)["x"], y)).otherwise(centroid(r)))

    return _let(ring, lambda r: _let(level(F.array_sort(F.array_distinct(F.transform(r, lambda p: p["y"])))), lambda y: at(r, y)))


def line_substring(path: Column, start: Column, end: Column) -> Column:
    """The part of a path between two distances along it."""
    first = F.struct(F.lit(0.0).alias("done"), _none().alias("kept"))

    def step(s: Column, seg: Column) -> Column:
        done = s["done"] + distance(seg["a"], seg["b"])
        return F.struct(done.alias("done"), F.when((done > start) & (done < end), F.concat(s["kept"], F.array(seg["b"]))).otherwise(s["kept"]).alias("kept"))

    return F.concat(F.array(line_interpolate_point(path, start)), F.aggregate(_segments(path), first, step, lambda s: s["kept"]), F.array(line_interpolate_point(path, end)))


def frechet_distance(a: Column, b: Column) -> Column:
    """Discrete: the leash between two walkers over vertices, one table row per point of ``a``."""
    far = F.lit(float("inf"))
    start = F.concat(F.array(F.lit(0.0)), F.transform(b, lambda _: far))

    def row(before: Column, p: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            return F.concat(done, F.array(F.greatest(distance(p, F.get(b, j)), F.least(F.get(before, j + 1), F.get(before, j), F.get(done, j)))))

        return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.array(far), cell)

    return F.aggregate(a, start, row, lambda r: F.get(r, F.size(r) - 1))


def snap(path: Column, other: Column, tolerance: float) -> Column:
    """Points moved to the nearest point of ``other`` where that is within ``tolerance``."""
    nearest = lambda p: F.array_min(F.transform(other, lambda q: F.struct(distance(p, q).alias("d"), q.alias("q"))))
    return F.transform(path, lambda p: F.when(nearest(p)["d"] <= tolerance, nearest(p)["q"]).otherwise(p))


def shared_paths(a: Column, b: Column) -> Column:
    """Stretches both paths run along: array of (p, q, forward)."""
    def common(s: Column, t: Column) -> Column:
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        at = lambda p: ((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy) / (dx * dx + dy * dy)
        lo, hi = F.greatest(F.lit(0.0), F.least(at(t["a"]), at(t["b"]))), F.least(F.lit(1.0), F.greatest(at(t["a"]), at(t["b"])))
        there = lambda u: _xy(s["a"]["x"] + dx * u, s["a"]["y"] + dy * u)
        aligned = (_cross(s["a"], s["b"], t["a"]) == 0) & (_cross(s["a"], s["b"], t["b"]) == 0) & (dx * dx + dy * dy > 0)
        return F.when(aligned, F.when(hi > lo, F.struct(there(lo).alias("p"), there(hi).alias("q"), (at(t["b"]) > at(t["a"])).alias("forward"))))

    return F.filter(F.flatten(F.transform(_segments(a), lambda s: F.transform(_segments(b), lambda t: common(s, t)))), lambda z: z.isNotNull())


def diagnostics(ring: Column) -> Column:
    """struct(is_closed, repeated_points, crosses_itself, is_valid, reason) of a ring."""
    numbered = F.transform(_segments(ring), lambda s, i: F.struct(s["a"].alias("a"), s["b"].alias("b"), i.alias("i")))
    last = F.size(ring) - 2
    closed = F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1)
    repeated = F.exists(_segments(ring), lambda s: s["a"] == s["b"])
    itself = F.exists(numbered, lambda s: F.exists(numbered, lambda t: (t["i"] > s["i"] + 1) & ~((s["i"] == 0) & (t["i"] == last)) & _meet(s, t)))
    reason = F.when(F.size(ring) < 4, "too few points").when(~closed, "not closed").when(itself, "crosses itself").when(area(ring) <= EPS, "no area")
    return F.struct(closed.alias("is_closed"), repeated.alias("repeated_points"), itself.alias("crosses_itself"), reason.isNull().alias("is_valid"), reason.alias("reason"))


def simplify(path: Column, tolerance: float) -> Column:
    """Douglas-Peucker: no dropped point is further than ``tolerance`` from the path kept.

    Each round adds the furthest point of every stretch that needs one; rounds after the last change cost nothing.
    """
    def away(points: Column, i: Column, j: Column, k: Column) -> Column:
        a, b, p = F.get(points, i), F.get(points, j), F.get(points, k)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        far = dx * dx + dy * dy
        t = F.when(far > 0, F.least(F.greatest(((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / far, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        return F.hypot(p["x"] - a["x"] - t * dx, p["y"] - a["y"] - t * dy)

    def furthest(points: Column, i: Column, j: Column) -> Column:
        inner = F.transform(F.sequence(i + 1, F.greatest(j - 1, i + 1)), lambda k: F.struct(away(points, i, j, k).alias("d"), (-k).alias("k")))
        return F.when(j - i > 1, F.array_max(inner))

    def kept(points: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            keep = s["keep"]
            found = F.zip_with(F.slice(keep, F.lit(1), F.size(keep) - 1), F.slice(keep, F.lit(2), F.size(keep) - 1), lambda i, j: furthest(points, i, j))
            add = F.transform(F.filter(found, lambda z: z["d"] > tolerance), lambda z: -z["k"])
            more = _let(add, lambda new: F.struct(F.array_sort(F.concat(keep, new)).alias("keep"), (F.size(new) == 0).alias("done")))
            return F.when(s["done"], s).otherwise(more)

        start = F.struct(F.array(F.lit(0), F.size(points) - 1).alias("keep"), F.lit(False).alias("done"))
        rounds = F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1)))
        return F.when(F.size(points) < 3, points).otherwise(F.aggregate(rounds, start, step, lambda s: F.transform(s["keep"], lambda k: F.get(points, k))))

    return _let(path, lambda points: F.when(points.isNotNull(), kept(points)))


# --- the earth
def to_web_mercator(path: Column) -> Column:
    """EPSG:4326 (longitude, latitude) to EPSG:3857."""
    return F.transform(path, lambda p: _xy(MAJOR * F.radians(p["x"]), MAJOR * F.log(F.tan(pi / 4 + F.radians(p["y"]) / 2))))


def from_web_mercator(path: Column) -> Column:
    return F.transform(path, lambda p: _xy(F.degrees(p["x"] / MAJOR), F.degrees(2 * F.atan(F.exp(p["y"] / MAJOR)) - pi / 2)))
