"""Concave hulls of point sets, one a row.

The hull is found on the Delaunay triangulation of a row's points, which array
expressions cannot build, so a small Arrow function does it, row by row; Spark
deals the rows.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush
from math import dist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream.operators.geo import PATH

Point = tuple[float, float]


def _turn(a: Point, b: Point, c: Point) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _in_circle(a: Point, b: Point, c: Point, p: Point) -> bool:
    """Whether ``p`` lies within the circle through a, b, c (counter-clockwise), by more than rounding."""
    rows = [(q[0] - p[0], q[1] - p[1]) for q in (a, b, c)]
    (ax, ay), (bx, by), (cx, cy) = rows
    sa, sb, sc = (x * x + y * y for x, y in rows)
    det = ax * (by * sc - cy * sb) - ay * (bx * sc - cx * sb) + sa * (bx * cy - cx * by)
    return det > 1e-12 * max(sa, sb, sc) ** 2


def _delaunay(points: list[Point]) -> dict[tuple[Point, Point], Point]:
    """Directed edge -> the third corner of the triangle on its left; ``points`` are sorted and distinct.

    Points are added from left to right to the hull so far, then edges are flipped until
    every circle is empty. Empty where all points are on one line.
    """
    start = next((k for k in range(2, len(points)) if _turn(points[0], points[1], points[k])), None)
    if start is None:
        return {}
    third: dict[tuple[Point, Point], Point] = {}

    def add(a: Point, b: Point, c: Point) -> None:
        third[a, b], third[b, c], third[c, a] = c, a, b

    line, first = points[:start], points[start]
    if _turn(line[0], line[1], first) < 0:
        line = line[::-1]
    for a, b in zip(line, line[1:]):
        add(a, b, first)
    hull = [*line, first]
    for p in points[start + 1 :]:
        n = len(hull)
        seen = [_turn(hull[k], hull[(k + 1) % n], p) < 0 for k in range(n)]
        begin = next(k for k in range(n) if seen[k] and not seen[k - 1])
        hull, seen = hull[begin:] + hull[:begin], seen[begin:] + seen[:begin]
        until = seen.index(False)
        for a, b in zip(hull[:until], hull[1 : until + 1]):
            add(b, a, p)
        hull = [hull[0], p, *hull[until:]]

    queue = [e for e in third if e[0] < e[1]]
    while queue:
        a, b = queue.pop()
        if (a, b) not in third or (b, a) not in third:
            continue
        c, d = third[a, b], third[b, a]
        if _in_circle(a, b, c, d) and _turn(c, d, b) > 0 and _turn(d, c, a) > 0:
            del third[a, b], third[b, a]
            add(c, d, b)
            add(d, c, a)
            queue += [(b, c), (c, a), (a, d), (d, b)]
    return third


def _hull(points: list[Point], ratio: float | None, max_edge: float | None) -> list[Point] | None:
    third = _delaunay(sorted(set(points)))
    if not third:
        return None
    lengths = {e: dist(*e) for e in third}
    if max_edge is None:
        least, most = min(lengths.values()), max(lengths.values())
        max_edge = least + ratio * (most - least)
    outside = {e: lengths[e] for e in third if e[::-1] not in third}
    corners = {a for a, _ in outside}
    queue = [(-d, e) for e, d in outside.items()]
    heapify(queue)
    while queue and -queue[0][0] > max_edge:
        a, b = e = heappop(queue)[1]
        c = third[e]
        if c in corners:
            continue
        corners.add(c)
        del outside[e]
        for inner in ((a, c), (c, b)):
            outside[inner] = dist(*inner)
            heappush(queue, (-outside[inner], inner))
    after = dict(outside.keys())
    ring = [min(after)]
    while (p := after[ring[-1]]) != ring[0]:
        ring.append(p)
    return [*ring, ring[0]]


def concave_hull(points: Column, ratio: float | None = None, max_edge: float | None = None) -> Column:
    """The characteristic hull of a path's points, as a counter-clockwise ring.

    From the triangulation's border the longest edge that exceeds ``max_edge`` gives way
    to its triangle's other two, as long as the border stays simple. ``ratio`` sets
    ``max_edge`` between the shortest (0) and the longest (1) edge of the triangulation.
    Null for null, and for fewer than three points that are not on one line; points with
    null coordinates do not count. All points of a row are held by one task.
    """
    if (ratio is None) == (max_edge is None):
        raise ValueError("concave_hull takes either ratio or max_edge")

    @F.pandas_udf(PATH)
    def hulls(rows: pd.Series) -> pd.Series:
        def one(row):
            found = None if row is None else _hull([(p["x"], p["y"]) for p in row if p is not None and p["x"] is not None and p["y"] is not None], ratio, max_edge)
            return None if found is None else [{"x": x, "y": y} for x, y in found]

        return rows.map(one, na_action=None)

    return hulls(points)
