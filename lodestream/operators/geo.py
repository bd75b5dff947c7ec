"""Planar geometry kernels on coordinate arrays, as built-in expressions.

A point is struct<x: double, y: double>; a path or ring is array<point>, and a
ring repeats its first point at its end. All kernels are Column -> Column (so
they stay inside the JVM and the optimizer sees them) except those that group
or join rows. Null in, null out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PATH = "array<struct<x:double,y:double>>"
#: Mean Earth radius, metres.
RADIUS = 6371008.8


def point(x, y) -> Column:
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


# --- text
def point_wkt(p: Column) -> Column:
    return F.concat(F.lit("POINT ("), p["x"].cast("string"), F.lit(" "), p["y"].cast("string"), F.lit(")"))


def _points_text(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ")


def line_wkt(path: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), _points_text(path), F.lit(")"))


def polygon_wkt(ring: Column) -> Column:
    return F.concat(F.lit("POLYGON (("), _points_text(ring), F.lit("))"))


def path_from_wkt(wkt: Column) -> Column:
    """POINT, LINESTRING or a POLYGON of one ring; other text gives null."""
    body = F.regexp_extract(wkt, r"^\s*(?i:POINT|LINESTRING|POLYGON)\s*\(+([^()]*)\)+\s*$", 1)
    pairs = F.transform(F.split(body, ","), lambda s: F.split(F.trim(s), r"\s+"))
    points = F.transform(pairs, lambda p: F.struct(F.when(F.size(p) == 2, F.get(p, 0).try_cast("double")).alias("x"), F.get(p, 1).try_cast("double").alias("y")))
    return F.get(F.transform(F.array(points), lambda z: F.when((body != "") & F.forall(z, lambda p: p["x"].isNotNull() & p["y"].isNotNull()), z)), 0)


# --- accessors and measures
def _let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _segments(path: Column) -> Column:
    """array of (a, b): neighbours along the path."""
    def pairs(p: Column) -> Column:
        n = F.greatest(F.size(p) - 1, F.lit(0))
        return F.zip_with(F.slice(p, F.lit(1), n), F.slice(p, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return _let(path, pairs)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def vertex_count(path: Column) -> Column:
    return F.when(path.isNotNull(), F.size(path))


def bounds(path: Column) -> Column:
    xs, ys = F.transform(path, lambda p: p["x"]), F.transform(path, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def envelope(path: Column) -> Column:
    b = bounds(path)
    return F.when(path.isNotNull(), rectangle(b["minx"], b["miny"], b["maxx"], b["maxy"]))


def accessors(path: Column) -> Column:
    first, last = F.get(path, F.lit(0)), F.get(path, F.size(path) - 1)
    return F.struct(F.size(path).alias("num_points"), (F.size(path) == 0).alias("is_empty"), ((first["x"] == last["x"]) & (first["y"] == last["y"])).alias("is_closed"), first["x"].alias("start_x"), first["y"].alias("start_y"), last["x"].alias("end_x"), last["y"].alias("end_y"))


def _signed_area(ring: Column) -> Column:
    return _total(F.transform(_segments(ring), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])) / 2


def area(ring: Column) -> Column:
    return F.abs(_signed_area(ring))


def distance(p: Column, q: Column) -> Column:
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def length(path: Column) -> Column:
    return _total(F.transform(_segments(path), lambda s: distance(s["a"], s["b"])))


perimeter = length


def centroid(ring: Column) -> Column:
    """Area-weighted; of a ring without area, the mean of its points."""
    cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]

    def middle(r: Column, a: Column) -> Column:
        part = lambda k: _total(F.transform(_segments(r), lambda s: (s["a"][k] + s["b"][k]) * cross(s))) / (6 * a)
        mean = lambda k: _total(F.transform(r, lambda p: p[k])) / F.size(r)
        return F.when(a != 0, _let(F.array(part("x"), part("y")), lambda z: point(z[0], z[1]))).otherwise(_let(F.array(mean("x"), mean("y")), lambda z: point(z[0], z[1])))

    return _let(ring, lambda r: _let(_signed_area(r), lambda a: middle(r, a)))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def hausdorff_distance(a: Column, b: Column) -> Column:
    """Discrete: over vertices, both ways."""
    one = lambda p, q: F.array_max(F.transform(p, lambda u: F.array_min(F.transform(q, lambda v: distance(u, v)))))
    return F.greatest(one(a, b), one(b, a))


# --- transforms
def affine_transform(path: Column, a: float, b: float, d: float, e: float, xoff: float = 0.0, yoff: float = 0.0) -> Column:
    return F.transform(path, lambda p: F.struct((a * p["x"] + b * p["y"] + xoff).alias("x"), (d * p["x"] + e * p["y"] + yoff).alias("y")))


def translate(path: Column, dx, dy) -> Column:
    return F.transform(path, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def scale(path: Column, sx: float, sy: float) -> Column:
    return affine_transform(path, sx, 0.0, 0.0, sy)


def rotate(path: Column, degrees: float) -> Column:
    from math import cos, radians, sin

    r = radians(degrees)
    return affine_transform(path, cos(r), -sin(r), sin(r), cos(r))


def snap_to_grid(path: Column, size: float) -> Column:
    """Rounded coordinates; points that fall on the one before them go."""
    at = F.transform(path, lambda p: F.struct((F.floor(p["x"] / size + 0.5) * size).alias("x"), (F.floor(p["y"] / size + 0.5) * size).alias("y")))
    return F.aggregate(at, F.array().cast(PATH), lambda s, p: F.when((F.size(s) > 0) & (F.get(s, F.size(s) - 1) == p), s).otherwise(F.concat(s, F.array(p))))


def densify(path: Column, most: float) -> Column:
    """Vertices added so that no segment is longer than ``most``."""
    def cut(s: Column) -> Column:
        n = F.greatest(F.ceil(distance(s["a"], s["b"]) / most), F.lit(1))
        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: F.struct((s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * k / n).alias("x"), (s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * k / n).alias("y")))

    return F.concat(F.flatten(F.transform(_segments(path), cut)), F.slice(path, -1, 1))


# --- linear referencing
def line_interpolate_point(path: Column, at: Column) -> Column:
    """The point at distance ``at`` along a path, clamped to its ends."""
    start = F.struct(F.lit(0.0).alias("done"), F.get(path, F.lit(0)).alias("p"))

    def step(s: Column, seg: Column) -> Column:
        d = distance(seg["a"], seg["b"])
        f = F.when(d > 0, F.least(F.greatest((at - s["done"]) / d, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        here = F.struct((seg["a"]["x"] + (seg["b"]["x"] - seg["a"]["x"]) * f).alias("x"), (seg["a"]["y"] + (seg["b"]["y"] - seg["a"]["y"]) * f).alias("y"))
        return F.struct((s["done"] + d).alias("done"), F.when(at > s["done"], here).otherwise(s["p"]).alias("p"))

    return F.aggregate(_segments(path), start, step, lambda s: s["p"])


def line_locate_point(path: Column, p: Column) -> Column:
    """Distance along a path of the place nearest to ``p`` (the first of equals)."""
    start = F.struct(F.lit(0.0).alias("done"), F.lit(float("inf")).alias("best"), F.lit(0.0).alias("at"))

    def step(s: Column, seg: Column) -> Column:
        d = distance(seg["a"], seg["b"])
        dx, dy = seg["b"]["x"] - seg["a"]["x"], seg["b"]["y"] - seg["a"]["y"]
        f = F.when(d > 0, F.least(F.greatest(((p["x"] - seg["a"]["x"]) * dx + (p["y"] - seg["a"]["y"]) * dy) / (d * d), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
        away = F.hypot(seg["a"]["x"] + dx * f - p["x"], seg["a"]["y"] + dy * f - p["y"])
        return F.struct((s["done"] + d).alias("done"), F.least(s["best"], away).alias("best"), F.when(away < s["best"], s["done"] + d * f).otherwise(s["at"]).alias("at"))

    return F.aggregate(_segments(path), start, step, lambda s: s["at"])


# --- predicates
def covers_point(ring: Column, p: Column, boundary: bool = True) -> Column:
    """Whether a ring has ``p`` inside it (even-odd rule), or on its boundary."""
    return _let(_segments(ring), lambda edges: _let(p, lambda q: _around(edges, q, boundary)))


def _around(edges: Column, p: Column, boundary: bool) -> Column:
    on = F.exists(edges, lambda s: ((s["b"]["x"] - s["a"]["x"]) * (p["y"] - s["a"]["y"]) == (s["b"]["y"] - s["a"]["y"]) * (p["x"] - s["a"]["x"])) & p["x"].between(F.least(s["a"]["x"], s["b"]["x"]), F.greatest(s["a"]["x"], s["b"]["x"])) & p["y"].between(F.least(s["a"]["y"], s["b"]["y"]), F.greatest(s["a"]["y"], s["b"]["y"])))
    crossings = F.size(F.filter(edges, lambda s: ((s["a"]["y"] > p["y"]) != (s["b"]["y"] > p["y"])) & (p["x"] < (s["b"]["x"] - s["a"]["x"]) * (p["y"] - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) + s["a"]["x"])))
    return (on | (crossings % 2 == 1)) if boundary else (~on & (crossings % 2 == 1))


def is_box(ring: Column) -> Column:
    """Whether a ring is an axis-parallel rectangle; never null. What holds for its bounds holds for such a ring, so nothing else has to be asked."""
    p, q, r, s, end = (F.get(ring, F.lit(k)) for k in range(5))
    same = lambda *pairs: reduce(lambda a, b: a & b, (u[k] == v[k] for u, v, k in pairs))
    along = same((p, q, "y"), (q, r, "x"), (r, s, "y"), (s, p, "x")) | same((p, q, "x"), (q, r, "y"), (r, s, "x"), (s, p, "y"))
    return F.coalesce((F.size(ring) == 5) & (p == end) & along, F.lit(False))


def box_gap(a: Column, b: Column, k: str) -> Column:
    """How far two boxes (``is_box``) are apart along an axis; negative where they share some of it."""
    ends = lambda z: (F.get(z, F.lit(0))[k], F.get(z, F.lit(2))[k])  # noqa: E731  opposite corners
    return F.greatest(F.least(*ends(a)), F.least(*ends(b))) - F.least(F.greatest(*ends(a)), F.greatest(*ends(b)))


# --- rows
def line_builder(df: DataFrame, group_by: list[str], order_by: str, x: str, y: str, output: str = "path") -> DataFrame:
    """Points in order to a path for each group; a group of fewer than two has a null path."""
    path = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_by).alias("k"), point(x, y).alias("p")))), lambda v: v["p"])
    return df.groupBy(*group_by).agg(path.alias(output)).withColumn(output, F.when(F.size(output) >= 2, F.col(output)))


def polygon_builder(df: DataFrame, group_by: list[str], order_by: str, x: str, y: str, output: str = "ring") -> DataFrame:
    """As ``line_builder``, closed; fewer than three points have a null ring."""
    path = line_builder(df, group_by, order_by, x, y, output)
    return path.withColumn(output, F.when(F.size(output) >= 3, F.concat(F.col(output), F.slice(output, 1, 1))))


def generate_grid(spark, x0: float, y0: float, x1: float, y1: float, size: float) -> DataFrame:
    from math import ceil

    columns, rows = ceil((x1 - x0) / size), ceil((y1 - y0) / size)
    cells = spark.range(columns * rows).select((F.col("id") % columns).alias("col"), F.floor(F.col("id") / columns).alias("row"))
    return cells.withColumn("ring", rectangle(x0 + F.col("col") * size, y0 + F.col("row") * size, x0 + (F.col("col") + 1) * size, y0 + (F.col("row") + 1) * size))


def grid_over(df: DataFrame, path: str, size: float, max_cells: int = 10_000_000) -> DataFrame:
    """(col, row, ring): the square cells, counted from the origin, that cover the extent of all paths of ``df``."""
    b = bounds(F.col(path))
    ends = df.select(*(f(b[k]).alias(k) for k, f in (("minx", F.min), ("miny", F.min), ("maxx", F.max), ("maxy", F.max))))
    one = ends.select(*(_cell(F.col(k), size).alias(k) for k in ends.columns)).where("minx IS NOT NULL")
    n = (F.col("maxx") - F.col("minx") + 1) * (F.col("maxy") - F.col("miny") + 1)
    checked = F.when(n > max_cells, F.raise_error(F.concat(F.lit("a grid of more cells than max_cells: "), n.cast("string"))).cast("long")).otherwise(F.col("minx"))
    columns = one.select(F.explode(F.sequence(checked, "maxx")).alias("col"), "miny", "maxy").repartition("col")  # rows of cells are made where their column is
    cells = columns.select("col", F.explode(F.sequence("miny", "maxy")).alias("row"))
    return cells.withColumn("ring", rectangle(F.col("col") * size, F.col("row") * size, (F.col("col") + 1) * size, (F.col("row") + 1) * size))


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size)


def sjoin_points(polygons: DataFrame, points: DataFrame, ring: str, p: str, size: float, how: str = "inner") -> DataFrame:
    """Polygons with the points they cover: an equi-join on grid cells, the test of the box, then the exact one where the polygon is no box. ``size``: of a cell, about a polygon's extent.

    ``how``: inner; left (polygons that cover none have a row of nulls); semi or anti (polygons that cover any, or none). Both sides are
    shuffled by cell: the rows of cells are many times the tables, whose files say nothing of that, so a broadcast would fill the driver.
    """
    if how not in ("inner", "left", "semi", "anti"):
        raise ValueError(f"unknown how: {how}")
    b = bounds(F.col(ring))
    inside = F.col(f"{p}.x").between(F.col("_b.minx"), F.col("_b.maxx")) & F.col(f"{p}.y").between(F.col("_b.miny"), F.col("_b.maxy"))
    inside &= F.col("_box") | covers_point(F.col(ring), F.col(p))
    cells = polygons.withColumns({"_b": b, "_box": is_box(F.col(ring))}).withColumn("_cx", F.explode(F.sequence(_cell(F.col("_b.minx"), size), _cell(F.col("_b.maxx"), size)))).withColumn("_cy", F.explode(F.sequence(_cell(F.col("_b.miny"), size), _cell(F.col("_b.maxy"), size))))
    placed = points.withColumns({"_cx": _cell(F.col(f"{p}.x"), size), "_cy": _cell(F.col(f"{p}.y"), size)})
    met = cells.hint("merge").join(placed.hint("merge"), ["_cx", "_cy"]).where(inside).drop("_cx", "_cy", "_b", "_box")
    if how == "inner":
        return met
    same = lambda df: [F.col(c).eqNullSafe(df[f"_own_{c}"]) for c in polygons.columns]
    # a polygon is found once a cell, however many points it covers
    spots = placed.select(p, F.col("_cx").alias("_px"), F.col("_cy").alias("_py"))
    on = (F.col("_cx") == F.col("_px")) & (F.col("_cy") == F.col("_py")) & inside
    found = cells.hint("merge").join(spots.hint("merge"), on, "left_semi").select(*(F.col(c).alias(f"_own_{c}") for c in polygons.columns)).distinct().hint("merge")
    if how == "semi":
        return polygons.join(found, same(found), "left_semi")
    none = polygons.join(found, same(found), "left_anti")
    return none if how == "anti" else met.unionByName(none, allowMissingColumns=True)


def count_points_in_polygons(polygons: DataFrame, points: DataFrame, key: str, ring: str, p: str, size: float, output: str = "n") -> DataFrame:
    """Polygons with the number of points they cover; points at one place meet a polygon once."""
    places = points.select(p).where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("_n"))
    counted = sjoin_points(polygons.select(key, ring), places, ring, p, size).groupBy(key).agg(F.sum("_n").alias(output))
    return polygons.join(counted.hint("merge"), key, "left").withColumn(output, F.coalesce(output, F.lit(0)))


def within_distance(left: DataFrame, right: DataFrame, p: str, q: str, most: float) -> DataFrame:
    """Pairs of points at most ``most`` apart, through cells of that size and their neighbours."""
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    a = left.withColumn("_n", F.explode(near)).withColumns({"_cx": _cell(F.col(f"{p}.x"), most) + F.col("_n.i"), "_cy": _cell(F.col(f"{p}.y"), most) + F.col("_n.j")}).drop("_n")
    b = right.withColumns({"_cx": _cell(F.col(f"{q}.x"), most), "_cy": _cell(F.col(f"{q}.y"), most)})
    return a.hint("merge").join(b.hint("merge"), ["_cx", "_cy"]).withColumn("distance", distance(F.col(p), F.col(q))).where(F.col("distance") <= most).drop("_cx", "_cy")


def nearest(left: DataFrame, right: DataFrame, key: str, right_key: str, p: str, q: str, most: float, k: int = 1, how: str = "inner") -> DataFrame:
    """The ``k`` nearest right points within ``most`` of each left point; ties go to the least right key.

    With ``k`` above 1, ``rank`` counts them from 1. ``how="left"`` keeps left points with nothing near, with nulls.
    The search is that of ``neighbours.nearest``, once for each different place, so crowded surroundings make no pairs.
    """
    from lodestream.operators import neighbours

    places = left.select(F.col(p).alias("_place")).where(F.col("_place").isNotNull()).distinct()
    near = neighbours.nearest(places, right.select(F.col(right_key).alias("_key"), F.col(q).alias("_q")), "_place", "_key", "_place", "_q", k).where(F.col("distance") <= most)
    near = near.select("_place", F.col("_key").alias(right_key), "distance").hint("merge")
    pairs = left.select(key, F.col(p).alias("_place")).join(near, "_place").select(key, right_key, "distance")
    if k == 1:
        found = pairs.groupBy(key).agg(F.min(F.struct("distance", right_key)).alias("_m")).select(key, F.col(f"_m.{right_key}").alias(right_key), F.col("_m.distance").alias("distance"))
    else:
        found = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("distance", right_key))).where(F.col("rank") <= k)
    return left.select(key).join(found, key, "left") if how == "left" else found


def collect(df: DataFrame, by: list[str], p: str, output: str = "points") -> DataFrame:
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(p)).alias(output))


def dissolve_bounds(df: DataFrame, by: list[str], path: str) -> DataFrame:
    """The joint extent of each group."""
    b = bounds(F.col(path))
    return df.groupBy(*by).agg(F.min(b["minx"]).alias("minx"), F.min(b["miny"]).alias("miny"), F.max(b["maxx"]).alias("maxx"), F.max(b["maxy"]).alias("maxy"))
