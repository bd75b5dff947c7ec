"""What keeps polygons from being a coverage: overlaps, gaps, and edges that neighbours do not share vertex by vertex; and coverages simplified as one.

Shapes are those of ``shapes``; only polygons count. Everything is joined by grid
cells of ``size`` (shuffled by cell, never broadcast), about the extent of a shape (for ``unmatched``, the length of an
edge, where shapes are much larger). Each pair is found in one cell alone, so
nothing is deduplicated over the whole table. Places are rounded to
``linework.DECIMALS`` decimals; what is smaller than that is not seen. Null and
empty shapes have no faults; rows of one key are one shape of the coverage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.operators import outlines as U
from lodestream.operators import overlay as O
from lodestream.operators.geo import _cell, _segments, _signed_area, bounds, covers_point, length
from lodestream.operators.linework import _between, _cut, _sewn

#: Times that the tolerance of an arc is halved before it stays as it is.
HALVINGS = 5


def _rows(df: DataFrame, key: str, shape: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), U._oriented(F.col(shape)).alias("rings")).where(F.size("rings") > 0)


def overlaps(df: DataFrame, key: str, shape: str, size: float) -> DataFrame:
    """(key, other, area): pairs of shapes, key < other, whose interiors meet, with the area they have in common."""
    celled = _rows(df, key, shape).withColumn("box", bounds(F.flatten("rings")))
    celled = U._celled(celled, F.col("box.minx"), F.col("box.miny"), F.col("box.maxx"), F.col("box.maxy"), size)
    a, b = (celled.select("cx", "cy", *(F.col(c).alias(f"{c}_{n}") for c in ("key", "rings", "box"))) for n in "ab")
    meet = F.lit(True)
    for k, cell in (("x", "cx"), ("y", "cy")):
        low = F.greatest(F.col(f"box_a.min{k}"), F.col(f"box_b.min{k}"))
        meet = meet & (low < F.least(F.col(f"box_a.max{k}"), F.col(f"box_b.max{k}"))) & (_cell(low, size) == F.col(cell))
    pairs = a.hint("merge").join(b.hint("merge"), ["cx", "cy"]).where((F.col("key_a") < F.col("key_b")) & meet)
    # a polygon is its shells less its holes, which run clockwise, so that their common areas count as negative
    common = F.aggregate("rings_a", F.lit(0.0), lambda s, r: s + F.aggregate("rings_b", F.lit(0.0), lambda t, q: t + O.common_area(r, q)))
    found = pairs.select(F.col("key_a").alias("key"), F.col("key_b").alias("other"), common.alias("area"))
    return found.groupBy("key", "other").agg(F.sum("area").alias("area")).where(F.col("area") > O.EPS)


def gaps(df: DataFrame, shape: str, size: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, ring, area, width): places that the shapes of a group enclose but none covers; the mean width tells slivers from lakes."""
    group = F.struct(*by) if by else F.struct(F.lit(1).alias("all"))
    rows = df.select(group.alias("g"), F.lit(0).alias("side"), U._oriented(F.col(shape)).alias("rings"))
    rings = U._rings(U._outline_edges(rows, size, lambda a, b: a | b)).withColumn("area", -_signed_area(F.col("ring"))).where(F.col("area") > O.EPS)
    return rings.select(*(F.col(f"g.{c}").alias(c) for c in by), "ring", "area", (2 * F.col("area") / length(F.col("ring"))).alias("width"))


def _apart(p: Column, a: Column, b: Column) -> Column:
    """Distance of a point from the edge a to b."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.least(F.greatest(((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
    return F.hypot(p["x"] - a["x"] - t * dx, p["y"] - a["y"] - t * dy)


def unmatched(df: DataFrame, key: str, shape: str, size: float, tolerance: float = 0.0) -> DataFrame:
    """(key, other, place, distance): vertices of ``other`` within ``tolerance`` of the outline of ``key`` that are no vertices of it.

    With a tolerance of 0, those are vertices on an edge of a neighbour that has none there (T-junctions).
    """
    near = tolerance + O.EPS
    edges = _rows(df, key, shape).select("key", F.explode(F.flatten(F.transform("rings", _segments))).alias("e")).where("e.a <> e.b")
    places = edges.select(F.col("key").alias("other"), F.col("e.a").alias("place")).distinct()
    places = places.withColumns({"cx": _cell(F.col("place.x"), size), "cy": _cell(F.col("place.y"), size)})
    low, high = (lambda k: F.least(f"e.a.{k}", f"e.b.{k}") - near), (lambda k: F.greatest(f"e.a.{k}", f"e.b.{k}") + near)
    met = U._celled(edges, low("x"), low("y"), high("x"), high("y"), size).hint("merge").join(places.hint("merge"), ["cx", "cy"]).where(F.col("key") != F.col("other"))
    met = met.where(F.col("place.x").between(low("x"), high("x")) & F.col("place.y").between(low("y"), high("y")))
    met = met.withColumn("distance", _apart(F.col("place"), F.col("e.a"), F.col("e.b"))).where(F.col("distance") <= near)
    shared = (F.col("place") == F.col("e.a")) | (F.col("place") == F.col("e.b"))
    found = met.groupBy("key", "other", "place").agg(F.min("distance").alias("distance"), F.bool_or(shared).alias("shared"))
    return found.where(~F.col("shared")).drop("shared")


def faults(df: DataFrame, key: str, shape: str, size: float, tolerance: float = 0.0) -> DataFrame:
    """(fault, key, other, place, measure): all of them. An overlap has its area; a gap its ring and area; an unmatched vertex its place and distance."""
    none = F.lit(None).cast(O.PATH)
    kind = dict(df.dtypes)[key]
    over = overlaps(df, key, shape, size).select(F.lit("overlap").alias("fault"), "key", "other", none.alias("place"), F.col("area").alias("measure"))
    open_ = gaps(df, shape, size).select(F.lit("gap"), F.lit(None).cast(kind), F.lit(None).cast(kind), "ring", "area")
    loose = unmatched(df, key, shape, size, tolerance).select(F.lit("vertex"), "key", "other", F.array("place"), "distance")
    return over.union(open_).union(loose)


# --- simplification
def _arcs(rows: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """The edges of each shape, cut where shapes meet (key, a, b: its area on the left), and the arcs that they make together (arc, path).

    An arc runs between places where other than two pieces end, or around; all shapes along it are the same.
    """
    steps = rows.select("key", F.lit(0).alias("g"), F.explode(F.flatten(F.transform("rings", _segments))).alias("e")).where("e.a <> e.b")
    steps = steps.select("key", "g", (F.col("e.a") < F.col("e.b")).alias("ahead"), F.struct(F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b")).alias("s"))
    pieces = _cut(U._noded(steps.select("g", "s").distinct(), size))
    along = lambda p, q: F.when(F.col("ahead"), F.col(p)).otherwise(F.col(q))
    edges = _cut(steps.join(pieces, ["g", "s"]).select("key", along("p", "q").alias("a"), along("q", "p").alias("b")).distinct())
    once = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sewn = _sewn(_cut(once.select(F.struct("a", "b").alias("key"), "a", "b", F.array("a", "b").alias("path"))))
    return edges, _cut(sewn.select(F.col("key").alias("arc"), "path"))


def _thinned(path: Column, tolerance: Column) -> Column:
    """Douglas-Peucker with the ends of an arc fixed; one that runs around also keeps the place furthest from its start."""
    def around(p: Column) -> Column:
        start = F.get(p, F.lit(0))
        far = F.array_max(F.transform(p, lambda v, i: F.struct(F.hypot(v["x"] - start["x"], v["y"] - start["y"]).alias("d"), i.alias("i"))))["i"]

        def halves(k: Column) -> Column:
            back = O.simplify(F.slice(p, k + 1, F.size(p) - k), tolerance)
            return F.concat(O.simplify(F.slice(p, F.lit(1), k + 1), tolerance), O._let(back, lambda z: F.slice(z, F.lit(2), F.size(z) - 1)))

        return O._let(far, halves)

    return O._let(path, lambda p: F.when(F.get(p, F.lit(0)) == F.get(p, F.size(p) - 1), around(p)).otherwise(O.simplify(p, tolerance)))


def _strays(s: Column, t: Column) -> Column:
    """Whether two edges share more than one end."""
    ends = lambda e: (e["a"], e["b"])
    same = (F.least(*ends(s)) == F.least(*ends(t))) & (F.greatest(*ends(s)) == F.greatest(*ends(t)))
    one = (s["a"] == t["a"]) | (s["a"] == t["b"]) | (s["b"] == t["a"]) | (s["b"] == t["b"])
    in_line = (O._cross(s["a"], s["b"], t["a"]) == 0) & (O._cross(s["a"], s["b"], t["b"]) == 0)
    within = F.lit(False)
    for e, f in ((s, t), (t, s)):
        for v in ends(e):
            within |= _between(f, v) & (v != f["a"]) & (v != f["b"])
    return same | F.when(one, in_line & within).otherwise(O._meet(s, t))


def _stretches(path: Column, thin: Column) -> Column:
    """A ring for each edge of ``thin`` that left places out: that stretch of the path, and back."""
    def stretch(e: Column) -> Column:
        i = F.array_position(path, e["a"]).cast("int")
        return O._let(i, lambda k: F.concat(F.slice(path, k, F.array_position(F.slice(path, k + 1, F.size(path)), e["b"]).cast("int") + 1), F.array(e["a"])))

    return F.filter(F.transform(_segments(thin), stretch), lambda r: F.size(r) > 3)


def _entangled(arcs: DataFrame, size: float) -> DataFrame:
    """(arc): those that were thinned and now meet an edge they had not met, or have left a place on their other side."""
    low, high = (lambda k: F.least(f"s.a.{k}", f"s.b.{k}")), (lambda k: F.greatest(f"s.a.{k}", f"s.b.{k}"))
    edges = arcs.select("arc", "live", F.posexplode(_segments(F.col("thin"))).alias("i", "s"))
    edges = edges.select("arc", "live", "i", "s", low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"))
    celled = _cut(U._celled(edges, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size))
    other = celled.select("cx", "cy", *(F.col(c).alias(f"o_{c}") for c in ("arc", "i", "s", "x0", "y0", "x1", "y1")))
    first = (F.col("cx") == _cell(F.greatest("x0", "o_x0"), size)) & (F.col("cy") == _cell(F.greatest("y0", "o_y0"), size))
    near = (F.col("x1") >= F.col("o_x0")) & (F.col("o_x1") >= F.col("x0")) & (F.col("y1") >= F.col("o_y0")) & (F.col("o_y1") >= F.col("y0"))
    apart = (F.col("arc") != F.col("o_arc")) | (F.col("i") != F.col("o_i"))
    met = celled.where("live").join(other, ["cx", "cy"]).where(first & near & apart & _strays(F.col("s"), F.col("o_s"))).select("arc")
    places = arcs.select(F.explode("thin").alias("p")).distinct()
    places = places.withColumns({"cx": _cell(F.col("p.x"), size), "cy": _cell(F.col("p.y"), size)})
    left = arcs.where("live").select("arc", F.explode(_stretches(F.col("path"), F.col("thin"))).alias("ring")).withColumn("box", bounds(F.col("ring")))
    left = U._celled(left, F.col("box.minx"), F.col("box.miny"), F.col("box.maxx"), F.col("box.maxy"), size)
    inside = F.col("p.x").between(F.col("box.minx"), F.col("box.maxx")) & F.col("p.y").between(F.col("box.miny"), F.col("box.maxy"))
    passed = left.join(places, ["cx", "cy"]).where(inside & ~F.array_contains("ring", F.col("p")) & covers_point(F.col("ring"), F.col("p"), boundary=False)).select("arc")
    return met.union(passed).distinct()


def simplify(df: DataFrame, key: str, shape: str, size: float, tolerance: float) -> DataFrame:
    """(key, shape): the polygons of a coverage simplified as one, so that neighbours still share their borders: no gap, no overlap.

    Borders are cut into arcs where shapes meet, and each arc is thinned once, for all shapes along it, by Douglas-Peucker. An arc that
    would then cross or touch what it did not, or would pass by a place (a small island), gets half the tolerance, up to ``HALVINGS`` times,
    then stays as it is; so no shape, hole or part vanishes, and what was apart stays apart. Places where a neighbour has a vertex on an
    edge are vertices of both. Each round is a job; the driver gets only whether any arc is left. Shapes without area have no row.
    ``key`` is unique. Shapes that overlap are each simplified, but crossings of their borders stay.
    """
    edges, arcs = _arcs(_cut(_rows(df, key, shape)), size)
    # a tolerance beyond the extent of an arc does what the extent does
    box = bounds(F.col("path"))
    most = F.least(F.lit(float(tolerance)), F.hypot(box["maxx"] - box["minx"], box["maxy"] - box["miny"]))
    arcs = arcs.withColumn("most", most).withColumns({"turn": F.lit(0), "thin": _thinned(F.col("path"), F.col("most"))})
    while True:
        arcs = _cut(arcs.withColumn("live", F.size("thin") < F.size("path")))
        bad = _cut(_entangled(arcs, size))
        if bad.isEmpty():
            break
        turned = arcs.join(bad.withColumn("bad", F.lit(True)), "arc", "left").withColumns({"again": F.coalesce("bad", F.lit(False)), "turn": F.col("turn") + F.coalesce(F.col("bad").cast("int"), F.lit(0))})
        thin = F.when(~F.col("again"), F.col("thin")).when(F.col("turn") > HALVINGS, F.col("path")).otherwise(_thinned(F.col("path"), F.col("most") / F.pow(F.lit(2.0), F.col("turn"))))
        arcs = turned.withColumn("thin", thin).select("arc", "path", "most", "turn", "thin")
    # a shape has an arc forwards or backwards, as it has the arc's first edge
    p, q = F.get("path", F.lit(0)), F.get("path", F.lit(1))
    ways = arcs.select(p.alias("a"), q.alias("b"), "thin").union(arcs.select(q, p, F.reverse("thin")))
    walks = edges.join(ways, ["a", "b"]).select(F.struct("key").alias("g"), F.explode(_segments(F.col("thin"))).alias("e")).select("g", "e.a", "e.b")
    found = U._polygons(U._rings(walks, straighten=False), size).select("g.key", "shape")
    return U._one_each(found, ["key"], "shape").select(F.col("key").alias(key), F.col("shape").alias(shape))
