"""Nearest neighbours without a limit, distances between shapes, and spatial joins by distance.

``nearest`` finds the k nearest right points of every left point, however far. The
right points are laid out in a tree of square cells: a cell with more than ``LEAF``
points is divided, three halvings at a time, so a crowded place has small cells and
an empty region none. Each left point goes down the tree with the cells that may
hold its neighbours: those whose least distance is at most the distance within which
the cells at hand surely hold k points. So an outlier meets a few cells of a distant
cluster, not its points, and no radius is guessed. Rounds are as many as the tree is
deep; each is one equi-join on cells. Cells and what goes down are rows, joined and
aggregated by Spark; per left point a round holds a few cells for each neighbour.

Points at one place are one point of the tree with its k least keys, so copies make
no pairs. Ties go to the least right key. Null points and null keys of the right side
have no place; null points of the left side have no neighbours.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators import overlay as O
from lodestream.operators.geo import _cell, _segments, box_gap, covers_point, distance, is_box
from lodestream.operators.geo import bounds as _bounds
from lodestream.operators.linework import _written as _cut

#: Points (places) of a cell that is not divided, halvings of the whole extent down to the least cell, and those of one step.
LEAF, DEPTH, STEP = 64, 30, 3
_SALTS = 64


def _least_keys(right: DataFrame, key: str, q: str, k: int) -> DataFrame:
    """(q, keys): the k least keys of each place, in two steps so that a crowded place is not in one task."""
    rows = right.select(F.struct(F.col(q)["x"].alias("x"), F.col(q)["y"].alias("y")).alias("q"), F.col(key).alias("k")).where("q.x IS NOT NULL AND q.y IS NOT NULL AND k IS NOT NULL")
    if k == 1:
        return rows.groupBy("q").agg(F.array(F.min("k")).alias("keys"))
    for salt in ([F.pmod(F.xxhash64("k"), F.lit(_SALTS)).alias("salt")], []):
        held = rows.select("q", "k", *salt)
        place = Window.partitionBy("q", *(["salt"] if salt else [])).orderBy("k")
        rows = held.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k).select("q", "k")
    return rows.groupBy("q").agg(F.sort_array(F.collect_list("k")).alias("keys"))


def _node(level, x: str = "ix", y: str = "iy") -> list[Column]:
    """The cell of a place at a level: its number along each axis."""
    by = DEPTH - level
    return [F.shiftright(F.col(x), by).alias("cx"), F.shiftright(F.col(y), by).alias("cy")]


def _tree(places: DataFrame) -> DataFrame:
    """(level, cx, cy, n, w, leaf, box): cells that are the root or within a divided one. ``n`` counts places, ``w`` keys."""
    box = [F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy")]
    finest = places.groupBy("ix", "iy").agg(F.count("*").alias("n"), F.sum(F.size("keys")).alias("w"), F.min("q.x").alias("minx"), F.min("q.y").alias("miny"), F.max("q.x").alias("maxx"), F.max("q.y").alias("maxy"))
    finest = _cut(finest)
    levels = [finest.groupBy(*_node(level)).agg(F.sum("n").alias("n"), F.sum("w").alias("w"), *box).withColumn("level", F.lit(level)) for level in range(0, DEPTH + 1, STEP)]
    nodes = _cut(reduce(lambda a, b: a.union(b), levels).withColumn("leaf", (F.col("n") <= LEAF) | (F.col("level") == DEPTH)))
    above = nodes.where("NOT leaf").select((F.col("level") + STEP).alias("level"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    inner = nodes.where("level > 0").withColumns({"px": F.shiftright("cx", STEP), "py": F.shiftright("cy", STEP)}).join(above, ["level", "px", "py"]).select(*nodes.columns)
    return _cut(nodes.where("level = 0").union(inner))


def nearest(left: DataFrame, right: DataFrame, key: str, right_key: str, p: str, q: str, k: int = 1, how: str = "inner") -> DataFrame:
    """(key, right_key, distance, rank): the ``k`` nearest right points of each left point, however far.

    Keys are unique within each side. ``how="left"`` keeps left points without neighbours (no right points, or a null point), with nulls.
    """
    if k < 1 or how not in ("inner", "left"):
        raise ValueError("k is at least 1, how is inner or left")
    places = _cut(_least_keys(right, right_key, q, k))
    ends = places.agg(F.min("q.x").alias("x0"), F.min("q.y").alias("y0"), F.max("q.x").alias("x1"), F.max("q.y").alias("y1")).first()
    extent = max(ends.x1 - ends.x0, ends.y1 - ends.y0) if ends.x0 is not None else 0.0
    scale = (1 << DEPTH) / extent if extent > 0 else 0.0
    at = lambda c, start: F.least(F.floor((F.col(c) - (start or 0.0)) * scale), F.lit((1 << DEPTH) - 1))
    places = _cut(places.withColumns({"ix": at("q.x", ends.x0), "iy": at("q.y", ends.y0)}))
    nodes = _tree(places)
    own = left.select(F.col(key).alias("id"), F.col(p)["x"].alias("x"), F.col(p)["y"].alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    out_x, out_y = (F.greatest(F.col(f"min{a}") - F.col(a), F.col(a) - F.col(f"max{a}"), F.lit(0.0)) for a in ("x", "y"))
    far_x, far_y = (F.greatest(F.abs(F.col(a) - F.col(f"min{a}")), F.abs(F.col(f"max{a}") - F.col(a))) for a in ("x", "y"))
    cell = ["level", "cx", "cy", "w", "leaf", "near", "far"]

    def close(rows: DataFrame) -> DataFrame:
        """Of the cells of each left point those that may hold one of its k nearest."""
        by_far = Window.partitionBy("id").orderBy("far", "level", "cx", "cy")
        sure = F.sum("w").over(by_far.rowsBetween(Window.unboundedPreceding, 0))
        bound = F.min(F.when(F.col("_sure") >= k, F.col("far"))).over(Window.partitionBy("id"))
        slack = 1 + 1e-12  # distances are rounded
        return rows.withColumn("_sure", sure).withColumn("_bound", bound).where(F.col("_bound").isNull() | (F.col("near") <= F.col("_bound") * slack)).select("id", "x", "y", *cell)

    def measured(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"near": F.hypot(out_x, out_y), "far": F.hypot(far_x, far_y)}).select("id", "x", "y", *cell)

    levels = sorted(r.level for r in nodes.where("NOT leaf").select("level").distinct().collect())  # DEPTH / STEP at most
    going = measured(own.crossJoin(F.broadcast(nodes.where("level = 0"))))  # the root alone
    for level in levels:
        going = _cut(going)
        stay = going.where((F.col("level") != level) | F.col("leaf"))
        below = nodes.where(F.col("level") == level + STEP).withColumns({"px": F.shiftright("cx", STEP), "py": F.shiftright("cy", STEP)})
        down = going.where((F.col("level") == level) & ~F.col("leaf")).select("id", "x", "y", F.col("cx").alias("px"), F.col("cy").alias("py"))
        going = close(stay.union(measured(down.join(below, ["px", "py"]))))
    going = _cut(going)
    wanted = going.select("level").distinct()
    held = nodes.where("leaf").join(F.broadcast(wanted), "level").select("level", "cx", "cy")
    by_level = [places.select(F.lit(level).alias("level"), *_node(level), "q", "keys") for level in range(0, DEPTH + 1, STEP)]
    members = reduce(lambda a, b: a.union(b), by_level).join(held, ["level", "cx", "cy"])
    pairs = going.select("id", "x", "y", "level", "cx", "cy").join(members, ["level", "cx", "cy"]).withColumn("distance", F.hypot(F.col("x") - F.col("q.x"), F.col("y") - F.col("q.y")))
    pairs = pairs.select("id", "distance", F.explode("keys").alias("other"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "other"))
    found = pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias(key), F.col("other").alias(right_key), "distance", "rank")
    return left.select(key).join(found, key, "left") if how == "left" else found


# --- distances between shapes
def _to_segment(p: Column, s: Column) -> Column:
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    long = dx * dx + dy * dy
    f = F.when(long > 0, F.least(F.greatest(((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy) / long, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.hypot(s["a"]["x"] + dx * f - p["x"], s["a"]["y"] + dy * f - p["y"])


def _stretches(path: Column) -> Column:
    """Segments of a path; a path of one point has one, from it to itself."""
    one = F.transform(path, lambda p: F.struct(p.alias("a"), p.alias("b")))
    return F.when(F.size(path) == 1, one).otherwise(_segments(path))


def shape_distance(a: Column, b: Column) -> Column:
    """The least distance of two points, paths or rings (closed: areas) of ``geo``; 0 where they meet. Null for an empty one."""
    def apart(s: Column, t: Column) -> Column:
        return F.when(O._meet(s, t), 0.0).otherwise(F.least(_to_segment(s["a"], t), _to_segment(s["b"], t), _to_segment(t["a"], s), _to_segment(t["b"], s)))

    least = O._let(_stretches(b), lambda of_b: F.array_min(F.transform(_stretches(a), lambda s: F.array_min(F.transform(of_b, lambda t: apart(s, t))))))
    within = (O.is_area(a) & covers_point(a, F.get(b, F.lit(0)))) | (O.is_area(b) & covers_point(b, F.get(a, F.lit(0))))
    boxes = F.hypot(*(F.greatest(box_gap(a, b, k), F.lit(0.0)) for k in ("x", "y")))
    return F.when(is_box(a) & is_box(b), boxes).when((F.size(a) > 0) & (F.size(b) > 0), F.when(within, 0.0).otherwise(least))


def box_distance(a: Column, b: Column) -> Column:
    """Of two boxes: never more than that of what is in them."""
    gap = lambda k: F.greatest(a[f"min{k}"] - b[f"max{k}"], b[f"min{k}"] - a[f"max{k}"], F.lit(0.0))
    return F.hypot(gap("x"), gap("y"))


def sjoin(left: DataFrame, right: DataFrame, a: str, b: str, size: float, predicate=O.intersects, within: float | None = None, how: str = "inner", key: str | None = None) -> DataFrame:
    """Rows whose shapes satisfy a predicate that implies that they meet; with ``within``, those at most so far apart instead, and their ``distance``.

    ``how``: inner; left (unmatched left rows once, with nulls), semi or anti; these need ``key``, unique on the left. A pair meets in every
    cell that both boxes share (the left one widened by ``within``) and counts in the least of them, so nothing has to be made distinct.
    Both sides are shuffled by cell, as in ``geo.sjoin_points``; whether a row is met at all is found by a semi join, without its pairs.
    """
    if how not in ("inner", "left", "semi", "anti"):
        raise ValueError(f"unknown how: {how}")
    if how != "inner" and key is None:
        raise ValueError("left, semi and anti joins need the left side's key")
    reach = within or 0.0
    name = lambda n: O.free_name(left.select("*", *(F.lit(0).alias(c) for c in right.columns if c not in left.columns)), n)
    box_a, box_b, cx, cy = map(name, ("_a", "_b", "_cx", "_cy"))
    ends = ("minx", "miny", "maxx", "maxy")
    grown = lambda box, by: {k: F.col(box)[k] + (by if k.startswith("max") else -by) for k in ends}

    def celled(df: DataFrame, shape: str, box: str, by: float) -> DataFrame:
        # once for each row, so that two boxes of the same cell are compared by numbers alone
        df = df.where(F.size(shape) > 0).withColumn(box, F.struct(*(_bounds(F.col(shape))[k].alias(k) for k in ends), is_box(F.col(shape)).alias("whole")))
        wide = grown(box, by)
        df = df.withColumn(cx, F.explode(F.sequence(_cell(wide["minx"], size), _cell(wide["maxx"], size))))
        return df.withColumn(cy, F.explode(F.sequence(_cell(wide["miny"], size), _cell(wide["maxy"], size))))

    cells_a, cells_b = celled(left, a, box_a, reach), celled(right, b, box_b, 0.0)
    of_a = grown(box_a, reach)
    boxes_meet = box_distance(of_a, F.col(box_b)) == 0
    apart = F.when(F.col(box_a)["whole"] & F.col(box_b)["whole"], box_distance(F.col(box_a), F.col(box_b))).otherwise(shape_distance(F.col(a), F.col(b)))
    keys = None
    if how != "inner":
        hit = predicate(F.col(a), F.col(b)) if within is None else apart <= within
        px, py = map(name, ("_px", "_py"))
        spots = cells_b.select(b, box_b, F.col(cx).alias(px), F.col(cy).alias(py)).hint("merge")
        on = (F.col(cx) == F.col(px)) & (F.col(cy) == F.col(py)) & boxes_meet & hit
        keys = cells_a.select(key, a, box_a, cx, cy).hint("merge").join(spots, on, "left_semi").select(key).distinct().hint("merge")
    if how == "semi":
        return left.join(keys, key, "left_semi")
    rest = left.join(keys, key, "left_anti") if keys is not None else None
    if how == "anti":
        return rest
    near = cells_a.hint("merge").join(cells_b.hint("merge"), [cx, cy])
    least = lambda k: _cell(F.greatest(of_a[k], F.col(f"{box_b}.{k}")), size)
    near = near.where((F.col(cx) == least("minx")) & (F.col(cy) == least("miny")) & boxes_meet)
    if within is None:
        met = near.where(predicate(F.col(a), F.col(b)))
    else:
        met = near.withColumn("distance", apart).where(F.col("distance") <= within)
    met = met.drop(cx, cy, box_a, box_b)
    return met if rest is None else met.unionByName(rest, allowMissingColumns=True)
