"""Kernels that sew line work together: merged lines, faces, repaired rings.

Pieces of line are contracted in rounds: a junction of two pieces joins them if
its random rank in the round is below the ranks at the far ends of both. So no
piece joins twice in a round, a constant share of the junctions goes in each,
and a chain of n pieces takes about log n rounds of equi-joins. Only a flag a
round comes to the driver; each round is written to the shared folder. Keys are unique
within a group. Rows with a null path or fewer than two points have no line.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.operators import overlay as O
from lodestream.operators.geo import _segments, _signed_area, covers_point

#: Decimals that places have when crossings are cut.
DECIMALS = 9


def _written(df: DataFrame) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` (the warehouse where it is unset) and read back."""
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/pieces-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _cut(df: DataFrame) -> DataFrame:
    """As ``_written``; what is made of it joins by shuffles. Places compress so well that the size of their files says little of the memory a broadcast takes."""
    return _written(df).hint("merge")


def _ends(path: Column) -> tuple[Column, Column]:
    return F.get(path, F.lit(0)), F.get(path, F.size(path) - 1)


def _sewn(pieces: DataFrame) -> DataFrame:
    """``pieces`` (key, a, b, path: from junction a to junction b) joined wherever a junction has exactly two ends, of two pieces.

    The key of the result is the least of those joined.
    """
    turn = 0
    while True:
        turn += 1
        ends = pieces.select("key", F.explode(F.array("a", "b")).alias("j"))
        open_ = ends.groupBy("j").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).where("n = 2 AND lo <> hi")
        ranks = open_.select("j", F.xxhash64("j", F.lit(turn)).alias("rank"))
        if ranks.isEmpty():
            return pieces
        of_a, of_b = (ranks.select(F.col("j").alias(k), F.col("rank").alias(f"r{k}")) for k in ("a", "b"))
        ranked = pieces.join(of_a, "a", "left").join(of_b, "b", "left")
        at = F.when(F.col("ra").isNotNull() & (F.col("rb").isNull() | (F.col("ra") < F.col("rb"))), F.col("a")).when(F.col("rb").isNotNull() & (F.col("ra").isNull() | (F.col("rb") < F.col("ra"))), F.col("b"))
        chosen = ranked.select("key", "a", "b", "path", at.alias("at"))
        both = chosen.where("at IS NOT NULL").groupBy(F.col("at").alias("j")).agg(F.count("*").alias("n")).where("n = 2").select("j")
        marked = chosen.join(both, F.col("at") == F.col("j"), "left")
        # into the junction, then out of it: where both pieces begin or both end there, the one of the greater key turns
        ahead = F.struct("key", "a", "b", "path")
        back = F.struct("key", F.col("b").alias("a"), F.col("a").alias("b"), F.reverse("path").alias("path"))
        two = marked.where("j IS NOT NULL").groupBy("j").agg(F.min_by(F.when(F.col("b") == F.col("j"), ahead).otherwise(back), "key").alias("u"), F.max_by(F.when(F.col("a") == F.col("j"), ahead).otherwise(back), "key").alias("v"), F.max_by(F.col("b") == F.col("j"), "key").alias("v_in"), F.min_by(F.col("a") == F.col("j"), "key").alias("u_out"))
        joined = two.select(F.col("u.key").alias("key"), F.col("u.a").alias("a"), F.col("v.b").alias("b"), F.concat("u.path", F.slice("v.path", F.lit(2), F.size("v.path") - 1)).alias("path"), (F.col("u_out") & F.col("v_in")).alias("turned"))
        # where the whole is against both pieces' own directions, it turns
        joined = joined.select("key", F.when(F.col("turned"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("turned"), F.col("a")).otherwise(F.col("b")).alias("b"), F.when(F.col("turned"), F.reverse("path")).otherwise(F.col("path")).alias("path"))
        pieces = _cut(marked.where("j IS NULL").select("key", "a", "b", "path").union(joined))


def _as_pieces(df: DataFrame, by: list[str], key: str, path: str) -> DataFrame:
    first, last = _ends(F.col(path))
    node = lambda p: F.struct(*by, p.alias("p"))
    return df.where(F.size(path) >= 2).select(F.struct(*by, F.col(key).alias("_k")).alias("key"), node(first).alias("a"), node(last).alias("b"), F.col(path).alias("path"))


def line_merge(df: DataFrame, by: list[str], key: str, path: str) -> DataFrame:
    """(by, key, path): lines of a group sewn together at places where exactly two of them end."""
    return _sewn(_as_pieces(df, by, key, path)).select(*(F.col(f"a.{c}").alias(c) for c in by), F.col("key._k").alias(key), F.col("path").alias(path))


def _without_dangles(pieces: DataFrame) -> DataFrame:
    """Sewn pieces; those that end where nothing else does go, until there are none."""
    while True:
        pieces = _sewn(pieces)
        loose = _cut(pieces.select(F.explode(F.array("a", "b")).alias("j")).groupBy("j").count().where("count = 1").select("j"))
        if loose.isEmpty():
            return pieces
        pieces = pieces.join(loose, pieces.a == loose.j, "left_anti")
        pieces = _cut(pieces.join(loose, pieces.b == loose.j, "left_anti"))


def polygonize(df: DataFrame, by: list[str], key: str, path: str) -> DataFrame:
    """(by, key, ring): the bounded faces of lines that meet only at their ends, counter-clockwise.

    Lines that end nowhere bound no face. Holes that no line links to the outline are not cut out.
    Every line is walked both ways; after it comes the next line clockwise from the way back.
    """
    lines = _without_dangles(_as_pieces(df, by, key, path))
    forth = lines.select(F.struct("key", F.lit(0).alias("way")).alias("id"), F.struct("key", F.lit(1).alias("way")).alias("twin"), "a", "b", "path")
    back = lines.select(F.struct("key", F.lit(1).alias("way")).alias("id"), F.struct("key", F.lit(0).alias("way")).alias("twin"), F.col("b").alias("a"), F.col("a").alias("b"), F.reverse("path").alias("path"))
    p, q = F.get("path", F.lit(0)), F.get("path", F.lit(1))
    walks = forth.union(back).withColumn("angle", F.atan2(q["y"] - p["y"], q["x"] - p["x"]))
    around = Window.partitionBy("a").orderBy("angle", "id")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = walks.select(F.col("twin").alias("before"), F.coalesce(F.lag("id").over(around), F.last("id").over(whole)).alias("id"))
    walks = walks.select("id", F.struct(*(F.col(f"a.{c}").alias(c) for c in by), F.lit(0).alias("_")).alias("group"), "path").join(following, "id")
    pieces = _cut(walks.select(F.struct("id", "group").alias("key"), F.col("before").alias("a"), F.col("id").alias("b"), "path"))
    faces = _sewn(pieces).where(_signed_area(F.col("path")) > O.EPS)
    return faces.select(*(F.col(f"key.group.{c}").alias(c) for c in by), F.col("key.id.key._k").alias(key), F.col("path").alias("ring"))


def _noded(ring: Column) -> Column:
    """The segments of a ring cut where they meet: array of (a, b), a before b, each once."""
    place = lambda x, y: F.struct(F.round(x, DECIMALS).alias("x"), F.round(y, DECIMALS).alias("y"))
    numbered = F.transform(_segments(ring), lambda s, i: F.struct(s["a"].alias("a"), s["b"].alias("b"), i.alias("i")))

    def crossing(s: Column, t: Column) -> Column:
        """Of s and t, always found on s, so that both segments get the same place."""
        u, v = O._cross(t["a"], t["b"], s["a"]), O._cross(t["a"], t["b"], s["b"])
        return F.when(u != v, place(s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * u / (u - v), s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * u / (u - v)))

    def cut(s: Column, all_: Column) -> Column:
        met = F.filter(all_, lambda t: (t["i"] != s["i"]) & O._meet(s, t))
        here = F.flatten(F.transform(met, lambda t: F.array(F.when(s["i"] < t["i"], crossing(s, t)).otherwise(crossing(t, s)), *(F.when(O._cross(s["a"], s["b"], t["a"]) == O._cross(s["a"], s["b"], t["b"]), F.when(_between(s, t[k]), place(t[k]["x"], t[k]["y"]))) for k in ("a", "b")))))
        along = lambda v: (v["x"] - s["a"]["x"]) * (s["b"]["x"] - s["a"]["x"]) + (v["y"] - s["a"]["y"]) * (s["b"]["y"] - s["a"]["y"])
        stops = F.concat(F.array(place(s["a"]["x"], s["a"]["y"]), place(s["b"]["x"], s["b"]["y"])), F.filter(here, lambda v: v.isNotNull()))
        ordered = F.transform(F.array_sort(F.transform(F.array_distinct(stops), lambda v: F.struct(along(v).alias("d"), v.alias("v")))), lambda z: z["v"])
        return F.transform(_segments(ordered), lambda z: F.struct(F.least(z["a"], z["b"]).alias("a"), F.greatest(z["a"], z["b"]).alias("b")))

    return O._let(numbered, lambda all_: F.array_distinct(F.flatten(F.transform(all_, lambda s: cut(s, all_)))))


def _between(s: Column, p: Column) -> Column:
    inside = F.lit(True)
    for k in ("x", "y"):
        inside &= p[k].between(F.least(s["a"][k], s["b"][k]), F.greatest(s["a"][k], s["b"][k]))
    return inside


def make_valid(df: DataFrame, key: str, ring: str) -> DataFrame:
    """(key, ring): the simple rings that cover what a ring covers by the even-odd rule; one that covers nothing has no row.

    A ring is cut where it meets itself, and the faces inside it stay. Its pieces are walked both ways, as in ``outlines``: in one pass, without rounds.
    """
    from lodestream.operators.outlines import _rings

    lines = df.select(F.struct(F.col(key).alias("_of")).alias("g"), F.explode(_noded(F.col(ring))).alias("_s")).where("_s.a <> _s.b")
    both = lines.select("g", F.explode(F.array(F.struct("_s.a", "_s.b"), F.struct(F.col("_s.b").alias("a"), F.col("_s.a").alias("b")))).alias("_w")).select("g", "_w.a", "_w.b")
    faces = _rings(both, straighten=False, faces=True).where(_signed_area(F.col("ring")) > O.EPS).select("g._of", F.col("ring").alias("_face"))
    inside = faces.hint("merge").join(df.select(F.col(key).alias("_of"), F.col(ring).alias("_ring")).hint("merge"), "_of").where(O._let(O.point_on_surface(F.col("_face")), lambda p: covers_point(F.col("_ring"), p)))
    return inside.select(F.col("_of").alias(key), F.col("_face").alias(ring))
