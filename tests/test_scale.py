"""What the kernels must not do on large tables: broadcast rows of cells, make pairs of crowded places, work in one task."""

import pytest
from pyspark.sql import functions as F

from lodestream import queries as Q
from lodestream.operators import coverage as V
from lodestream.operators import geo as G
from lodestream.operators import linework as L
from lodestream.operators import neighbours as N
from lodestream.operators import overlay as O
from lodestream.operators import shapes as P
from lodestream.operators import spatial as S

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def sides(spark):
    a = spark.range(20).select("id", G.rectangle(F.col("id"), F.lit(0), F.col("id") + 1.5, F.lit(2)).alias("ring"))
    p = spark.range(40).select(F.col("id").alias("k"), G.point(F.col("id") / 2, F.lit(1)).alias("p"))
    return a, p


def test_points_in_polygons_are_not_broadcast(sides):
    a, p = sides
    assert "Broadcast" not in plan(G.sjoin_points(a, p, "ring", "p", 2.0))
    assert "Broadcast" not in plan(G.count_points_in_polygons(a, p, "id", "ring", "p", 2.0))
    left = G.sjoin_points(a, p, "ring", "p", 2.0, how="left")
    assert "Broadcast" not in plan(left) and "LeftSemi" in plan(left)
    want = {(i, k) for i in range(20) for k in range(40) if i <= k / 2 <= i + 1.5}
    assert {(r.id, r.k) for r in left.collect()} == want
    assert {r.id: r.n for r in G.count_points_in_polygons(a, p.union(p), "id", "ring", "p", 2.0).collect()} == {i: 2 * sum(j == i for j, _ in want) for i in range(20)}


def test_joins_of_shapes_are_not_broadcast(sides):
    a, _ = sides
    b = a.select(F.col("id").alias("j"), F.col("ring").alias("other"))
    for how in ("inner", "left", "semi", "anti"):
        assert "Broadcast" not in plan(N.sjoin(a, b, "ring", "other", 2.0, within=0.25, how=how, key="id"))
    assert "Broadcast" not in plan(S.sjoin(a, b, "ring", "other", 2.0))


def test_coverages_are_not_broadcast(sides):
    shapes = sides[0].select("id", P.polygon_shape(F.col("ring")).alias("shape"))
    assert "Broadcast" not in plan(V.overlaps(shapes, "id", "shape", 2.0))
    assert "Broadcast" not in plan(V.unmatched(shapes, "id", "shape", 2.0))
    cut = L._cut(shapes)
    assert "Broadcast" not in plan(cut.join(cut.groupBy("id").count(), "id"))


def test_boxes_agree_with_the_general_kernels(sides):
    """A box with one more point on its outline is no ``is_box``; area and distance stay."""
    a, _ = sides
    more = lambda r: F.concat(F.slice(r, 1, 1), F.array(G.point((F.get(r, 0)["x"] + F.get(r, 1)["x"]) / 2, F.get(r, 0)["y"])), F.slice(r, 2, 4))
    pairs = a.crossJoin(a.select(F.col("id").alias("j"), G.translate(F.reverse("ring"), 0.25, 0.5).alias("other"))).where("id < 6 AND j < 6")
    r, q = F.col("ring"), F.col("other")
    assert pairs.select(G.is_box(r) & G.is_box(q) & ~G.is_box(more(r)) & ~G.is_box(F.lit(None).cast(G.PATH))).distinct().collect() == [(True,)]
    for of in (O.common_area, N.shape_distance):
        for x in pairs.select(of(r, q), of(more(r), more(q))).collect():
            assert x[0] == pytest.approx(x[1], abs=1e-9)


def test_nearest_within_makes_no_pairs_of_crowded_places(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("all pairs within the distance")

    monkeypatch.setattr(G, "within_distance", refuse)
    a = spark.createDataFrame([(i, float(i % 5), 0.0) for i in range(50)] + [(99, 500.0, 0.0), (100, None, None)], "k long, x double, y double").select("k", G.point("x", "y").alias("p"))
    b = spark.createDataFrame([(j, float(j % 7), 1.0) for j in range(70)], "j long, x double, y double").select("j", G.point("x", "y").alias("q"))
    for k in (1, 3):
        got = sorted((r.k, r.j, round(r.distance, 9)) for r in G.nearest(a, b, "k", "j", "p", "q", 2.0, k).collect())
        want = sorted((i, j, round(d, 9)) for i in range(50) for d, j in sorted((((i % 5 - j % 7) ** 2 + 1) ** 0.5, j) for j in range(70))[:k])
        assert got == want


def test_make_valid_takes_no_rounds(spark, monkeypatch):
    """Two loops that a way there and back links, one inside the other and touching it, and a spike."""
    def refuse(*_):
        raise AssertionError("sewn in rounds")

    monkeypatch.setattr(L, "_sewn", refuse)
    inside = "0 0, 8 0, 8 8, 0 8, 0 0, 2 2, 2 4, 4 4, 4 2, 2 2, 0 0"
    touching = "0 0, 8 0, 8 8, 0 8, 0 0, 4 2, 4 4, 2 4, 0 0"
    spike = "0 0, 4 0, 6 0, 4 0, 4 4, 0 4, 0 0"
    at_start = "6 2, 4 2, 4 4, 0 4, 0 0, 4 0, 4 2, 6 2"
    df = spark.createDataFrame([(1, inside), (2, touching), (3, spike), (4, at_start), (5, "0 0, 2 2, 2 0, 0 2, 0 0"), (6, "0 0, 1 1, 0 0, 0 0")], "k int, w string")
    df = df.select("k", G.path_from_wkt(F.concat(F.lit("POLYGON (("), "w", F.lit("))"))).alias("ring"))
    got = {r.k: (r.n, round(r.area, 6)) for r in L.make_valid(df, "k", "ring").groupBy("k").agg(F.count("*").alias("n"), F.sum(G.area(F.col("ring"))).alias("area")).collect()}
    assert got == {1: (1, 60.0), 2: (1, 56.0), 3: (1, 16.0), 4: (1, 16.0), 5: (2, 2.0)}


def test_nearest_names_count_once(spark, tmp_path):
    t = spark.read.parquet(f"{SF}/supplier.parquet")
    t.union(t.withColumn("s_suppkey", F.col("s_suppkey") + 1000)).write.parquet(str(tmp_path / "supplier.parquet"))
    name = "table_fuzzy_join_nearest_grams"
    assert sorted(Q.QUERIES[name](spark, str(tmp_path)).collect()) == sorted(Q.QUERIES[name](spark, SF).collect())


def test_small_files_are_dealt_to_all_cores(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    for df in (Q._rects(read("part")), Q._flawed(read), Q._shapes6(read)):
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_boxes_of_a_join_are_compared_by_numbers(sides, monkeypatch):
    """Their distance comes from their bounds, found once for each row; the general kernel is for other shapes."""
    monkeypatch.setattr(N, "shape_distance", lambda *_: F.raise_error(F.lit("general")).cast("double"))
    a, _ = sides
    b = a.select(F.col("id").alias("j"), G.translate("ring", 0.25, 2.5).alias("other"))
    want = {(i, j): max(j + 0.25 - i - 1.5, i - j - 1.75, 0.0) for i in range(20) for j in range(20)}
    want = {k: (gap * gap + 0.25) ** 0.5 for k, gap in want.items() if gap * gap + 0.25 <= 1.0}
    got = {(r.id, r.j): r.distance for r in N.sjoin(a, b, "ring", "other", 2.0, within=1.0).collect()}
    assert got == pytest.approx(want)
    assert N.sjoin(a, b, "ring", "other", 2.0, within=1.0, how="anti", key="id").count() == 0
    assert N.sjoin(a, b, "ring", "other", 2.0, within=1.0, how="semi", key="id").count() == 20


def test_boxes_of_a_coverage_are_compared_by_numbers(spark, monkeypatch):
    monkeypatch.setattr(O, "common_area", lambda *_: F.raise_error(F.lit("general")).cast("double"))
    boxes = spark.range(60).select("id", G.rectangle(F.col("id") % 8, F.col("id") % 5, F.col("id") % 8 + 1 + F.col("id") % 3, F.col("id") % 5 + 2).alias("ring"))
    span = {k: (k % 8, k % 8 + 1 + k % 3, k % 5, k % 5 + 2) for k in range(60)}
    shared = lambda p, q: max(min(p[1], q[1]) - max(p[0], q[0]), 0) * max(min(p[3], q[3]) - max(p[2], q[2]), 0)
    want = {(i, j): float(shared(span[i], span[j])) for i in span for j in span if i < j and shared(span[i], span[j])}
    for size in (1.5, 20.0):
        rows = S.coverage_validate(boxes, "id", "ring", size).collect()
        assert len(rows) == len(want) and {(r.id, r.other): r.common for r in rows} == want


def test_a_coverage_of_all_kinds_of_rings_agrees_with_all_pairs(spark):
    """Boxes both ways round and without area, Ls, diamonds, nothing; names as keys, one of them null."""
    x, y, k = F.col("id") * 7 % 11 - 5.0, F.col("id") * 3 % 7 - 3.0, F.col("id")
    ring = lambda *ps: F.array(*(G.point(x + u, y + v) for u, v in ps))
    box, ell, diamond = ring((0, 0), (3, 0), (3, 2), (0, 2), (0, 0)), ring((0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3), (0, 0)), ring((1, 0), (2, 1), (1, 2), (0, 1), (1, 0))
    shape = F.when(k % 6 < 2, box).when(k % 6 == 2, F.reverse(box)).when(k % 6 == 3, ell).when(k % 6 == 4, diamond).when(k % 12 == 5, ring((0, 0), (3, 0), (3, 0), (0, 0), (0, 0)))
    df = spark.range(72).select(F.when(k != 40, F.concat(F.lit("k"), k)).alias("name"), shape.alias("ring")).cache()
    pairs = df.alias("a").crossJoin(df.alias("b")).where("a.name < b.name").select(F.col("a.name"), F.col("b.name").alias("other"), O.common_area(F.col("a.ring"), F.col("b.ring")).alias("common"))
    want = {(r.name, r.other): r.common for r in pairs.where(F.col("common") > O.EPS).collect()}
    for size in (2.0, 9.0):
        rows = S.coverage_validate(df, "name", "ring", size).collect()
        assert len(rows) == len(want) and {(r.name, r.other): r.common for r in rows} == pytest.approx(want)


def test_common_area_cuts_no_shapes(spark, monkeypatch):
    """An L, a slanting ring and a ring that crosses itself: edges are compared with edges, without clipping."""
    def refuse(*_):
        raise AssertionError("clipped")

    monkeypatch.setattr(O, "_left", refuse)
    ring = lambda w: G.path_from_wkt(F.lit(f"POLYGON (({w}))"))
    ell, diamond, bow = ring("0 0, 4 0, 4 2, 2 2, 2 4, 0 4, 0 0"), ring("2 0, 4 2, 2 4, 0 2, 2 0"), ring("0 0, 4 4, 4 0, 0 4, 0 0")
    pairs = [(ell, diamond, 6.0), (F.reverse(ell), diamond, -6.0), (ell, ell, 12.0), (diamond, G.translate(diamond, 2.0, 0.0), 2.0), (ell, G.translate(ell, 4.0, 0.0), 0.0), (bow, bow, 8.0), (ring("0 0, 4 0, 0 0"), ell, 0.0)]
    got = spark.range(1).select(*(O.common_area(a, b) for a, b, _ in pairs)).first()
    assert list(got) == pytest.approx([x for *_, x in pairs], abs=1e-12)


def test_cutting_finds_the_side_of_a_point_once(spark, monkeypatch):
    found, cross = [], O._cross
    monkeypatch.setattr(O, "_cross", lambda *z: found.append(1) or cross(*z))
    ring = lambda w: G.path_from_wkt(F.lit(f"POLYGON (({w}))"))
    left = O._without(ring("0 0, 4 0, 4 4, 0 4, 0 0"), ring("1 1, 3 1, 2 3, 1 1"))
    assert len(found) == 1
    assert spark.range(1).select(O.areas(left)).first()[0] == pytest.approx(14.0)
