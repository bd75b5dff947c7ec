"""Shapes with holes, parts, Z and M: text both ways, reasons for bad text, measures against plain arithmetic."""

import random

import pytest
from pyspark.sql import functions as F

from lodestream.operators import geo as G
from lodestream.operators import shapes as S

GOOD = [
    "POINT (1 2)", "POINT Z (1 2 3)", "POINT M (1 2 3)", "POINT ZM (1 2 3 4)", "POINT EMPTY", "POINT Z EMPTY", "LINESTRING (0 0, 1 1.5, -2 3)", "LINESTRING EMPTY",
    "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0))", "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 2 1, 2 2, 1 1), (4 4, 5 4, 5 5, 4 4))", "POLYGON EMPTY", "MULTIPOINT ((1 2), (3 4))", "MULTIPOINT (EMPTY, (3 4))", "MULTIPOINT EMPTY",
    "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3, 4 4))", "MULTILINESTRING (EMPTY, (2 2, 3 3))", "MULTILINESTRING EMPTY", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 9 5, 9 9, 5 5), (6 5.5, 7 5.5, 7 6, 6 5.5)))", "MULTIPOLYGON (EMPTY, ((0 0, 1 0, 1 1, 0 0)))", "MULTIPOLYGON EMPTY",
    "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1), MULTIPOINT ((1 1), (2 2)))", "GEOMETRYCOLLECTION (POINT EMPTY, POLYGON ((0 0, 1 0, 1 1, 0 0)))", "GEOMETRYCOLLECTION EMPTY", "MULTIPOINT Z ((1 2 3), (4 5 6))", "LINESTRING (10000000.25 2, 3.5E-7 4)",
]
SAME = {
    "  point(1.0 2.50)": "POINT (1 2.5)", "Point(+1 .5)": "POINT (1 0.5)", "POINT(1 2 3)": "POINT Z (1 2 3)", "LineString ( 0 0 ,1\t1 )": "LINESTRING (0 0, 1 1)", "MULTIPOINT (1 2, 3 4)": "MULTIPOINT ((1 2), (3 4))", "POINTZ(1 2 3)": "POINT Z (1 2 3)",
    "GEOMETRYCOLLECTION(POINT(1 2),POINT(3 4))": "GEOMETRYCOLLECTION (POINT (1 2), POINT (3 4))", "MULTIPOINT (1 2)": "MULTIPOINT ((1 2))", "polygon((0 0,1 0,\n1 1,0 0))": "POLYGON ((0 0, 1 0, 1 1, 0 0))", "POINT (-0 0)": "POINT (0 0)", "POINT (1E10 12345678.5)": "POINT (10000000000 12345678.5)",
}
BAD = {
    "": "unknown kind", "nonsense": "unknown kind", "CIRCLE (1 2)": "unknown kind", "POINT": "unknown kind", "POINT (1 2": "unknown kind", "POINT (a b)": "bad numbers", "POINT (1 NAN)": "bad numbers", "POINT (1 1E999)": "bad numbers", "POINT (1D 2)": "bad numbers", "POINT (1 2, 3 4)": "not one point",
    "POINT (1)": "mixed dimensions", "POINT (1 2 3 4 5)": "mixed dimensions", "POINT ()": "not one point", "POINT Z (1 2)": "mixed dimensions", "LINESTRING (0 0)": "too few points", "LINESTRING (0 0, 1 1 1)": "mixed dimensions", "POLYGON ((0 0, 1 0, 0 0))": "too few points", "POLYGON ((0 0, 1 0, 1 1, 0 1))": "ring not closed",
    "POLYGON (0 0, 1 0, 1 1, 0 0)": "bad nesting", "POLYGON ((0 0, 1 0, 1 1, 0 0)": "bad nesting", "POLYGON ((0 0, 1 0, 1 1, 0 0)))": "bad nesting", "LINESTRING (0 0, 1 1,)": "bad nesting", "LINESTRING (0 0,, 1 1)": "bad nesting", "LINESTRING (0 0, 1 1)(2 2, 3 3)": "bad nesting", "POINT ((1 2))": "bad numbers",
    "GEOMETRYCOLLECTION (POINT (1 2), GEOMETRYCOLLECTION (POINT (1 2)))": "nested collection", "GEOMETRYCOLLECTION (POINT (1 2), POINT Z (1 2 3))": "mixed dimensions", "GEOMETRYCOLLECTION (1 2)": "unknown kind", "GEOMETRYCOLLECTION (POINT (1 2)": "unknown kind",
}


def read(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", S.read_wkt(F.col("t")).alias("r"))
    return [(r.text, r.reason) for r in df.select("k", S.to_wkt(F.col("r.shape")).alias("text"), "r.reason").orderBy("k").collect()]


def test_text_round_trip(spark):
    assert read(spark, GOOD) == [(t, None) for t in GOOD]
    assert read(spark, [*SAME]) == [(t, None) for t in SAME.values()]
    assert read(spark, [None]) == [(None, None)]


def test_bad_text_has_a_reason(spark):
    got = dict(zip(BAD, read(spark, [*BAD]), strict=True))
    assert {t: r for t, (_, r) in got.items() if r is None} == {} and all(text is None for text, _ in got.values())
    assert {t: r for t, (_, r) in got.items() if r != BAD[t]} == {}


def test_broken_texts_never_pass(spark):
    """One character taken out of, or put into, a good text: what is still read is written back with the same numbers."""
    rnd = random.Random(3)
    texts = []
    for _ in range(600):
        t = rnd.choice(GOOD)
        k = rnd.randrange(len(t))
        texts.append(t[:k] + rnd.choice(["", "(", ")", ",", " ", "1", "x", "["]) + t[k + rnd.randint(0, 1) :])
    import re

    numbers = lambda t: [float(x) for x in re.findall(r"[-+]?[0-9.]+(?:[Ee][-+]?[0-9]+)?", t)]
    for t, (text, reason) in zip(texts, read(spark, texts), strict=True):
        assert (text is None) == (reason is not None), t
        if text is not None:
            assert numbers(text) == numbers(t) and t.count("(") == t.count(")"), (t, text)


def test_long_text(spark):
    ring = ", ".join(f"{k} {k * k}" for k in range(60_000))
    text = f"POLYGON (({ring}, 0 0))"
    assert read(spark, [text]) == [(text, None)]


@pytest.fixture(scope="module")
def some(spark):
    df = spark.createDataFrame(list(enumerate(GOOD)), "k int, t string").select("k", "t", S.from_wkt(F.col("t")).alias("s"))
    return df.cache()


def test_measures_and_accessors(spark, some):
    a = S.accessors(F.col("s"))
    got = {r.t: r for r in some.select("t", a.alias("a"), S.area(F.col("s")).alias("area"), S.perimeter(F.col("s")).alias("perimeter"), S.length(F.col("s")).alias("length"), S.to_wkt(S.boundary(F.col("s"))).alias("b")).collect()}
    holed, two = got[GOOD[9]], got[GOOD[17]]
    assert (holed.area, holed.a.num_holes, holed.a.num_points, holed.a.num_parts, holed.a.dim) == (80.0, 2, 13, 1, 2)
    assert holed.perimeter == pytest.approx(36 + 2 * (2 + 2**0.5)) and holed.length == 0
    assert holed.b == "MULTILINESTRING ((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 2 1, 2 2, 1 1), (4 4, 5 4, 5 5, 4 4))"
    assert (two.area, two.a.num_parts, two.a.num_holes) == (0.5 + 8 - 0.25, 2, 1)
    line, both = got["LINESTRING (0 0, 1 1.5, -2 3)"], got["MULTILINESTRING ((0 0, 1 1), (2 2, 3 3, 4 4))"]
    assert line.length == pytest.approx(3.25**0.5 + 11.25**0.5) and line.b == "MULTIPOINT ((0 0), (-2 3))" and line.a.is_closed is False and line.a.start.y == 0
    assert both.b == "MULTIPOINT ((0 0), (1 1), (2 2), (4 4))" and got["POINT (1 2)"].b == "GEOMETRYCOLLECTION EMPTY"
    assert (got["POINT Z (1 2 3)"].a.z, got["POINT EMPTY"].a.x, got["POINT EMPTY"].a.is_empty, got["GEOMETRYCOLLECTION EMPTY"].a.dim) == (3.0, None, True, None)
    assert got[GOOD[20]].a.dim == 1 and got[GOOD[20]].a.num_parts == 4


def test_parts_and_collections(spark, some):
    rows = S.explode_parts(some, "s", "part", "at").select("t", "at", S.to_wkt(F.col("part")).alias("p")).collect()
    of = {}
    for r in sorted(rows, key=lambda r: r.at):
        of.setdefault(r.t, []).append(r.p)
    assert of[GOOD[20]] == ["POINT (1 2)", "LINESTRING (0 0, 1 1)", "POINT (1 1)", "POINT (2 2)"] and of["MULTIPOINT (EMPTY, (3 4))"] == ["POINT (3 4)"] and "POINT EMPTY" not in of
    assert S.explode_parts(some, "s", outer=True).count() == len(rows) + len(GOOD) - len(of)
    again = S.collected(S.explode_parts(some, "s").select("k", "t", "part"), ["t"], "part").select("t", S.to_wkt(F.col("shape")).alias("w")).collect()
    got = {r.t: r.w for r in again}
    for t in (GOOD[11], GOOD[14], GOOD[17]):
        assert got[t] == t
    assert got["POINT (1 2)"] == "MULTIPOINT ((1 2))" and got[GOOD[20]].startswith("GEOMETRYCOLLECTION (LINESTRING (0 0, 1 1), POINT")


def test_contains_point_with_holes(spark):
    shape = S.from_wkt(F.lit("MULTIPOLYGON (((0 0, 9 0, 9 9, 0 9, 0 0), (2 2, 6 2, 6 6, 2 6, 2 2)), ((3 3, 5 3, 5 5, 3 5, 3 3)))"))
    df = spark.createDataFrame([(1.0, 1.0), (4.0, 4.0), (2.5, 2.5), (2.0, 3.0), (0.0, 4.0), (10.0, 1.0), (3.0, 3.0)], "x double, y double")
    p = G.point("x", "y")
    got = df.select(S.contains_point(shape, p).alias("a"), S.contains_point(shape, p, on_boundary=False).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(True, True), (True, True), (False, False), (True, False), (True, False), (False, False), (True, False)]
