"""Every registered kernel query against its SQL in DuckDB, and the kernels' edge cases."""

import glob
import hashlib
import hmac
import os
import uuid

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestream import queries as Q
from lodestream.operators import geo as G
from lodestream.operators import table as T

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(d):
    def cell(v):
        if pd.isna(v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iufb" else str(v)

    return sorted((tuple(cell(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_matches_sql(spark, con, name):
    assert rows(Q.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(Q.ORACLE[name]).df())


def test_hmac_and_uuid_match_the_standard_library(spark):
    df = spark.createDataFrame([("a",), ("",), ("é",)], "v string")
    for r in T.uuid_generator(T.hmac_sha256(df, ["v"], b"secret", "h"), "id", ["v"]).collect():
        assert r.h == hmac.new(b"secret", r.v.encode(), hashlib.sha256).hexdigest()
        assert r.id == str(uuid.uuid5(uuid.NAMESPACE_URL, r.v))


def test_errors_have_categories(spark):
    df = spark.createDataFrame([(1, None), (1, "x")], "a int, b string")
    for f, category in ((lambda: T.select_columns(df, ["z"]), "schema"), (lambda: T.rename(df, {"a": "b"}), "schema"), (lambda: T.assert_not_null(df, ["b"], "fail"), "data_mapping"), (lambda: T.assert_unique(df, ["a"], "fail"), "data_mapping"), (lambda: T.cross_join(df, df, 1), "resource_limit"), (lambda: T.add_row_number(df, "n", ["b"]), "plan")):
        with pytest.raises(T.KernelError) as e:
            f()
        assert e.value.category == category


def test_row_numbers_are_gap_free_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(None,), (3,), (3,), (1,), (None,)], "a int")
    assert sorted(r.n for r in T.add_row_number(df, "n", ["a"]).collect()) == [1, 2, 3, 4, 5]
    assert T.add_row_number(df.limit(0), "n", ["a"]).collect() == []


def test_null_equal_join_and_fill_forward(spark):
    a = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    assert T.join(a, a.withColumnRenamed("v", "w"), "k").count() == 1
    assert T.join(a, a.withColumnRenamed("v", "w"), "k", null_equal=True).count() == 2
    d = spark.createDataFrame([(1, None), (2, 5), (3, None)], "t int, v int").withColumn("g", F.lit(1))
    assert [r.v for r in T.fill_forward(d, "v", ["g"], ["t"]).orderBy("t").collect()] == [None, 5, 5]


def test_wkt_round_trip_and_bad_text(spark):
    df = spark.createDataFrame([("POLYGON ((0.0 0.0, 2.0 0.0, 2.0 2.0, 0.0 0.0))",), ("nonsense",), (None,)], "w string")
    got = [r.a for r in df.select(G.area(G.path_from_wkt(F.col("w"))).alias("a")).collect()]
    assert got == [2.0, None, None]


def test_fuzzy_join_finds_every_pair(spark):
    import random

    def edits(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    rnd = random.Random(1)
    left, right = ([("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9))),) for _ in range(60)] + [(None,), (w,)] for w in ("smith", "zmith"))
    a, b = spark.createDataFrame(left, "name string"), spark.createDataFrame(right, "name string")
    for d in (0, 1, 3):
        got = sorted(map(tuple, T.fuzzy_join(a, b, "name", "name", d).collect()))
        assert got == sorted((x, y, n) for x, in left for y, in right if x is not None and y is not None and (n := edits(x, y)) <= d)


def test_asof_join_directions(spark):
    left = spark.createDataFrame([(1, 10.0), (1, 20.0), (2, 5.0)], "k int, at double")
    right = spark.createDataFrame([(1, 9.0, "a"), (1, 10.0, "b"), (1, 14.0, "c"), (1, 23.0, "d")], "k int, seen double, v string")
    found = lambda **how: {(r.k, r.at): r.v for r in T.asof_join(left, right, "at", "seen", ["k"], ["v"], **how).collect()}
    assert found() == {(1, 10.0): "b", (1, 20.0): "c", (2, 5.0): None}
    assert found(direction="forward", allow_exact=False) == {(1, 10.0): "c", (1, 20.0): "d", (2, 5.0): None}
    assert found(allow_exact=False) == {(1, 10.0): "a", (1, 20.0): "c", (2, 5.0): None}
    assert found(direction="nearest") == {(1, 10.0): "b", (1, 20.0): "d", (2, 5.0): None}
    assert found(direction="nearest", tolerance=2) == {(1, 10.0): "b", (1, 20.0): None, (2, 5.0): None}
    with pytest.raises(T.KernelError):
        found(direction="sideways")


def test_lookup_takes_whole_rows(spark):
    left = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    right = spark.createDataFrame([(1, "x", 9), (1, "y", 1), (2, None, 5), (2, "z", 4)], "k int, a string, b int")
    rows_of = lambda **how: {r.k: (r.a, r.b) for r in T.lookup(left, right, "k", ["a", "b"], **how).collect()}
    assert rows_of() == {1: ("x", 9), 2: ("z", 4), 3: (None, None)}
    assert rows_of(order_by="b") == {1: ("y", 1), 2: ("z", 4), 3: (None, None)}
    assert rows_of(order_by="b", on_duplicate="last") == {1: ("x", 9), 2: (None, 5), 3: (None, None)}
    with pytest.raises(T.KernelError):
        rows_of(on_duplicate="error")
    assert T.lookup(left, right.where("b in (1, 4)"), "k", ["a"], on_duplicate="error").count() == 3
    assert T.lookup(left.withColumn("_one", F.lit(7)), right, "k", ["b"], -1, "b").where("k = 3").first().asDict() == {"k": 3, "_one": 7, "b": -1}


def test_dedup_top_n_and_working_names(spark):
    df = spark.createDataFrame([(1, 5, "a", 0), (1, 7, "b", 0), (1, None, "c", 0), (2, 3, "d", 0), (2, 3, "e", 0)], "k int, v int, t string, _rank int").withColumn("_n", F.lit(1)).withColumn("_a", F.lit(2))
    kept = lambda keep: {r.k: r.t for r in T.dedup_advanced(df, ["k"], [("v", "desc"), "t"], keep).collect()}
    assert kept("first") == {1: "b", 2: "d"} and kept("last") == {1: "c", 2: "e"}
    assert sorted(r.t for r in T.dedup_advanced(df, ["k"], ["t"], "all_flagged").where("is_duplicate").collect()) == ["b", "c", "e"]
    ranked = T.top_n(df, 1, ["v"], ties="rank")
    assert ranked.columns == df.columns and sorted(r.t for r in ranked.collect()) == ["d", "e"]
    assert sorted(r.t for r in T.top_n(df, 2, [("v", "desc")], ties="dense").collect()) == ["a", "b"]
    assert sorted(r.t for r in T.top_n(df, 4, [("v", "desc")], ties="dense").collect()) == ["a", "b", "c", "d", "e"]
    assert T.top_n(df, 0, ["v"], ties="rank").count() == 0
    assert T.top_n(df, 1, ["v"], ["k"]).columns == df.columns
    names = spark.createDataFrame([("smith", 1)], "name string, _a int")
    assert T.fuzzy_join(names, spark.createDataFrame([("smyth",)], "other string"), "name", "other", 1).columns == ["name", "_a", "other", "distance"]
    left, right = spark.createDataFrame([(1, 5.0, 3)], "k int, at double, _t int"), spark.createDataFrame([(1, 4.0, "v")], "k int, seen double, v string")
    assert T.asof_join(left, right, "at", "seen", ["k"], ["v"]).first().asDict() == {"k": 1, "at": 5.0, "_t": 3, "v": "v", "seen_matched": 4.0}


def test_text_normalize_keeps_letters(spark):
    df = spark.createDataFrame([("Café, naïve 你好! a\u0301",), (None,)], "t string")
    one = lambda *steps: T.text_normalize(df, "t", steps).first().t
    assert one("strip_punct") == "Café naïve 你好 a\u0301"
    assert one("nfc") == "Café, naïve 你好! á" and one("strip_accents") == "Cafe, naive 你好! a" and one("title").startswith("Café, Naïve")
    with pytest.raises(T.KernelError):
        one("shout")


def test_fingerprints_tell_rows_apart(spark):
    def print_of(*rows):
        return T.stable_fingerprint(spark.createDataFrame(rows, "a string, b string"), ["a", "b"]).first().fingerprint

    rows = [(None, "x"), ("\\N", "x"), ("a\x1f", "b"), ("a", "\x1fb"), ("a;string:1:b", ""), ("", None)]
    assert len({print_of(r) for r in rows}) == len(rows)
    assert print_of(*rows) == print_of(*rows[::-1])
    times = spark.sql("SELECT timestamp_millis(5) AS t")
    before = T.stable_fingerprint(times, ["t"]).first().fingerprint
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert T.stable_fingerprint(times, ["t"]).first().fingerprint == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_split_column_says_what_is_left_over(spark):
    df = spark.createDataFrame([("a,b,c",), ("a",), (None,)], "v string")
    assert [tuple(r)[1:] for r in T.split_column(df, "v", ",", ["x", "y"], extra="merge").collect()] == [("a", "b,c"), ("a", None), (None, None)]
    assert [tuple(r)[1:] for r in T.split_column(df, "v", ",", ["x", "y"], extra="drop").collect()] == [("a", "b"), ("a", None), (None, None)]
    with pytest.raises(Exception, match="more than 2 pieces"):
        T.split_column(df, "v", ",", ["x", "y"]).collect()


def test_path_from_bad_wkt_is_null(spark):
    df = spark.createDataFrame([("POINT (a b)",), ("POINT (1 2 3)",), ("POINT (1)",), ("POINT (1 2)",)], "w string")
    assert [r.p for r in df.select(G.path_from_wkt(F.col("w")).isNull().alias("p")).collect()] == [True, True, True, False]
