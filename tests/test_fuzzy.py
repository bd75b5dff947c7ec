"""Joins of like texts against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lodestream.operators import fuzzy
from lodestream.operators.table import KernelError


def jaccard(x, y):
    return len(x & y) / len(x | y) if x and y else 0.0


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.8, 1.0])
def test_similar_sets_are_those_of_all_pairs(spark, threshold):
    rnd = random.Random(3)
    vocabulary = ["the"] * 20 + [f"w{k}" for k in range(25)]  # one word that most texts have
    text = lambda: " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 9)))
    left, right = [(k, text()) for k in range(80)] + [(90, None), (91, "THE the, the"), (92, "--")], [(k, text()) for k in range(80)] + [(90, None), (91, "the"), (91, "the")]
    a, b = spark.createDataFrame(left, "k int, _a string"), spark.createDataFrame(right, "j int, other string")
    got = sorted((r.k, r.j, round(r.similarity, 9)) for r in fuzzy.similar_sets(a, b, "_a", "other", threshold).collect())
    sets = lambda rows: [(k, set((t or "").lower().replace(",", "").replace("--", "").split())) for k, t in rows]
    want = sorted((k, j, round(jaccard(x, y), 9)) for k, x in sets(left) for j, y in sets(right) if jaccard(x, y) >= threshold)
    assert got == want and any(g[:2] == (91, 91) for g in got)
    assert fuzzy.similar_sets(a, b, "_a", "other", threshold).columns == ["k", "_a", "j", "other", "similarity"]
    assert fuzzy.similar_sets(a.limit(0), b, "_a", "other", threshold).count() == 0


def test_k_likest_texts(spark):
    a = spark.createDataFrame([("a b c d",), ("a b c d",), ("x",)], "t string")
    b = spark.createDataFrame([("a b c d", 1), ("a b c", 2), ("a b d", 3), ("a b d", 4), ("a", 5)], "t string, j int")
    got = [tuple(r) for r in fuzzy.similar_sets(a, b, "t", "t", 0.1, k=2).select("j").orderBy("j").collect()]
    assert got == [(1,), (1,), (2,), (2,)]
    for bad in ({"threshold": 0}, {"threshold": 1.5}, {"threshold": 0.5, "k": 0}):
        with pytest.raises(KernelError):
            fuzzy.similar_sets(a, b, "t", "t", **bad)


def test_a_hot_token_does_not_bring_rows_together(spark):
    rows = spark.createDataFrame([(f"common word k{k} j{k} i{k}",) for k in range(300)], "t string")
    plan = fuzzy.similar_sets(rows, rows.withColumnRenamed("t", "u"), "t", "u", 0.8)
    assert plan.count() == 300
    # two in five tokens are common: under 0.8, neither is among the first two of a set
    ranked = fuzzy._sets(rows, "t", fuzzy.words).select(F.explode("set").alias("w")).groupBy("w").count().where("count > 1")
    assert {r.w for r in ranked.collect()} == {"common", "word"}


@pytest.mark.parametrize("threshold", [0.35, 0.6, 0.7, 0.9])
def test_small_and_large_sets_are_those_of_all_pairs(spark, threshold):
    """Sets of 1 to 60 tokens, near copies among them: on both sides of the size up to which sets meet on pairs of tokens."""
    rnd = random.Random(int(threshold * 100))
    texts = {k: sorted(rnd.sample(range(70), rnd.choice([1, 2, 3, 4, 5, 8, 13, 16, 17, 25, 40, 60]))) for k in range(60)}
    for k in range(60, 200):
        own = texts[rnd.randrange(k)]
        texts[k] = sorted((set(own) - set(rnd.sample(own, rnd.randrange(min(len(own), 4))))) | set(rnd.sample(range(70), rnd.randrange(4)))) or own
    rows = [(k, " ".join(f"w{v}" for v in words)) for k, words in texts.items()]
    a, b = spark.createDataFrame(rows[:140], "k int, t string"), spark.createDataFrame(rows[80:], "j int, u string")
    got = sorted((r.k, r.j, r.similarity) for r in fuzzy.similar_sets(a, b, "t", "u", threshold).collect())
    likeness = [(k, j, jaccard(set(texts[k]), set(texts[j]))) for k in range(140) for j in range(80, 200)]
    assert got == sorted(z for z in likeness if z[2] >= threshold)
    by_text = sorted({(rows[k][1], rows[j][1], s) for k, j, s in likeness if s >= threshold}, key=lambda z: (z[0], -z[2], z[1]))
    likest = [z for i, z in enumerate(by_text) if i < 2 or by_text[i - 2][0] != z[0]]
    found = fuzzy.similar_sets(a.select("t").distinct(), b.select("u").distinct(), "t", "u", threshold, k=2)
    assert sorted(map(tuple, found.select("t", "u", "similarity").collect())) == sorted(likest)


def test_numbered_names_do_not_all_meet(spark):
    """Names alike but for five digits: their first digits lead in every name and must not bring all of them together."""
    names = [f"Supplier#{k:09d}" for k in range(10000, 11500)]
    a = spark.createDataFrame([(n,) for n in names], "a string")
    found = fuzzy.similar_sets(a, a.withColumnRenamed("a", "b"), "a", "b", 0.7, tokens=fuzzy.grams(3))
    got = {(r.a, r.b): r.similarity for r in found.collect()}
    sets = [{n[i : i + 3] for i in range(len(n) - 2)} for n in names]
    assert got == {(m, n): jaccard(x, y) for m, x in zip(names, sets, strict=True) for n, y in zip(names, sets, strict=True) if jaccard(x, y) >= 0.7}

    def joined(node):
        kind = node.getClass().getSimpleName()
        below = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else [node.children().apply(k) for k in range(node.children().size())]
        own = [node.metrics().apply("numOutputRows").value()] if "Join" in kind else []
        return own + [n for child in below for n in joined(child)]

    rows = joined(found._jdf.queryExecution().executedPlan())
    assert rows and max(rows) < 400 * len(names)


def test_grams(spark):
    df = spark.createDataFrame([("abcd",), ("ab",), ("",), (None,)], "t string")
    assert [r.g for r in df.select(fuzzy.grams(3)(F.col("t")).alias("g")).collect()] == [["abc", "bcd"], ["ab"], [], []]


def test_jaro_winkler_against_duckdb_and_all_pairs(spark):
    import duckdb

    rnd = random.Random(8)
    names = sorted({"".join(rnd.choice("aabcé") for _ in range(rnd.randint(1, 9))) for _ in range(90)}) + ["martha", "marhta", "dwayne", "duane", "dixon", "dicksonx"]
    assert fuzzy.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and fuzzy.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    plain = [n for n in names if n.isascii()]
    for x in plain:
        want = duckdb.sql(f"SELECT jaro_winkler_similarity('{x}', n) FROM (SELECT unnest({plain}) AS n)").fetchall()
        assert [fuzzy.jaro_winkler(x, y) for y in plain] == pytest.approx([w for (w,) in want], abs=1e-9)
    a = spark.createDataFrame([(n,) for n in names] + [(None,), ("",)], "a string")
    got = {tuple(r)[:2] for r in fuzzy.jaro_winkler_join(a, a.withColumnRenamed("a", "b"), "a", "b", 0.8, lambda v: F.lit(1)).collect()}
    assert got == {(x, y) for x in [*names, ""] for y in [*names, ""] if fuzzy.jaro_winkler(x, y) >= 0.8}
    by_letters = {tuple(r)[:2] for r in fuzzy.jaro_winkler_join(a, a.withColumnRenamed("a", "b"), "a", "b", 0.8, fuzzy.grams(2)).collect()}
    assert by_letters <= got and ("martha", "marhta") in by_letters
    with pytest.raises(KernelError):
        fuzzy.jaro_winkler_join(a, a, "a", "a", 0.5, lambda v: v)
