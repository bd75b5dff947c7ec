"""Joins of like texts by their sets of tokens, and by Jaro and Winkler's measure.

Sets: two sets of n and m tokens have Jaccard similarity t or more where they share at least
o = ceil(t (n + m) / (1 + t)) tokens, so in any one order their first l common tokens are among
the first n - o + l of the one and m - o + l of the other. The larger of two sets knows only that
o is at least t n, the smaller one that it is at least 2 t m / (1 + t): each set has keys for
both parts. With the rarest tokens first (counted over the different sets of both sides), sets meet
on rare tokens only; a token of a third of all rows comes last, and leads only where a set has
nothing rarer. Small sets meet on pairs of tokens (l = 2) that bring their sets along, so only pairs
that the similarity needs are written; others on single tokens, and are verified after the join. Sets whose sizes
alone forbid the similarity do not meet. Each different set is compared once,
and the rows are joined to the result, so copies cost nothing before that.

Null texts and texts without a token match nothing. Working names never clash with
columns; columns that both sides have are both in the result, as in Spark's joins.
"""

from __future__ import annotations

from math import ceil, comb, floor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestream.operators.table import KernelError, _free

#: Tokens that all pairs of one set bring along, at most; sets too large for that meet on single tokens.
CARRIED = 640


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def grams(size: int):
    """Tokens of ``size`` letters each, from each place; a shorter text is one token."""

    def of(text: Column) -> Column:
        n = F.length(text)
        each = F.transform(F.sequence(F.lit(1), n - size + 1), lambda k: F.substring(text, k, F.lit(size)))
        return F.when(n >= size, each).when(n > 0, F.array(text)).otherwise(F.array().cast("array<string>"))

    return of


def _sets(df: DataFrame, column: str, tokens) -> DataFrame:
    """value, id, size: each different text and 128 bits that stand for its set (``set``)."""
    found = df.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").distinct()
    found = found.withColumn("set", F.array_sort(F.array_distinct(F.array_compact(tokens(F.col("value")))))).where(F.size("set") > 0)
    length_first = F.array_join(F.transform("set", lambda w: F.concat(F.length(w).cast("string"), F.lit(":"), w)), "")
    return found.withColumn("id", F.unhex(F.md5(length_first)))


def similar_sets(df: DataFrame, right: DataFrame, left_on: str, right_on: str, threshold: float, tokens=words, k: int | None = None) -> DataFrame:
    """All pairs of rows whose token sets have a Jaccard similarity of ``threshold`` (above 0, at most 1) or more, with ``similarity``.

    ``k``: only the rows with the k likest right texts of each left text (ties: the lesser text; a text that several
    right rows have counts once, and all of them come).
    """
    if not 0 < threshold <= 1:
        raise KernelError("plan", f"a threshold above 0 and at most 1, not {threshold}")
    if k is not None and k < 1:
        raise KernelError("plan", f"k of at least 1, not {k}")
    lefts, rights = _sets(df, left_on, tokens), _sets(right, right_on, tokens)
    left_sets, right_sets = (side.select("id", "set").dropDuplicates(["id"]) for side in (lefts, rights))
    each = left_sets.unionByName(right_sets).select(F.explode("set").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("often"))
    met = _like_sets(_ordered(left_sets, often), _ordered(right_sets, often), threshold)
    if k is not None:  # ties stay: which of their texts come first is seen once the texts are joined
        met = met.withColumn("rank", F.rank().over(Window.partitionBy("id_a").orderBy(F.col("similarity").desc()))).where(F.col("rank") <= k).drop("rank")
    pairs = met.join(lefts.select(F.col("id").alias("id_a"), F.col("value").alias("a")), "id_a").join(rights.select(F.col("id").alias("id_b"), F.col("value").alias("b")), "id_b")
    return _rows(df, right, left_on, right_on, pairs.select("a", "b", "similarity"), k)


def _ordered(side: DataFrame, often: DataFrame) -> DataFrame:
    """id, set, n: the sets with their rarest tokens first."""
    ranked = side.select("id", F.explode("set").alias("token")).join(often, "token")
    found = ranked.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("set"))
    return found.select("id", F.transform("set", lambda z: z["token"]).alias("set"), F.size("set").alias("n"))


def _paired(threshold: float) -> tuple[int, int]:
    """The least and the most tokens of the smaller of two sets that meet on pairs of tokens; none where the least is more."""
    def carried(n: int) -> int:
        larger = floor(n / threshold + 1e-9)
        return comb(larger - ceil(threshold * larger - 1e-9) + 2, 2) * larger

    least = next(n for n in range(1, ceil(2 / threshold) + 2) if ceil(2 * threshold / (1 + threshold) * n - 1e-9) >= 2)
    return least, max((n for n in range(1, CARRIED + 1) if carried(n) <= CARRIED), default=0)


def _like_sets(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """id_a, id_b, similarity: the pairs of ordered sets that are like enough, each once."""
    least, most = _paired(threshold)
    pairs = lambda p: F.flatten(F.transform(p, lambda x, i: F.transform(F.slice(p, i + 2, F.size(p)), lambda y, j: F.struct(x.alias("u"), y.alias("v"), (i + j + 2).alias("rank")))))
    singles = lambda p: F.transform(p, lambda x, i: F.struct(x.alias("u"), F.lit("").alias("v"), (i + 1).alias("rank")))

    def keyed(side: DataFrame, name: str, other: str, tokens: int) -> DataFrame:
        """Keys of each set where it is the larger one (or, on the left, of equal size) and where it is the smaller one."""
        n, keys = F.col("n"), pairs if tokens == 2 else singles
        as_larger, as_smaller = F.ceil(threshold * n - 1e-9), F.ceil(2 * threshold / (1 + threshold) * n - 1e-9)
        if tokens == 2:
            may_be_larger, may_be_smaller = (n >= least) & (as_larger <= most), n.between(least, most)
        else:
            may_be_larger, may_be_smaller = (as_larger < least) | (n > most) | F.lit(least > most), ~n.between(least, most)
        of = lambda may, shared, larger: F.when(may, F.transform(keys(F.slice("set", F.lit(1), (n - shared + tokens).cast("int"))), lambda z: F.struct(F.lit(larger).alias("larger"), z.alias("key"))))
        none = F.array().cast("array<struct<larger:string,key:struct<u:string,v:string,rank:int>>>")
        both = F.concat(F.coalesce(of(may_be_larger, as_larger, name), none), F.coalesce(of(may_be_smaller, as_smaller, other), none))
        found = side.select("id", "n", "set", F.explode(both).alias("z"))
        brought = [F.col("set").alias(f"set_{name}")] if tokens == 2 else []
        return found.select("z.larger", "z.key.u", "z.key.v", F.col("z.key.rank").alias(f"rank_{name}"), F.col("id").alias(f"id_{name}"), F.col("n").alias(f"n_{name}"), *brought)

    def meeting(tokens: int) -> DataFrame:
        a, b = keyed(left, "a", "b", tokens), keyed(right, "b", "a", tokens)
        n_a, n_b = F.col("n_a"), F.col("n_b")
        shared = F.ceil(threshold / (1 + threshold) * (n_a + n_b) - 1e-9)
        own = F.least(n_a, n_b).between(least, most)
        fits = ((F.col("larger") == "a") == (n_a >= n_b)) & (own if tokens == 2 else ~own) & (n_a >= threshold * n_b - 1e-9) & (n_b >= threshold * n_a - 1e-9)
        # what the files hold says nothing of the keys, so none of them are broadcast
        return a.hint("merge").join(b.hint("merge"), ["larger", "u", "v"]).where(fits & (F.col("rank_a") <= n_a - shared + tokens) & (F.col("rank_b") <= n_b - shared + tokens))

    sets = lambda side, name: side.select(F.col("id").alias(f"id_{name}"), F.col("set").alias(f"set_{name}"), F.col("n").alias(f"n_{name}"))
    common = F.size("common")
    similarity = (common / (F.col("n_a") + F.col("n_b") - common)).alias("similarity")
    # exploded, so that what is asked of the common tokens finds them once
    shared = F.explode(F.array(F.array_intersect("set_a", "set_b"))).alias("common")
    met = meeting(1).select("id_a", "id_b").distinct().join(sets(left, "a"), "id_a").join(sets(right, "b"), "id_b").select("id_a", "id_b", "n_a", "n_b", shared)
    if least <= most:
        # a pair counts where it meets on its first two common tokens, so nothing has to be made distinct
        by_two = meeting(2).select("id_a", "id_b", "n_a", "n_b", "u", "v", shared)
        met = met.unionByName(by_two.where((F.get("common", F.lit(0)) == F.col("u")) & (F.get("common", F.lit(1)) == F.col("v"))).drop("u", "v"))
    return met.select("id_a", "id_b", similarity).where(F.col("similarity") >= threshold)


def _rows(df: DataFrame, right: DataFrame, left_on: str, right_on: str, pairs: DataFrame, k: int | None) -> DataFrame:
    """The rows of both sides for ``pairs`` of texts (a, b, similarity)."""
    if k is not None:
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.col("similarity").desc(), "b"))
        pairs = pairs.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    a, b = map(_free(df, right), ("_a", "_b"))
    pairs = pairs.select(F.col("a").alias(a), F.col("b").alias(b), "similarity")
    found = right.withColumn(b, F.col(right_on).cast("string")).join(pairs, b)
    return df.withColumn(a, F.col(left_on).cast("string")).join(found, a).drop(a, b)


def jaro_winkler(one: str, two: str) -> float:
    """Jaro's similarity, raised by a tenth of the rest for each of up to four equal first letters where it is above 0.7."""
    if not one or not two:
        return float(one == two)
    reach, taken, own = max(max(len(one), len(two)) // 2 - 1, 0), [False] * len(two), []
    for k, letter in enumerate(one):
        for j in range(max(0, k - reach), min(len(two), k + reach + 1)):
            if not taken[j] and two[j] == letter:
                taken[j] = True
                own.append(letter)
                break
    if not own:
        return 0.0
    swapped = sum(x != y for x, y in zip(own, (c for c, t in zip(two, taken, strict=True) if t), strict=True)) // 2
    m = len(own)
    jaro = (m / len(one) + m / len(two) + (m - swapped) / m) / 3
    alike = next((k for k, (x, y) in enumerate(zip(one[:4], two[:4], strict=False)) if x != y), min(4, len(one), len(two)))
    return jaro + (alike * 0.1 * (1 - jaro) if jaro > 0.7 else 0.0)


@F.pandas_udf(DoubleType())
def _jaro_winkler(one: pd.Series, two: pd.Series) -> pd.Series:
    return pd.Series(np.array([jaro_winkler(x, y) for x, y in zip(one, two, strict=True)], float))


def jaro_winkler_join(df: DataFrame, right: DataFrame, left_on: str, right_on: str, threshold: float, block, k: int | None = None) -> DataFrame:
    """Pairs of rows of one block with a Jaro-Winkler similarity of ``threshold`` or more, with ``similarity``; ``k`` as in ``similar_sets``.

    ``block``: a function of the text's column that gives the block, or an array of blocks of which one must be common.
    Only pairs of one block are compared: within it, those of which letters and lengths alone do not forbid the
    similarity. Texts whose block is null match nothing. Spark has no such measure, so a Pandas UDF verifies.
    """
    if not 0.7 < threshold <= 1:
        raise KernelError("plan", f"a threshold above 0.7 and at most 1, not {threshold}")

    def side(frame: DataFrame, column: str, name: str) -> DataFrame:
        found = frame.select(F.col(column).cast("string").alias(name)).where(F.col(name).isNotNull()).distinct()
        keys = found.withColumn("block", block(F.col(name)))
        if keys.schema["block"].dataType.typeName() == "array":
            keys = keys.withColumn("block", F.explode(F.array_distinct("block")))
        return keys

    lefts, rights = side(df, left_on, "a"), side(right, right_on, "b")
    # four equal first letters raise j to j + 0.4 (1 - j) at most; the letters matched are at most those of the shorter text
    least = (threshold - 0.4) / 0.6
    short, long = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
    fits = (F.col("a") == F.col("b")) | (short / F.greatest(long, F.lit(1)) + 2 >= 3 * least - 1e-9)
    met = lefts.join(rights, "block").where(fits).select("a", "b").distinct()
    pairs = met.withColumn("similarity", _jaro_winkler("a", "b")).where(F.col("similarity") >= threshold)
    return _rows(df, right, left_on, right_on, pairs, k)
