"""Near-duplicates by banded MinHash with sequential Bayesian verification.

A text's set has its distinct shingles of five words. Its signature has ``BANDS`` x
``ROWS`` minima; sets that agree in all rows of a band meet in a bucket. Two sets of
similarity 0.85 miss each other in every band with a probability of
(1 - 0.85^5)^24 = 8e-7, less above.

Pairs that meet are not compared as sets at once. Their signatures are compared
``BATCH`` minima at a time: with a uniform prior, m agreeing ones of n make the
similarity a Beta(m + 1, n - m + 1) variable, and a pair goes as soon as the
probability of 0.85 or more is below ``MISS``. What is left after the last batch is
verified on the whole sets, so no link is wrong.

Equal sets are one set with several documents, before any bucket. A bucket of at
most ``BUCKET`` sets gives its pairs. A larger one links its sets to the one of the
least hash only, through the same tests; if that does not join them all, the sets of
different components are compared whole, in blocks (``jaccard.crowded_pairs``). So
no bucket emits all its pairs, and none comes to one task: sizes and least sets
are aggregated on the map side, and members join them by plain equi-joins.

Texts without words (null, empty or white space) have the empty set and are linked
with nothing. Fewer than five words are one shingle. Texts of any length are taken
whole. Repeated rows and rows of one doc_id are copies or not by their texts alone. A
null doc_id counts as larger than any other; a component of null ids only has a null
component_id, and its rows are all kept. Other columns of the input are not read,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import id_and_text, saved, slices
from lodestream.llm.jaccard import WORDS, alike, crowded_pairs, joined_components, sets_of, shingle_set

#: A similarity of 0.85, as numerator and denominator.
LEAST = (17, 20)
BANDS, ROWS = 24, 5
#: Minima compared at a time, and the posterior probability of a link below which a pair goes.
BATCH, MISS = 20, 1e-6
BUCKET = 32
_HASHES = BANDS * ROWS
_STEP = 1 << 12
_KEPT = 100_000


def _multipliers() -> np.ndarray:
    """Odd 64-bit numbers, one for each minimum."""
    return np.array([xxhash.xxh64_intdigest(k.to_bytes(2, "little"), 11) | 1 for k in range(_HASHES)], np.uint64)


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The least of the upper 32 bits of each product of a shingle hash."""
    h, out = shingles.view(np.uint64), np.full(_HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(h), _STEP):
        mixed = h[k : k + _STEP, None] * multipliers[None, :]
        np.minimum(out, (mixed >> np.uint64(32)).min(axis=0).astype(np.uint32), out=out)
    return out


def chance(agreeing: int, of: int, least: tuple[int, int] = LEAST) -> float:
    """The posterior probability that the similarity is ``least`` or more: that of Beta(agreeing + 1, of - agreeing + 1), as a binomial sum."""
    t = least[0] / least[1]
    return sum(comb(of + 1, k) * t**k * (1 - t) ** (of + 1 - k) for k in range(agreeing + 1))


def fewest(miss: float = MISS) -> list[tuple[int, int]]:
    """(minima compared, how many must agree for a pair to stay) after each batch."""
    ends = range(BATCH, _HASHES + 1, BATCH)
    return [(n, next(m for m in range(n + 1) if chance(m, n) >= miss)) for n in ends]


def likely(a: np.ndarray, b: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two matrices of signatures may be linked."""
    left, agreeing, start = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for end, least in limits:
        agreeing = agreeing + (a[left, start:end] == b[left, start:end]).sum(axis=1)
        stays = agreeing >= least
        left, agreeing, start = left[stays], agreeing[stays], end
    return left


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, id (hash of the set), n (its size), sig (its signature). No shuffle.

    Of equal sets that a task has seen lately only the first has its signature.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers()
        seen: set[int] = set()
        for batch in slices(batches):
            ids, sizes, signed = [], [], []
            for text in batch["text"].to_pylist():
                s = shingle_set(text)
                own = xxhash.xxh64_intdigest(s.tobytes())
                ids.append(own)
                sizes.append(len(s))
                signed.append(signature(s, multipliers).tobytes() if len(s) and own not in seen else None)
                if len(seen) > _KEPT:
                    seen.clear()
                seen.add(own)
            yield pa.record_batch({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "id": pa.array(np.array(ids, "<u8").view("<i8")), "n": pa.array(sizes, pa.int32()), "sig": pa.array(signed, pa.binary())})

    rows = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(work, "doc_id long, text_hash long, id long, n int, sig binary")


def candidates(sets: DataFrame, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """Pairs a, b of sets that meet in a bucket and whose sizes allow a link; and the members key, id, n of crowded buckets."""
    band = lambda k: F.xxhash64(k, F.substring("sig", k * (4 * ROWS) + 1, F.lit(4 * ROWS)))
    bands = sets.select("id", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("id", "n")).alias("first")).where("c > 1")
    members = saved(bands.join(shared, "key").select("key", "id", "n", "c", "first"), "members")
    few = members.where(F.col("c") <= bucket).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "id"))).alias("m"))  # at most ``bucket`` in a row
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.greatest(F.size("m") - i - 1, F.lit(0))), lambda y: F.struct(x["id"].alias("a"), x["n"].alias("n_a"), y["id"].alias("b"), y["n"].alias("n_b")))))
    pairs = few.select(F.inline(pairs))
    crowd = members.where(F.col("c") > bucket)
    stars = crowd.select(F.col("first.id").alias("a"), F.col("first.n").alias("n_a"), F.col("id").alias("b"), F.col("n").alias("n_b"))
    small, whole = LEAST
    met = pairs.union(stars).where((F.col("a") != F.col("b")) & (whole * F.least("n_a", "n_b") >= small * F.greatest("n_a", "n_b")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), crowd.select("key", "id", "n")


def unpruned(pairs: DataFrame, sets: DataFrame, miss: float = MISS) -> DataFrame:
    """The pairs that the batches of their signatures leave."""
    limits = fewest(miss)
    sig_a, sig_b = (sets.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}")) for c in ("a", "b"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), "<u4").reshape(-1, _HASHES) for c in ("sig_a", "sig_b"))
            stays = pa.array(likely(a, b, limits))
            yield pa.record_batch({"a": batch["a"].take(stays), "b": batch["b"].take(stays)})

    return pairs.join(sig_a, "a").join(sig_b, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(work, "a long, b long")


def _labels(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, bucket: int, miss: float) -> DataFrame:
    """node, root of the sets that are linked to others."""
    signed = rows.where("sig IS NOT NULL")
    sets = saved(signed.select("id", "n", "sig").dropDuplicates(["id"]), "sets")
    pairs, crowd = candidates(sets, bucket)
    left = saved(unpruned(pairs, sets, miss), "pairs")
    wanted = left.select(F.col("a").alias("id")).union(left.select("b")).distinct()
    found = saved(sets_of(docs, signed, wanted, id_col, text_col), "whole_sets")
    set_a, set_b = (found.select(F.col("id").alias(c), F.col("shingles").alias(f"of_{c}")) for c in ("a", "b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    links = left.join(set_a, "a").join(set_b, "b").where(alike(shared, F.size("of_a"), F.size("of_b"), LEAST)).select("a", "b")

    def across(roots: DataFrame) -> DataFrame:
        named = crowd.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("root"))
        mixed = named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
        apart = saved(crowd.join(mixed, "key"), "crowd")
        whole = saved(sets_of(docs, signed, apart.select("id").distinct(), id_col, text_col), "whole_sets")
        return crowded_pairs(apart, whole, roots, LEAST)

    return joined_components(links, across)


def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable over links of similarity 0.85 or more), kept. One row for each row of ``docs``."""
    rows = saved(signatures(docs, id_col, text_col), "signatures")
    labels = _labels(docs, rows, id_col, text_col, bucket, miss)
    of_set = rows.where("n > 0").groupBy("id").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    of_set = of_set.join(labels, F.col("id") == F.col("node"), "left").where("copies > 1 OR root IS NOT NULL").select("id", "first", F.coalesce("root", "id").alias("root"))
    of_set = saved(of_set, "groups")
    least = of_set.groupBy("root").agg(F.min("first").alias("component_id"))
    of_set = of_set.join(least, "root").select(F.col("id").alias("set"), "component_id", F.lit(True).alias("grouped"))
    out = rows.select("doc_id", "id", "n").join(of_set, (F.col("id") == F.col("set")) & (F.col("n") > 0), "left")
    own = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))
