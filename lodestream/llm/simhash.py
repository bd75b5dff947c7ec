"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits differ in at most half as many in one of
their two 32-bit halves. So each half emits every variant within half of that
half's share, and two near fingerprints meet on a common variant. Colliding
distinct fingerprints are then verified on all their bits. With radius 4 a
fingerprint emits 2 x 33 half variants instead of the 2,081 variants of its
whole ball of radius 2, and no link is lost.

Only distinct fingerprints are shuffled, so exact copies cost one row. A
fingerprint is in one of its 66 rows for a given variant: no variant can hold
more than a 66th of the rows. Variants are read as a sorted stream; a bucket of
at most ``BUCKET`` fingerprints is compared inside and yields a spanning forest
of its links, never all pairs. The fingerprints of a larger bucket emit their
whole ball of radius 2 instead: those that share such a variant are all within
4 bits of each other, so each is linked to the least of them, with no comparing.

Wide fingerprints (several 64-bit words, from independent mixes of one shingle
hash) have no linking: their blocks would find near pairs with some probability
only. Similarity of shingle sets is found exactly in ``jaccard``.

Nulls and empty texts have the zero fingerprint and link like any other. Bits set
in exactly half of the shingles (ties) are 0. Texts of any length are read whole;
repeated rows are repeated results; an empty table gives an empty one; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import components, id_and_text, saved, slices

SEED = 42
BUCKET = 128
_STEP = 1 << 16


def shingle_hashes(data: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle of ``words`` lower-cased words (fewer words: the whole sequence), repeats included."""
    tokens = data.lower().split()  # bytes: A-Z only, and exactly the six ASCII white-space characters
    if not tokens:
        return np.empty(0, "<u8")
    joined = b" ".join(tokens)
    h = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([h(joined, SEED)], "<u8")
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], spaces[: len(spaces) - words + 1] + 1)).tolist()
    ends = np.concatenate((spaces[words - 1 :], [len(joined)])).tolist()
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), "<u8", len(starts))


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _STEP):
        part = hashes[k : k + _STEP]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(data: bytes, words: int, width: int = 1) -> list[int]:
    """``width`` 64-bit words; the first is the plain SimHash, the others come from mixes of the same hashes."""
    h = shingle_hashes(data, words)
    out = [majority(h)]
    for k in range(1, width):
        mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        out.append(majority(mixed ^ (mixed >> np.uint64(32))))
    return out


def simhash_fingerprints(docs: DataFrame, words: int = 4, width: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: array of ``width`` longs (the bits of unsigned 64-bit words). No shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [np.array(fingerprint(x.encode(), words, width), "<u8").view("<i8") for x in batch["text"].to_pylist()]
            flat = np.concatenate(found) if found else np.empty(0, "<i8")
            yield pa.record_batch({"doc_id": batch["doc_id"], "fp": pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width), pa.int32()), pa.array(flat))})

    return id_and_text(docs, id_col, text_col).mapInArrow(work, "doc_id long, fp array<long>")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1)


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs that span the components of the links among ``fps`` (rows of words)."""
    left, out = np.ones(len(fps), bool), []
    for root in range(len(fps)):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        while queue:
            k = queue.pop()
            near = np.flatnonzero(left & (_distance(fps, fps[k]) <= radius))
            left[near] = False
            out += [(k, x) for x in near.tolist()]
            queue += near.tolist()
    return out


def _masks(bits: int, radius: int) -> list[int]:
    return [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)]


def near_links(distinct: DataFrame, radius: int, width: int = 1) -> DataFrame:
    """Links a, b (ids) among ``distinct`` (id long, fp array<long>, one row per fingerprint) within ``radius`` bits.

    Every two linked fingerprints are connected by the rows returned. That holds for
    one word and 4 bits; anything wider is refused.
    """
    if width != 1 or radius > 4:
        raise ValueError("links are complete for one word and a radius of at most 4 bits only")
    halves = []
    for k in range(width):
        halves += [F.get("fp", k).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.get("fp", k), 32)]
    within = 1  # a block differs in at most 2 bits: each side emits the variants within 1
    masks = F.array(*(F.lit(m).cast("long") for m in _masks(32, within)))
    blocks = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("block"), x.alias("value")) for k, x in enumerate(halves))))
    rows = distinct.select("id", "fp", blocks.alias("x"))
    rows = rows.select("id", "fp", F.col("x.block").alias("block"), F.col("x.value").alias("value"), F.explode(masks).alias("mask"))
    rows = rows.select((F.col("block") * (1 << 32) + F.col("value").bitwiseXOR(F.col("mask"))).alias("key"), "id", *(F.get("fp", k).alias(f"w{k}") for k in range(width)))

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, fps, pivot = None, [], [], None
        a: list[int] = []
        b: list[int] = []

        def close() -> None:
            if len(ids) > 1 and pivot is None:
                for x, y in _forest(np.array(fps, np.int64).view(np.uint64), radius):
                    a.append(ids[x])
                    b.append(ids[y])

        def out() -> pa.RecordBatch:
            batch = pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
            a.clear()
            b.clear()
            return batch

        for batch in batches:
            keys = batch["key"].to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            same = np.concatenate(([keys[0] == key], keys[1:] == keys[:-1]))
            many = np.flatnonzero(same | np.concatenate((same[1:], [True])))  # rows that are not alone in their bucket, and the last
            all_ids = batch["id"].to_numpy(zero_copy_only=False)[many].tolist()
            words = np.stack([batch[f"w{k}"].to_numpy(zero_copy_only=False)[many] for k in range(width)], axis=1)
            for k, (this, i) in enumerate(zip(keys[many].tolist(), all_ids, strict=True)):
                if this != key:
                    close()
                    key, ids, fps, pivot = this, [], [], None
                if pivot is None:
                    ids.append(i)
                    fps.append(words[k])
                    if len(ids) > BUCKET:  # too many to compare: all of them go the other way, marked by a pair with itself
                        pivot = True
                        a += ids
                        b += ids
                else:
                    a.append(i)
                    b.append(i)
            yield out()
        close()
        yield out()

    dealt = rows.repartition("key").sortWithinPartitions("key", "id")
    found = saved(dealt.mapInArrow(buckets, "a long, b long").distinct(), "links")
    links = found.where("a <> b")
    crowded = found.where("a = b").select(F.col("a").alias("id"))
    whole = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in _masks(64, radius // 2)))
    ball = crowded.join(distinct, "id").select("id", F.explode(F.transform(whole, lambda m: F.get("fp", 0).bitwiseXOR(m))).alias("key"))
    least = ball.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    more = ball.join(least, "key").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    return links.union(more)


def simhash_components(docs: DataFrame, words: int = 4, radius: int = 4, width: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id: the least doc_id reachable over links of at most ``radius`` bits.

    Exact copies share a fingerprint and meet before any shuffle of variants.
    Rows of equal doc_id stay separate rows; a null doc_id counts as larger than
    any other, and a component of null ids only has a null component_id.
    """
    fps = saved(simhash_fingerprints(docs, words, width, id_col, text_col), "fingerprints")
    groups = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # an id for each fingerprint: itself where it is one word, else a hash of its words
    ident = F.get("fp", 0) if width == 1 else F.xxhash64("fp")
    groups = saved(groups.select(ident.alias("id"), "fp", "least"), "groups")
    roots = components(near_links(groups.select("id", "fp"), radius, width), "components")
    labelled = groups.join(roots, groups.id == roots.node, "left").select("id", "least", F.coalesce("root", "id").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = labelled.join(least, "root").select("id", "component_id")
    hexed = F.lower(F.concat(*(F.lpad(F.hex(F.get("fp", k)), 16, "0") for k in range(width))))
    return fps.withColumn("id", ident).join(of_fp, "id").select("doc_id", hexed.alias("fingerprint"), "component_id")
