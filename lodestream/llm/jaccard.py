"""Near-duplicates: SimHash balls and shingle prefixes propose, exact Jaccard decides.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity
of 0.8 or more. Pairs are proposed in two ways, and every link is verified on the
whole sets:

1. SimHash fingerprints within 4 bits, by the meet-in-the-middle ball hashing of
   ``simhash``. That joins large families of near copies cheaply, but at a
   similarity of 0.8 fingerprints lie some 10 of 64 bits apart: balls of that
   radius have too many variants.
2. Prefixes. Under one order of all shingles, two sets of similarity 0.8 or more
   share one of their first n - ceil(0.8 n) + 1 shingles, whatever the order; so
   each set emits its prefix alone, and no link is lost. The order is: shingles
   that are frequent in a sample last, so that a passage which many texts share is
   in no prefix, then by hash. The sample decides only the cost.

A prefix bucket of at most ``BUCKET`` sets yields its pairs. A pair that meets only
in such buckets shares as many shingles of the prefixes as it has meetings; that
bounds its overlap, and only pairs that can reach 0.8 are verified. The sets of a
larger bucket that the links so far do not join are compared whole: the bucket is
dealt to blocks by component and size, and each two blocks that could link are
compared as a product of their incidence matrices. They yield a spanning forest of
their links, never all pairs.

Sets are of 64-bit hashes; texts without words (null, empty or white space) have the
empty set and are alike. Texts of any length are taken whole. Repeated rows are exact
copies of each other. Ties and null ids: see each function. Other columns of the
input are never read by name, so their names cannot clash. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm import simhash
from lodestream.llm.common import components, free_name, id_and_text, saved, slices
from lodestream.llm.decontam import let_through, seed_filter
from lodestream.llm.simhash import majority, shingle_hashes

WORDS = 5
#: Bits by which fingerprints of a proposed pair differ, at most.
RADIUS = 4
BUCKET = 32
#: Shingles (and 128 for each set) in a block of a larger bucket.
BLOCK = 1 << 18
#: Texts that are all in the sample, and of more the least share (one in ``EVERY``), so that a shingle of many more texts than
#: ``BUCKET`` is seen as frequent however large the corpus; how often a shingle is in it to count as frequent, and how many of
#: these tasks hold with their counts (the others: in a Bloom filter of bounded size).
SAMPLE, EVERY, FREQUENT, _HELD = 20_000, 4, 3, 100_000


def shingle_set(text: str) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(text.encode(), WORDS).view("<i8"))


#: A similarity of 0.8, as numerator and denominator.
LEAST = (4, 5)


def alike(overlap, n_a, n_b, least: tuple[int, int] = LEAST):
    """Jaccard similarity of ``least`` or more, in whole numbers (also of columns and arrays)."""
    return sum(least) * overlap >= least[0] * (n_a + n_b)


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def frequent_shingles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple:
    """Shingles that are frequent in a sample of the distinct texts, ascending, and their counts; then a filter of further ones, or None.

    Only the first shingles of a set by hash are counted, twice its prefix: the others are in a prefix only where most of these are frequent.
    """
    texts = id_and_text(docs, id_col, text_col)
    every = min(EVERY, -(-texts.count() // SAMPLE)) or 1
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").distinct()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [s[: 2 * prefix_size(len(s))] for s in map(shingle_set, batch["text"].to_pylist())]
            yield pa.record_batch({"s": pa.array(np.concatenate(sets) if sets else np.empty(0, "<i8"), pa.int64())})

    counts = saved(sample.mapInArrow(work, "s long").groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") >= FREQUENT), "frequent")
    found = counts.orderBy(F.desc("c"), "s").limit(_HELD).toArrow()
    s, c = found["s"].to_numpy(), found["c"].to_numpy()
    # the filter may hold shingles that are not frequent, and those of the list too: any order finds all links, if it is one for all sets
    rest = seed_filter(counts.select(F.col("s").alias("seed"))) if len(s) == _HELD else None
    order = np.argsort(s)
    return s[order], c[order], rest


def in_order(s: np.ndarray, often: np.ndarray, count: np.ndarray, rest: tuple[np.ndarray, int] | None = None) -> np.ndarray:
    """An ascending set with its frequent shingles last, by frequency."""
    if not len(often) or not len(s):
        return s
    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
    rank = np.where(often[at] == s, count[at], 0)
    if rest is not None:
        held = let_through(s.view(np.uint64), *rest)
        rank[held] = np.maximum(rank[held], 1)
    return s[np.lexsort((s, rank))]


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in arrays])))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.empty(0, "<i8"), pa.int64()))


def prefixes(docs: DataFrame, frequent: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, id (hash of the set), n (its size), fp (SimHash of the text), prefix. No shuffle.

    Of equal sets that a task has seen lately only the first has its prefix, so that
    a large group of copies is not shuffled row by row.
    """

    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            ids, sizes, prints, heads = [], [], [], []
            for text in batch["text"].to_pylist():
                hashes = shingle_hashes(text.encode(), WORDS)
                s = np.unique(hashes.view("<i8"))
                own = xxhash.xxh64_intdigest(s.tobytes())
                ids.append(own)
                sizes.append(len(s))
                prints.append(majority(hashes))
                heads.append(in_order(s, *sent.value)[: prefix_size(len(s))] if len(s) and own not in seen else s[:0])
                if len(seen) > _HELD:
                    seen.clear()
                seen.add(own)
            yield pa.record_batch({
                "doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "id": pa.array(np.array(ids, "<u8").view("<i8")),
                "n": pa.array(sizes, pa.int32()), "fp": pa.array(np.array(prints, "<u8").view("<i8")), "prefix": lists(heads),
            })

    rows = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(work, "doc_id long, text_hash long, id long, n int, fp long, prefix array<long>")


_MET = "crowded boolean, key long, a long, n_a int, b long, n_b int"


def meetings(rows: DataFrame) -> DataFrame:
    """The pairs of each bucket whose sizes allow 0.8; of a crowded bucket its members (a, n_a) instead."""
    bucket = BUCKET

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, crowded = None, [], False
        out: list[tuple] = []

        def close() -> None:
            if crowded:
                return
            for k, (n_b, b) in enumerate(members):
                out.extend((False, key, a, n_a, b, n_b) for n_a, a in members[:k] if 5 * n_a >= 4 * n_b)

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 6
            out.clear()
            types = [pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _MET.split(", ")])

        for batch in batches:
            keys = batch["key"].to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            same = np.concatenate(([keys[0] == key], keys[1:] == keys[:-1]))
            many = np.flatnonzero(same | np.concatenate((same[1:], [True])))  # rows that are not alone in their bucket, and the last
            for this, n, i in zip(*(batch[c].to_numpy(zero_copy_only=False)[many].tolist() for c in ("key", "n", "id")), strict=True):
                if this != key:
                    close()
                    key, members, crowded = this, [], False
                elif members[-1] == (n, i):
                    continue  # an exact copy
                if crowded:
                    out.append((True, key, i, n, None, None))
                    members = [(n, i)]
                    continue
                members.append((n, i))
                if len(members) > bucket:
                    crowded = True
                    out.extend((True, key, x, m, None, None) for m, x in members)
                if len(out) > 10_000:
                    yield flushed()
            yield flushed()
        close()
        yield flushed()

    return rows.repartition("key").sortWithinPartitions("key", "n", "id").mapInArrow(work, _MET)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``a`` shares with each of ``b``."""
    out = np.zeros((len(a), len(b)), np.float32)
    row_a, row_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(flat_a, flat_b)
    if not len(both):
        return out
    in_a, in_b = np.isin(flat_a, both), np.isin(flat_b, both)
    row_a, row_b = row_a[in_a], row_b[in_b]
    col_a, col_b = np.searchsorted(both, flat_a[in_a]), np.searchsorted(both, flat_b[in_b])
    times = np.bincount(col_b, minlength=len(both))
    # a shingle in few sets of b: each meeting counts; in many: a product of matrices, 1,024 shingles at a time
    order = np.argsort(col_b, kind="stable")
    first = np.concatenate(([0], np.cumsum(times)))
    few = np.flatnonzero(times[col_a] < 16)
    for k in range(0, len(few), 1 << 16):
        part = few[k : k + (1 << 16)]
        reps = times[col_a[part]]
        offset = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        met = row_b[order[np.repeat(first[col_a[part]], reps) + offset]]
        np.add.at(out, (np.repeat(row_a[part], reps), met), 1)
    number = np.cumsum(times >= 16) - 1
    for k in range(0, int(number[-1]) + 1, 1024):
        ones = []
        for row, col, size in ((row_a, col_a, len(a)), (row_b, col_b, len(b))):
            here = (times[col] >= 16) & (number[col] >= k) & (number[col] < k + 1024)
            m = np.zeros((size, 1024), np.float32)
            m[row[here], number[col[here]] - k] = 1
            ones.append(m)
        out += ones[0] @ ones[1].T
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Index pairs that span the components of a symmetric matrix of links."""
    left, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        while queue:
            k = queue.pop()
            near = np.flatnonzero(left & linked[k])
            left[near] = False
            out += [(k, x) for x in near.tolist()]
            queue += near.tolist()
    return out


def block_links(table: pa.Table, least: tuple[int, int] = LEAST) -> pa.Table:
    """Links among the members of two blocks (side 0 and 1), or inside the one block (side 0 alone)."""
    side, ids, n = (table[c].to_numpy() for c in ("side", "id", "n"))
    sets = [x.values.to_numpy() for x in table["shingles"]]
    order = np.argsort(side, kind="stable")
    at = [order[side[order] == k] for k in (0, 1)]
    linked = np.zeros((len(ids), len(ids)), bool)
    rows, cols = at if len(at[1]) else (at[0], at[0])
    if len(rows):
        found = overlaps([sets[k] for k in rows], [sets[k] for k in cols])
        linked[np.ix_(rows, cols)] = alike(found, n[rows][:, None], n[cols][None, :], least)
    pairs = forest(linked | linked.T)
    return pa.table({"a": pa.array([ids[x] for x, _ in pairs], pa.int64()), "b": pa.array([ids[y] for _, y in pairs], pa.int64())})


def ball_pairs(sets: DataFrame) -> DataFrame:
    """a, b: ids of sets whose fingerprints are equal or within ``RADIUS`` bits, enough of them to connect all such."""
    of = sets.select("id", "fp").distinct()
    first = saved(of.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    equal = of.join(first, "fp").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    near = simhash.near_links(first.select(F.col("fp").alias("id"), F.array("fp").alias("fp")), RADIUS)
    of_a, of_b = (first.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}")) for c in ("a", "b"))
    return equal.union(near.join(of_a, "a").join(of_b, "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b")))


def prefix_pairs(met: DataFrame) -> DataFrame:
    """a, b: pairs that can reach 0.8 by the meetings of their prefixes."""
    # a pair without a crowded meeting shares exactly as many shingles of the prefixes as it has meetings
    pairs = met.where("NOT crowded").groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("c"))
    after = F.greatest(*(F.floor((4 * F.col(n) + 4) / 5) - 1 for n in ("n_a", "n_b")))  # shingles behind the prefix
    return pairs.where(alike(F.col("c") + after, F.col("n_a"), F.col("n_b"))).select("a", "b")


def sets_of(docs: DataFrame, rows: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, shingles of the ``wanted`` ids, from one text each."""
    one = rows.groupBy("id").agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).join(wanted, "id", "left_semi").select("id", F.col("one.text_hash").alias("text_hash"), F.col("one.doc_id").alias("_doc"))
    texts = id_and_text(docs, id_col, text_col).withColumn("_hash", F.xxhash64("text"))
    found = texts.join(one, (texts._hash == one.text_hash) & texts.doc_id.eqNullSafe(one._doc)).select("id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            yield pa.record_batch({"id": batch["id"], "shingles": lists([shingle_set(x) for x in batch["text"].to_pylist()])})

    return found.mapInArrow(work, "id long, shingles array<long>").dropDuplicates(["id"])


def crowded_pairs(crowd: DataFrame, found: DataFrame, roots: DataFrame, similarity: tuple[int, int] = LEAST) -> DataFrame:
    """a, b: links across components (``roots``: node, root) among the members (key, id, n) of crowded buckets.

    A bucket is cut into blocks without bringing it together: its weight is summed by component and by size, and members
    are dealt by hash to as many blocks as that takes. A component that fills half a block has blocks of its own; the
    others, where they take more than four blocks, share them with members of like size.
    """
    crowd = crowd.join(roots.withColumnRenamed("node", "id"), "id", "left")
    of = F.coalesce("root", "id")
    mixed = crowd.groupBy("key").agg(F.min(of).alias("x"), F.max(of).alias("y"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("u"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("v"))
    mixed = mixed.where("x < y").groupBy("n", "u", "v").agg(F.min("key").alias("key")).select("key")  # of buckets with the same members, one
    crowd = saved(crowd.join(mixed, "key").select("key", "id", "n", "root", of.alias("own")), "crowd")
    weight = F.sum(F.col("n") + 128)
    large = crowd.where("root IS NOT NULL").groupBy("key", "root").agg(weight.alias("w")).where(F.col("w") >= BLOCK // 2).select("key", "root", F.lit(True).alias("large"))
    crowd = crowd.join(large, ["key", "root"], "left")
    # what fills few blocks is not cut by size: many small blocks would meet each other more often
    wide = crowd.where("large IS NULL").groupBy("key").agg(weight.alias("w")).where(F.col("w") > 4 * BLOCK).select("key", F.lit(True).alias("wide"))
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(similarity[1] / similarity[0])))
    kind = F.when(F.col("large"), F.xxhash64(F.lit(1), "root")).when(F.col("wide"), F.xxhash64(F.lit(2), size)).otherwise(F.lit(0).cast("long"))
    crowd = crowd.join(wide, "key", "left").withColumn("kind", kind)
    kinds = crowd.groupBy("key", "kind").agg(F.ceil(weight / BLOCK).alias("parts"))
    crowd = crowd.join(kinds, ["key", "kind"]).withColumn("block", F.xxhash64("kind", F.pmod(F.xxhash64("id"), "parts")))
    crowd = saved(crowd.select("key", "block", "id", "n", F.col("own").alias("root")), "crowd")
    ranges = crowd.groupBy("key", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("root").alias("low"), F.max("root").alias("high"))
    x, y = (ranges.select("key", F.col("block").alias(c), *(F.col(k).alias(f"{k}_{c}") for k in ("least", "most", "low", "high"))) for c in ("i", "j"))
    small, whole = similarity
    both = x.join(y, "key").where(f"i <= j AND {small} * least_j <= {whole} * most_i AND {small} * least_i <= {whole} * most_j AND NOT (low_i = high_i AND low_j = high_j AND low_i = low_j)").select("key", "i", "j")
    sides = [
        crowd.join(both.where(w).withColumn("block", F.col(c)), ["key", "block"]).select("key", "i", "j", F.lit(k).alias("side"), "id", "n")
        for k, (c, w) in enumerate((("i", "true"), ("j", "i < j")))
    ]
    blocks = sides[0].union(sides[1]).join(found, "id").select("key", "i", "j", "side", "id", "n", "shingles")
    return blocks.groupBy("key", "i", "j").applyInArrow(lambda table: block_links(table, similarity), "a long, b long")


def joined_components(links: DataFrame, more) -> DataFrame:
    """node, root over ``links``, then over what ``more(roots)`` links across their components. Saved."""
    roots = saved(components(links, "components"), "roots")
    at_a, at_b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b"))
    across = more(roots).join(at_a, "a", "left").join(at_b, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    across = saved(across.where("a <> b").distinct(), "across")
    last = components(across, "components").select(F.col("node").alias("upper"), F.col("root").alias("last"))
    labels = roots.join(last, F.col("root") == F.col("upper"), "left").select("node", F.coalesce("last", "root").alias("root"))
    alone = across.select(F.col("a").alias("node")).union(across.select("b")).distinct().join(roots.select("node"), "node", "left_anti")
    alone = alone.join(last, F.col("node") == F.col("upper")).select("node", F.col("last").alias("root"))
    return saved(labels.union(alone), "labels")


def _groups(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows doc_id, text_hash, id of set; and id, component of the sets that are linked to others."""
    rows = saved(prefixes(docs, frequent_shingles(docs, id_col, text_col), id_col, text_col), "prefixes")
    sets = rows.where("n > 0")
    met = saved(meetings(sets.select(F.explode("prefix").alias("key"), "n", "id")), "meetings")
    proposed = ball_pairs(sets).union(prefix_pairs(met)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    proposed = saved(proposed.where("a < b").distinct(), "pairs")
    crowd = met.where("crowded").select("key", F.col("a").alias("id"), F.col("n_a").alias("n"))
    wanted = proposed.select(F.col("a").alias("id")).union(proposed.select("b")).union(crowd.select("id")).distinct()
    found = saved(sets_of(docs, rows, wanted, id_col, text_col), "sets")

    set_a, set_b = (found.select(F.col("id").alias(c), F.col("shingles").alias(f"of_{c}")) for c in ("a", "b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    links = proposed.join(set_a, "a").join(set_b, "b").where(alike(shared, F.size("of_a"), F.size("of_b"))).select("a", "b")
    labels = joined_components(links, lambda roots: crowded_pairs(crowd, found, roots))
    return rows.select("doc_id", "text_hash", "id"), labels.select(F.col("node").alias("id"), F.col("root").alias("component"))


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, component (long): texts linked by similarities of 0.8 or more. One row for each row of ``docs``, null ids too."""
    rows, labels = _groups(docs, id_col, text_col)
    return rows.join(labels, "id", "left").select("doc_id", "text_hash", F.coalesce("component", "id").alias("component"))


def first_of_each_group(docs: DataFrame) -> DataFrame:
    """Of each group of near copies, the row of the least doc_id (ties: the text of the least hash); columns stay.

    Of equal rows one stays. Rows of one doc_id that are no near copies of each
    other are in groups of their own. Rows without an id cannot be told apart and
    all stay.
    """
    rows, labels = _groups(docs, "doc_id", "text")
    # copies of a text meet before the join, so that a large group of them is one row
    firsts = rows.where("doc_id IS NOT NULL").groupBy("id").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    firsts = firsts.join(labels, "id", "left").groupBy(F.coalesce("component", "id")).agg(F.min("first").alias("first"))
    key, mark, place = (free_name(docs, x) for x in ("_key", "_hash", "_place"))  # names that no column of docs has
    kept = saved(firsts.select(F.col("first.doc_id").alias(key), F.col("first.text_hash").alias(mark)).distinct(), "kept")
    named = docs.where("doc_id IS NOT NULL")
    text_hash = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rest = named.join(kept, (F.col("doc_id").cast("long") == F.col(key)) & (text_hash == F.col(mark)), "left_semi")
    if rows.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").limit(1).count():
        rest = rest.withColumn(place, F.row_number().over(Window.partitionBy("doc_id", text_hash).orderBy("doc_id"))).where(F.col(place) == 1).drop(place)
    return rest.union(docs.where("doc_id IS NULL"))
