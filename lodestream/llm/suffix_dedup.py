"""Exact removal of repeated byte strings, by suffix arrays over the places that repeat.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier.
Sorting every suffix of a corpus would move each text many times over. So:

1. Winnowing picks anchors: of the 32-byte grams in each window of ``LENGTH``
   bytes, the one with the least hash (the last of equal ones). Equal windows
   pick equal anchors at equal offsets, so strings that repeat meet on an anchor.
2. Anchors are shuffled by hash with a digest of their context, all that a
   window around them can hold. Occurrences with one and the same context (128
   bits agree: the anchor's and the context's) are repeats of the first as a
   whole. Of those in one batch of texts only the first is shuffled, so that a
   line of every text is some rows a task. Of each context the first goes on, if
   its anchor has several contexts. An anchor with more than ``SEVERAL`` contexts
   in one batch sends as many to the task of the anchor, which so learns that it
   has several; the others are dealt by anchor and context, so that no task gets
   all contexts of a frequent anchor. One that goes both ways meets itself in 3.
3. Those contexts are gathered by anchor into blocks of bounded size, and each
   block is suffix-sorted in two stages: only suffixes smaller than their
   successors are sorted directly; the rest are induced by scanning the buckets
   in order. Common prefixes of neighbours of ``LENGTH`` bytes or more are equal
   strings, and all but the first of them are repeats. The contexts of an anchor
   with more than ``GROUP`` of them are dealt to several tasks and sorted in runs
   of as many, and the strings that come first in their run are compared across
   runs by Spark, by 128-bit digest.

Texts are written once, bucketed by order key, so that the two later joins do
not shuffle them. Strings never cross documents. A null or empty text has no
bytes. Texts of any length are read whole, ``STEP`` bytes at a time. Rows of equal
doc_id are ordered by text (null ids first) and counted as separate documents, in
that order. Other columns are not read, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import id_and_text, saved, shuffle_partitions, slices

LENGTH = 100
GRAM = 32
#: Bytes of a context before its anchor; after the anchor's start it has ``LENGTH``.
BEFORE = LENGTH - GRAM
#: Contexts of one anchor that are sorted in one block, at most; and bytes of a block.
GROUP = 2_000
BLOCK_BYTES = 1 << 18
#: Texts among which a task looks for repeats before it shuffles.
ROWS = 512
#: Contexts of an anchor that a batch of so many texts deals by the anchor alone; two or more.
SEVERAL = 2
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: Bytes of a text whose anchors are found at a time; places in them take ``_PLACE_BITS``.
STEP = 1 << 22
_PLACE_BITS = 24


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a text (none below ``LENGTH`` bytes)."""
    if len(data) <= STEP + LENGTH:
        return _anchors(data)
    # every window of LENGTH bytes lies in one of the overlapping parts, and picks its anchor by itself
    parts = [(k, *_anchors(data[k : k + STEP + LENGTH - 1])) for k in range(0, len(data) - LENGTH + 1, STEP)]
    at, first = np.unique(np.concatenate([k + x for k, x, _ in parts]), return_index=True)
    return at, np.concatenate([h for _, _, h in parts])[first]


def _anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) - GRAM + 1
    if len(data) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    h = eight[:n] * _MULT[0]
    for k in (1, 2, 3):
        h ^= h >> np.uint64(29)
        h += eight[8 * k : 8 * k + n] * _MULT[k]
    h ^= h >> np.uint64(32)
    h *= _MULT[1]
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = (h & ~low) | (low - np.arange(n, dtype=np.uint64))
    width, reach = LENGTH - GRAM + 1, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    at = (low - (least & low)).astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    return at, h[at]


def _sorted_directly(keys: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Places ``at`` by the ``depth`` bytes there; ``keys`` has the next 8 bytes of each place, most significant first."""
    order = at[np.argsort(keys[at])]
    group = np.concatenate(([0], np.cumsum(keys[order[1:]] != keys[order[:-1]]))) if len(order) else order
    for step in range(8, depth, 8):
        same = group[1:] == group[:-1]
        tied = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
        if not len(tied):
            break
        key = keys[np.minimum(order[tied] + step, len(keys) - 1)]
        inner = np.lexsort((key, group[tied]))
        order[tied], key = order[tied][inner], key[inner]
        split = np.zeros(len(order), np.int64)
        split[tied[1:]] = (key[1:] != key[:-1]) & (group[tied[1:]] == group[tied[:-1]])
        group = group + np.cumsum(split)
    return order


def suffix_array(data: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Places of ``data`` (bytes) by the first ``depth`` bytes of their suffixes, in two stages."""
    n = len(data)
    if n < 2:
        return np.arange(n)
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    keys = np.ndarray(n, ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)
    diff = np.sign(np.diff(data.astype(np.int16), append=-1))  # the last suffix is larger than the empty one
    nearest = np.where(diff != 0, np.arange(n), n - 1)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    smaller = diff[nearest] > 0  # than its successor
    direct = _sorted_directly(keys, np.flatnonzero(smaller), depth + 8)
    starts = np.searchsorted(data[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[data[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate(induced[c]) if induced[c] else np.empty(0, np.int64)
        own = [wave]
        while len(wave):  # runs of c
            before = wave[wave > 0] - 1
            wave = before[(data[before] == c) & ~smaller[before]]
            own.append(wave)
        bucket = np.concatenate((*own, direct[starts[c] : starts[c + 1]]))
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~smaller[before] & (data[before] > c)]
        order = np.argsort(data[before], kind="stable")
        before = before[order]
        cuts = np.flatnonzero(np.diff(data[before])) + 1
        for part in np.split(before, cuts) if len(before) else ():
            induced[data[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Bytes that each place of ``order`` shares with the one before it, up to ``most``; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    padded = np.concatenate((data, np.zeros(most + 16, np.uint8))).tobytes()
    words = np.ndarray(len(data) + most, "<u8", padded, strides=(1,))
    live = np.arange(1, len(order))
    for step in range(0, most, 8):
        x = words[order[live] + step] ^ words[order[live - 1] + step]
        differs = x != 0
        low = x[differs] & (~x[differs] + np.uint64(1))
        out[live[differs]] = step + (np.bitwise_count(low - np.uint64(1)) >> 3)
        live = live[~differs]
    out[live] = most
    return np.minimum(out, most)


def repeats(contexts: list[tuple[int, int, bytes]], with_firsts: bool = False) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, bytes]]]:
    """Of contexts (key, place, bytes): the intervals (key, start, end) of strings of ``LENGTH`` bytes that are also earlier, and the strings (key, start, bytes) that are not."""
    data = np.frombuffer(b"".join(c for _, _, c in contexts), np.uint8)
    sizes = np.array([len(c) for _, _, c in contexts])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    whole = np.arange(len(data)) + LENGTH <= ends[owner]
    order = suffix_array(data)
    order = order[whole[order]]
    run = np.cumsum(common_prefixes(data, order) < LENGTH)
    key = np.array([k for k, _, _ in contexts])[owner[order]]
    shift = np.array([p for _, p, _ in contexts]) - (ends - sizes)
    start = order + shift[owner[order]]
    rank = np.lexsort((start, key, run))
    run, key, start, place = run[rank], key[rank], start[rank], order[rank]
    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    head = np.repeat(first, np.diff(np.append(first, len(run))))
    later = (key != key[head]) | (start != start[head])
    firsts = []
    if with_firsts:
        raw = data.tobytes()
        firsts = [(k, s, raw[p : p + LENGTH]) for k, s, p in zip(key[first].tolist(), start[first].tolist(), place[first].tolist(), strict=True)]
    place = np.sort(place[later])
    cut = np.flatnonzero((np.diff(place) > 1) | (np.diff(owner[place]) != 0)) + 1
    a, b = place[np.append(0, cut)] if len(place) else place, place[np.append(cut - 1, -1)] if len(place) else place
    of = owner[a]
    return list(zip(np.array([k for k, _, _ in contexts])[of].tolist(), (a + shift[of]).tolist(), (b + shift[of] + LENGTH).tolist(), strict=True)), firsts


def _rows(names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names=names)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors with their contexts. What repeats within its batch of texts is known here: merged to intervals (size < 0), dealt by a hash of their own.

    The place of an anchor that is dealt by its context too is complemented (at < 0).
    """
    digest = xxhash.xxh3_64_intdigest
    for batch in slices(batches, ROWS):
        parts = []
        for key, text in sorted(zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True)):
            data = text.encode()
            at, h = anchors(data)
            if len(at):
                context = np.fromiter((digest(data[max(0, a - BEFORE) : a + LENGTH], min(a, BEFORE)) for a in at.tolist()), np.uint64, len(at))
                parts.append((h, context, np.full(len(at), key), at, np.minimum(at, BEFORE) + np.minimum(len(data) - at, LENGTH)))
        if not parts:
            continue
        h, context, key, at, size = map(np.concatenate, zip(*parts, strict=True))
        # rows are in the order of documents and places, so the first of equal ones is the earliest
        order = np.argsort(h ^ (context * _MULT[0]), kind="stable")
        again = np.zeros(len(h), bool)
        again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (context[order[1:]] == context[order[:-1]])
        if again.any():
            own, start = key[again], np.maximum(at[again] - BEFORE, 0)
            end = start + size[again]
            row = np.cumsum(np.concatenate(([0], own[1:] != own[:-1])))  # the running maximum of ends begins anew with each document
            reach = np.maximum.accumulate(end + (row << 33)) - (row << 33)
            cut = np.flatnonzero((own[1:] != own[:-1]) | (start[1:] > reach[:-1])) + 1
            first, last = np.append(0, cut), np.append(cut - 1, -1)
            own, start, size_of = own[first], start[first], start[first] - reach[last]
            at, size = np.concatenate((at[~again], start)), np.concatenate((size[~again], size_of))
            key, h, context = np.concatenate((key[~again], own)), np.concatenate((h[~again], _mixed(own, start))), np.concatenate((context[~again], np.zeros(len(own), np.uint64)))
        live = np.flatnonzero(size > 0)
        live = live[np.argsort(h[live], kind="stable")]
        row = np.arange(len(live))
        begins = np.concatenate(([True], h[live[1:]] != h[live[:-1]]))
        far = live[row - np.maximum.accumulate(np.where(begins, row, 0)) >= SEVERAL]
        at[far] = ~at[far]
        yield pa.record_batch({"anchor": h.view(np.int64), "context": context.view(np.int64), "key": key.astype(np.int64), "at": at.astype(np.int32), "size": size.astype(np.int32)})


def _mixed(key: np.ndarray, start: np.ndarray) -> np.ndarray:
    h = key.astype(np.uint64) * _MULT[0] + start.astype(np.uint64) * _MULT[1]
    return (h ^ (h >> np.uint64(32))) * _MULT[2]


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by anchor, way (at < 0), context, key, place: repeats as a whole (kind 0: key, start, end) and first occurrences of the contexts of an anchor with several (kind 1: key, place, anchor)."""
    names = ["kind", "key", "a", "b"]
    anchor = context = pending = far = None
    for batch in batches:
        h, c = (batch[x].to_numpy(zero_copy_only=False) for x in ("anchor", "context"))
        if not len(h):
            continue
        same = np.concatenate(([h[0] == anchor], h[1:] == h[:-1]))
        follows = np.concatenate((same[1:], [True]))
        ready = batch["size"].to_numpy(zero_copy_only=False) < 0
        apart = batch["at"].to_numpy(zero_copy_only=False) < 0
        live = np.flatnonzero(same | follows | ready | apart)  # not alone; the last may go on in the next batch
        rows = []
        for this, ctx, key, at, size in zip(h[live].tolist(), c[live].tolist(), *(batch[x].to_numpy(zero_copy_only=False)[live].tolist() for x in ("key", "at", "size")), strict=True):
            if size < 0:
                rows.append((0, key, at, at - size))
                continue
            goes_on = at < 0  # its anchor is known to have several contexts
            at = ~at if goes_on else at
            if this != anchor or goes_on != far:
                anchor, context, far, pending = this, ctx, goes_on, (1, key, at, this)
                if goes_on:
                    rows.append(pending)
                    pending = None
            elif ctx == context:
                start = max(0, at - BEFORE)
                rows.append((0, key, start, start + size))
            else:
                if pending:
                    rows.append(pending)
                    pending = None
                rows.append((1, key, at, this))
                context = ctx
        yield _rows(names, rows)


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out: list[tuple] = []
        for key, text, places in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), batch["places"].to_pylist(), strict=True):
            data = text.encode()
            for x in places:
                start = max(0, x["a"] - BEFORE)
                out.append((x["b"], x["run"], key, start, data[start : x["a"] + LENGTH]))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["anchor", "run", "key", "start", "bytes"])


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From contexts sorted by anchor and run, in document order: repeats (kind 0: key, start, end).

    The anchors of runs from 0 on have more than ``GROUP`` contexts. They are solved
    ``GROUP`` at a time; what comes first there goes on by digest (kind 1: key, start,
    two halves).
    """
    names = ["kind", "key", "a", "b", "c"]
    block: list[tuple[int, int, bytes]] = []
    group: list[tuple[int, int, bytes]] = []
    anchor, held = None, 0

    def solved(contexts: list[tuple[int, int, bytes]], goes_on: bool) -> pa.RecordBatch:
        if not contexts:
            return _rows(names, [])
        found, firsts = repeats(contexts, goes_on)
        digests = [(key, start, xxhash.xxh3_128_intdigest(x)) for key, start, x in firsts]
        return _rows(names, [(0, *x, 0) for x in found] + [(1, key, start, (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)) for key, start, d in digests])

    for batch in batches:
        for *this, key, start, data in zip(*(batch[x].to_pylist() for x in ("anchor", "run", "key", "start", "bytes")), strict=True):
            if this != anchor or len(group) >= GROUP:
                if anchor and anchor[1] >= 0:
                    yield solved(group, True)
                else:
                    block += group
                    held += sum(len(x[2]) for x in group)
                    if held > BLOCK_BYTES:
                        yield solved(block, False)
                        block, held = [], 0
                anchor, group = this, []
            group.append((key, start, data))
    if anchor and anchor[1] >= 0:
        yield solved(group, True)
        group = []
    yield solved(block + group, False)


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _ordered(docs: DataFrame, parts: int) -> DataFrame:
    """key (in document order, unique), doc_id, text. The key is the doc_id itself, unless ids repeat or are null."""
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count():
        placed = docs.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        return saved(placed.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"), "ordered")
    return docs.select(F.col("doc_id").alias("key"), "doc_id", "text")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256; with ``with_text`` also kept (the remaining bytes)."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    ordered = _ordered(id_and_text(docs, id_col, text_col), parts)
    table = f"suffix_dedup_{uuid.uuid4().hex}"
    try:
        ordered.repartition(parts, "key").write.bucketBy(parts, "key").option("compression", "zstd").saveAsTable(table)
        return _deduplicated(spark.table(table), parts, with_text)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def _deduplicated(texts: DataFrame, parts: int, with_text: bool) -> DataFrame:
    """``deduplicated`` over a table of texts that is bucketed by key."""
    found = texts.select("key", "text").mapInArrow(_anchor_rows, "anchor long, context long, key long, at int, size int")
    far = F.col("at") < 0
    found = found.repartition(parts, F.col("anchor"), F.when(far, F.col("context"))).sortWithinPartitions("anchor", far, "context", "key", F.greatest(F.col("at"), F.bitwise_not("at")))
    classes = saved(found.mapInArrow(_classes, "kind long, key long, a long, b long"), "classes")
    first = classes.where("kind = 1")
    crowded = first.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > GROUP)
    run = F.coalesce(F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / GROUP)), F.lit(-1))
    places = first.join(crowded, "b", "left").withColumn("run", run).groupBy("key").agg(F.collect_list(F.struct("a", "b", "run")).alias("places"))
    contexts = texts.join(places, "key").select("key", "text", "places").mapInArrow(_context_rows, "anchor long, run long, key long, start long, bytes binary")
    blocks = contexts.repartition(parts, "anchor", "run").sortWithinPartitions("anchor", "run", "key", "start").mapInArrow(_block_rows, "kind long, key long, a long, b long, c long")
    solved = saved(blocks, "blocks")
    windows = solved.where("kind = 1").select("key", F.col("a").alias("start"), "b", "c")
    first = windows.groupBy("b", "c").agg(F.min(F.struct("key", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("b", "c", "first")
    later = windows.join(first, ["b", "c"]).where(F.struct("key", "start") != F.col("first")).select("key", F.col("start").alias("a"), (F.col("start") + LENGTH).alias("b"))
    intervals = classes.where("kind = 0").select("key", "a", "b").union(solved.where("kind = 0").select("key", "a", "b")).union(later)
    spans = intervals.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for doc_id, text, found in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                data, kept, at, runs = text.encode(), [], 0, 0
                for a, b in sorted((x["a"], x["b"]) for x in found or ()):
                    if a > at or not runs:
                        kept.append(data[at:a])
                        runs += 1
                    at = max(at, b)
                kept = b"".join((*kept, data[at:]))
                out.append((doc_id, len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)][: 6 if with_text else 5], names=names[: 6 if with_text else 5])

    return saved(texts.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(cut, KEPT + (", kept binary" if with_text else "")), "kept")
