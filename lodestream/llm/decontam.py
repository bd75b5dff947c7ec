"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over a window of tokens; the positions it ignores may
differ. Every window of every text and of every benchmark item is hashed under
each mask, and the two sides are joined on the hash. Each meeting gives an
alignment, which is verified: an overlap is its longest stretch that agrees in
four of five tokens, if that has 13 tokens or more (an item of 5 to 12 tokens: all
of its own).

No overlap escapes the masks. Of 13 tokens or more with 80% agreement, every one
has six agreeing tokens in the shape of one of six masks (a test tries the
patterns). An item of 5 to 12 tokens must agree over its whole length but for one
token in five: of k + 2 blocks k substitutions leave two whole, so there is a mask
for each two blocks.

What is joined: a filter of the items' hashes, of a size bounded by ``_MOST_BITS``
whatever the benchmark, goes to the tasks that read the texts; they keep the
windows that it lets through, and the tokens within an item's length around them.
So clean passages are not shuffled. A filter that is too full for its benchmark
lets more through, and the join sorts that out; nothing is lost. Nothing else of
the benchmark or the corpus comes to the driver. A seed that many items or texts
share meets once for each text and item that have it, with all its places. One that
more than ``_CROWDED`` texts and as many items share (a common stem of questions)
says too little by itself; there they meet only on rarer tokens around it.
That loses nothing: some 13 to 25 tokens of an overlap agree in four of five too,
hold a seed, and with it at least eleven agreeing tokens (of an item below 13: all
but one in five). Of two sets of (offset from the seed, token) that share so many,
the rarest shared one is left when each drops its ten commonest.

Tokens are runs of letters and digits, lower-cased, so case and punctuation do
not matter. Equal texts, and equal items, are compared once. Null texts and items
are empty and match nothing; items below ``LEAST_TOKENS`` tokens say too little,
and items without an id cannot be named: neither match. Texts of any length are
read whole. Repeated rows are repeated results. Of several overlaps of one text
and item the one with the most agreeing tokens counts (ties: the first in the
text, then in the item). Empty tables give no overlaps. Other columns of the
tables pass through or are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.common import free_name, id_and_text, saved, slices

#: Fixed masks: 1 counts, 0 is ignored.
MASKS = ("111111", "1111011", "1101111", "1110111", "1111101", "1011111")
#: Tokens of an overlap, and the share of them that must agree.
LEAST_OVERLAP, LEAST_AGREEMENT = 13, 0.8
LEAST_TOKENS = 5
#: Bits of the filter, as a power of two: 32 for each seed, between these; and bits that each seed sets.
_LEAST_BITS, _MOST_BITS, _PROBES = 16, 28, 4
#: Places of one seed in one row of the join.
_PLACES = 256
#: Texts and items that may meet on one seed alone, and tokens looked at on each side of a seed that more of both share.
_CROWDED, _AROUND = 64, 24
#: Tokens that a worker remembers, and their letters.
_KEPT_WORDS, _KEPT_LETTERS = 200_000, 40
_WORD = re.compile(r"[^\W_]+")
_PRIMES = [np.uint64(0x9E3779B97F4A7C15 ^ (0x2545F4914F6CDD1D * k & 0xFFFFFFFFFFFFFFFE)) for k in range(64)]


class TokenHashes(dict):
    """Hash of a token, remembered."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= _KEPT_LETTERS:
            if len(self) > _KEPT_WORDS:
                self.clear()
            self[word] = h
        return h

    def of(self, text: str) -> np.ndarray:
        return np.array([*map(self.__getitem__, _WORD.findall(text.lower()))], np.uint64)


def seeds(tokens: np.ndarray, places: tuple[int, ...], span: int) -> np.ndarray:
    """A hash for each window of ``span`` tokens, over its ``places`` alone."""
    n = len(tokens) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, sum(1 << p for p in places), np.uint64)
    for k, p in enumerate(places):
        out += tokens[p : p + n] * _PRIMES[k]
    out ^= out >> np.uint64(31)
    out *= _PRIMES[0]
    out ^= out >> np.uint64(32)
    return out


def longest(same: np.ndarray) -> tuple[int, int]:
    """The longest stretch of an alignment that agrees in LEAST_AGREEMENT (four of five) of its places."""
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -4))))
    first = np.searchsorted(-np.minimum.accumulate(total), -total)
    end = int((np.arange(len(total)) - first).argmax())
    return int(first[end]), end


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Places of an item of ``n`` tokens such that any n // 5 substitutions leave one of the masks whole."""
    parts = np.array_split(np.arange(n), n // 5 + 2)
    return [tuple(np.concatenate(two).tolist()) for two in combinations(parts, 2)]


def shapes_of(lengths: list[int]) -> list[tuple[tuple[int, ...], int]]:
    """Places and span of each mask: the fixed ones, and those for items of the given ``lengths`` below LEAST_OVERLAP."""
    fixed = [(tuple(k for k, c in enumerate(m) if c == "1"), len(m)) for m in MASKS]
    return fixed + [(places, n) for n in sorted(lengths) if LEAST_TOKENS <= n < LEAST_OVERLAP for places in short_masks(n)]


def placed(hashes: np.ndarray, at: np.ndarray) -> list[tuple[int, list[int]]]:
    """(hash, places) of hits, at most ``_PLACES`` places each."""
    order = np.lexsort((at, hashes))
    hashes, at = hashes[order].view(np.int64), at[order]
    cuts = np.flatnonzero(hashes[1:] != hashes[:-1]) + 1
    out = []
    for h, part in zip(hashes[np.append(0, cuts)].tolist() if len(hashes) else (), np.split(at, cuts), strict=False):
        out += [(h, part[k : k + _PLACES].tolist()) for k in range(0, len(part), _PLACES)]
    return out


def overlap(text: np.ndarray, item: np.ndarray, diagonals: list[int]) -> tuple[int, int, int, int] | None:
    """(agreeing tokens, tokens, first in the text, first in the item) of the best overlap on alignments text - item = diagonal."""
    least, best = min(LEAST_OVERLAP, len(item)), None
    for d in sorted(diagonals):
        a, b = max(0, d), min(len(text), d + len(item))
        same = text[a:b] == item[a - d : b - d]
        if len(same) < least or int(same.sum()) < LEAST_AGREEMENT * least:
            continue
        start, end = longest(same)
        if end - start >= least:
            x = (int(same[start:end].sum()), end - start, a + start, a + start - d)
            if best is None or (x[0], -x[2], -x[3]) > (best[0], -best[2], -best[3]):
                best = x
    return best


def _key(text: str | Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))))


_HITS = "array<struct<seed:long,at:array<int>>>"
_HIT = pa.list_(pa.struct([("seed", pa.int64()), ("at", pa.list_(pa.int32()))]))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item (key), tokens: each different text of the benchmark with enough tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for batch in slices(batches):
            found = [hashes.of(x).view(np.int64) for x in batch["text"].to_pylist()]
            yield pa.record_batch({"item": batch["item"], "tokens": pa.array(found, pa.list_(pa.int64()))})

    items = id_and_text(benchmark, "item_id").where("doc_id IS NOT NULL").select("text").distinct().select(_key("text").alias("item"), "text")
    return items.mapInArrow(work, "item binary, tokens array<long>").where(F.size("tokens") >= LEAST_TOKENS)


def item_seeds(items: DataFrame, shapes: list) -> DataFrame:
    """seed, item, item_at, need: places of each seed of each item, and the tokens of an overlap with it that agree at least."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for item, tokens in zip(batch["item"].to_pylist(), batch["tokens"], strict=True):
                tokens = tokens.values.to_numpy(zero_copy_only=False).view(np.uint64)
                least = min(LEAST_OVERLAP, len(tokens))
                hashes = [seeds(tokens, places, span) for k, (places, span) in enumerate(shapes) if k < len(MASKS) or len(tokens) == span]
                rows = placed(np.concatenate(hashes), np.concatenate([np.arange(len(h)) for h in hashes]))
                yield pa.record_batch({"seed": pa.array([h for h, _ in rows], pa.int64()), "item": pa.array([item] * len(rows), pa.binary()), "item_at": pa.array([x for _, x in rows], pa.list_(pa.int32())), "need": pa.array([least - least // 5] * len(rows), pa.int32())})

    return items.mapInArrow(work, "seed long, item binary, item_at array<int>, need int")


def seed_filter(found: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of the seeds, in 64-bit words; its size is bounded."""
    bits = min(_MOST_BITS, max(_LEAST_BITS, (32 * found.count()).bit_length()))
    one, two = F.shiftrightunsigned("seed", 32), F.col("seed").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1))
    probes = F.explode(F.array(*((one + two * k).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(_PROBES))))
    set_bit = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    words = found.select(probes.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(set_bit).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64), bits


def let_through(h: np.ndarray, words: np.ndarray, bits: int) -> np.ndarray:
    """Places in ``h`` of the seeds that are in the filter."""
    at = np.arange(len(h))
    one, two = h >> np.uint64(32), h & np.uint64(0xFFFFFFFF) | np.uint64(1)
    for k in range(_PROBES):
        bit = (one[at] + two[at] * np.uint64(k)) & np.uint64((1 << bits) - 1)
        at = at[(words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)]
    return at


def passages(docs: DataFrame, shapes: list, reach: int, held: tuple[np.ndarray, int]) -> DataFrame:
    """text (key), start, tokens, hits: the passages of each text around windows that the filter lets through. No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (words, bits) = TokenHashes(), sent.value
        for batch in slices(batches, 128):
            keys = batch["key"].to_pylist()
            found = [hashes.of(x) for x in batch["text"].to_pylist()]
            flat, ends = np.concatenate(found or [np.empty(0, np.uint64)]), np.cumsum([len(x) for x in found])
            owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
            seen, at = [], []
            for places, span in shapes:  # windows over the texts in a row; those that cross two texts do not count
                h = seeds(flat, places, span)
                hit = let_through(h, words, bits)
                hit = hit[owner[hit] == owner[hit + span - 1]]
                seen.append(h[hit])
                at.append(hit)
            seen, at = np.concatenate(seen), np.concatenate(at)
            order = np.argsort(at, kind="stable")
            seen, at = seen[order], at[order]
            out: list[tuple] = []
            for part in np.split(np.arange(len(at)), np.flatnonzero((np.diff(at) > 2 * reach) | (np.diff(owner[at]) > 0)) + 1) if len(at) else ():
                doc = int(owner[at[part[0]]])
                base, end = int(ends[doc]) - len(found[doc]), int(ends[doc])
                start, end = max(base, int(at[part[0]]) - reach), min(end, int(at[part[-1]]) + reach)
                out.append((keys[doc], start - base, flat[start:end].view(np.int64), [{"seed": h, "at": x} for h, x in placed(seen[part], at[part] - start)]))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.list_(pa.int64()), _HIT), strict=True)], names=["text", "start", "tokens", "hits"])

    texts = docs.select(_key("text").alias("key"), "text")
    return texts.mapInArrow(work, f"text binary, start int, tokens array<long>, hits {_HITS}")


def _around(rows: DataFrame, at: str) -> DataFrame:
    """``rows`` for each place in ``at`` and each token around it, with offset and token in place of ``tokens``."""
    each = rows.withColumn(at, F.explode(at))
    near = F.sequence(F.greatest(F.col(at) - _AROUND, F.lit(0)), F.least(F.col(at) + _AROUND, F.size("tokens") - 1))
    features = F.expr(f"transform(_near, i -> struct(i - {at} AS offset, tokens[i] AS token))")
    each = each.withColumn("_near", near).withColumn("_near", F.explode(features))
    return each.select(*(c for c in rows.columns if c != "tokens"), "_near.offset", "_near.token")


def crowded_meetings(hits: DataFrame, own: DataFrame, crowded: DataFrame, tokens: DataFrame, items: DataFrame) -> DataFrame:
    """text, start, item, diagonal: meetings on the seeds of ``crowded`` and one of the rarer tokens around them."""
    feature = ["seed", "offset", "token"]
    texts = saved(_around(hits.join(crowded, "seed").join(tokens, ["text", "start"]), "at"), "text_features")
    own = own.drop("need").join(crowded, "seed").join(items, "item")
    own = saved(_around(own, "item_at"), "item_features")
    met = texts.groupBy(*feature).agg(F.count("*").alias("n")).join(own.groupBy(*feature).agg(F.count("*").alias("m")), feature)
    weight = met.select(*feature, (F.col("n") * F.col("m")).alias("weight"))

    def rare(side: DataFrame, *row: str) -> DataFrame:  # at most 49 tokens in a window
        order = Window.partitionBy(*row, "seed").orderBy(F.col("weight").desc(), "offset", "token")
        return side.join(weight, feature).withColumn("rank", F.row_number().over(order)).where("rank >= need").select(*feature, *row)

    pairs = rare(texts, "text", "start", "at").join(rare(own, "item", "item_at"), feature)
    return pairs.select("text", "start", "item", (F.col("at") - F.col("item_at")).alias("diagonal"))


FOUND = ("overlap_tokens", "agreeing_tokens", "text_token", "item_token")


def overlapping_texts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """key (of a text), item_id and FOUND: the best overlap of each different text with each item it overlaps. Saved."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    items = saved(benchmark_items(benchmark), "items")
    sizes = items.groupBy(F.least(F.size("tokens"), F.lit(LEAST_OVERLAP)).alias("n")).agg(F.max(F.size("tokens")).alias("most")).collect()  # one row per length up to 13
    shapes, reach = shapes_of([r.n for r in sizes]), max((r.most for r in sizes), default=0)
    own = saved(item_seeds(items, shapes), "seeds")
    here = saved(passages(texts, shapes, reach, seed_filter(own)), "passages")

    # copies of a text meet before the join
    hits = here.select("text", "start", F.explode("hits").alias("x")).select("text", "start", F.col("x.seed").alias("seed"), F.col("x.at").alias("at"))
    hits = saved(hits.distinct(), "hits")
    tokens = here.select("text", "start", "tokens").dropDuplicates(["text", "start"])
    sizes = hits.groupBy("seed").agg(F.count("*").alias("texts")).where(F.col("texts") > _CROWDED)
    sizes = sizes.join(own.groupBy("seed").agg(F.count("*").alias("items"), F.min("need").alias("need")).where(F.col("items") > _CROWDED), "seed")
    crowded = saved(sizes.select("seed", "need"), "crowded")
    lines = F.array_distinct(F.flatten(F.transform("at", lambda i: F.transform("item_at", lambda j: i - j))))
    met = hits.join(crowded, "seed", "left_anti").join(own, "seed").select("text", "start", "item", F.explode(lines).alias("diagonal"))
    if not crowded.isEmpty():
        met = met.unionByName(crowded_meetings(hits, own, crowded, tokens, items))
    met = met.groupBy("text", "start", "item").agg(F.collect_set("diagonal").alias("diagonals"))
    pairs = met.join(items.withColumnRenamed("tokens", "item_tokens"), "item").join(tokens, ["text", "start"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for text, start, item, diagonals, tokens, own in zip(*(batch[c].to_pylist() for c in ("text", "start", "item", "diagonals")), batch["tokens"], batch["item_tokens"], strict=True):
                if x := overlap(tokens.values.to_numpy(zero_copy_only=False), own.values.to_numpy(zero_copy_only=False), diagonals):
                    out.append((text, item, x[1], x[0], start + x[2], x[3]))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), *[pa.int64()] * 4), strict=True)], names=["key", "item", *FOUND])

    best = pairs.mapInArrow(verify, "key binary, item binary, " + ", ".join(f"{c} long" for c in FOUND))
    ids = id_and_text(benchmark, "item_id").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("item_id"), _key("text").alias("item")).distinct()
    order = F.struct("agreeing_tokens", -F.col("text_token"), -F.col("item_token"))
    best = best.join(ids, "item").groupBy("key", "item_id").agg(F.max_by(F.struct(*FOUND), order).alias("x"))
    return saved(best.select("key", "item_id", "x.*"), "overlaps")


def with_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", output: str = "overlaps") -> DataFrame:
    """``docs`` with ``output``: an array of (item_id and FOUND), by item_id, of each benchmark item that a text overlaps.

    All other columns pass through; a column named ``output`` is replaced.
    """
    key = free_name(docs, "_key")
    rows = overlapping_texts(docs, benchmark, text_col).groupBy(F.col("key").alias(key)).agg(F.sort_array(F.collect_list(F.struct("item_id", *FOUND))).alias(f"{key}_found"))
    kept = docs.drop(output).withColumn(key, _key(text_col)).join(rows, key, "left")
    return kept.withColumn(output, F.coalesce(f"{key}_found", F.array().cast(rows.schema[f"{key}_found"].dataType))).drop(key, f"{key}_found")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text overlaps no benchmark item; columns stay."""
    key = free_name(docs, "_key")
    found = overlapping_texts(docs, benchmark, text_col).select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, _key(text_col)).join(found, key, "left_anti").select(*docs.columns)


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that overlap: doc_id, item_id and FOUND."""
    texts = id_and_text(docs, id_col, text_col)
    return texts.select("doc_id", _key("text").alias("key")).join(overlapping_texts(texts, benchmark), "key").select("doc_id", "item_id", *FOUND)
