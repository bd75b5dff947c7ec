"""Token ids in a word-aligned binary format: Simple-8b with escapes and block offsets.

A 64-bit word holds a 4-bit selector (the top bits) and 60 bits of payload. The
selector says how many values the payload holds and in how many bits each; the
widest selector that fits is taken greedily. Selector 15 is an escape: the next
word holds one value of 60 bits or more as it is. Selector 0 is unused, so a
zero word is never valid.

A file is a Parquet part of blocks. A block has whole documents: their ids and
token counts, the distinct token ids by falling frequency (values are ranks in
that table, so that frequent ids take few bits), and the words. ``payload`` is

    magic "S8B1" | documents u32 | table u32 | words u32 | values u32
    | doc_id i64 each | tokens u32 each | table u32 each | words u64 each

all little-endian. Nulls and empty texts have the end token alone; texts of any
length are read whole; repeated rows are repeated results; an empty table gives
no blocks; other columns are not read, whatever their names. Blocks have consecutive numbers in ascending doc_id order, so
a reader can start at any block and decode all its words at once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import bounds, bucket_of, id_and_text, shared_path, shuffle_partitions, slices
from lodestream.llm.tokens import END_ID, encoder, public_path

#: Fixed values: (values in a word, bits of each), by selector from 1.
WIDTHS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
MAGIC = b"S8B1"
#: Token ids gathered for a block; a longer document has a block of its own.
BLOCK_IDS = 1 << 20
#: Chunks that a worker remembers; a task here has no other large state.
KEPT_CHUNKS = 1_200_000
#: A block row; n_before counts the ids before it in its part.
BLOCKS = "block long, n_before long, n_tokens long, has_null boolean, payload binary"
_LIMITS = np.array([1 << bits for _, bits in WIDTHS], np.uint64)
_SELECTOR_OF = np.zeros(61, np.int64)
_SELECTOR_OF[[n for n, _ in WIDTHS]] = range(1, len(WIDTHS) + 1)
_COUNT_OF = np.array([0, *(n for n, _ in WIDTHS), 1], np.int64)


def encode_words(values: np.ndarray) -> np.ndarray:
    """``values`` (unsigned 64-bit) as Simple-8b words."""
    values = values.astype(np.uint64, copy=False)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64)
    # bits of each value, as the index of the first width that holds it; then the widest in each window, by doubling
    if n and (top := int(values.max())) < 1 << 16:
        need = np.searchsorted(_LIMITS, np.arange(top + 1, dtype=np.uint64), "right").astype(np.uint8)[values.astype(np.int64)]
    else:
        need = np.searchsorted(_LIMITS, values, "right").astype(np.uint8)
    widest = {1: need}
    while (reach := max(widest)) * 2 <= min(n, WIDTHS[0][0]):
        widest[reach * 2] = np.maximum(widest[reach][:-reach], widest[reach][reach:])
    take = np.ones(n, np.uint8)
    for s, (count, _) in enumerate(WIDTHS):
        if 1 < count <= n:
            reach = 1 << (count.bit_length() - 1)
            window = widest[reach] if reach == count else np.maximum(widest[reach][: n - count + 1], widest[reach][count - reach :])
            np.maximum(take[: n - count + 1], (window <= s) * np.uint8(count), out=take[: n - count + 1])
    at, steps, k = [], take.tolist(), 0
    while k < n:
        at.append(k)
        k += steps[k]
    start = np.array(at)
    chosen = _SELECTOR_OF[take[start]]
    chosen[(chosen == len(WIDTHS)) & (need[start] == len(WIDTHS))] = ESCAPE
    escapes = chosen == ESCAPE
    place = np.arange(len(start)) + np.concatenate([[0], np.cumsum(escapes)[:-1]])
    words = np.zeros(len(start) + int(escapes.sum()), np.uint64)
    for s, (count, bits) in enumerate(WIDTHS, 1):
        own = np.flatnonzero(chosen == s)
        if len(own):
            word = np.full(len(own), s << 60, np.uint64)
            for j in range(count):
                word |= values[start[own] + j] << np.uint64(bits * j)
            words[place[own]] = word
    own = np.flatnonzero(escapes)
    words[place[own]] = np.uint64(ESCAPE << 60)
    words[place[own] + 1] = values[start[own]]
    return words


def decode_words(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of Simple-8b ``words``, decoded one selector at a time."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    if (selector == ESCAPE).any():
        raw = np.zeros(len(words), bool)  # the word after an escape is data; escapes in data do not count
        for k in np.flatnonzero(selector == ESCAPE):
            if not raw[k]:
                raw[k + 1] = True
        count = np.where(raw, 0, _COUNT_OF[selector])
        selector = np.where(raw, 0, selector)
    else:
        count = _COUNT_OF[selector]
    to = np.cumsum(count) - count
    out = np.empty(n, np.uint64)
    for s, (many, bits) in enumerate(WIDTHS, 1):
        own = np.flatnonzero(selector == s)
        if len(own):
            word, place = words[own], to[own]
            mask = np.uint64((1 << bits) - 1)
            for j in range(many):
                out[place + j] = (word >> np.uint64(bits * j)) & mask
    own = np.flatnonzero(selector == ESCAPE)
    out[to[own]] = words[own + 1]
    return out


def encode_block(doc_ids: list[int], ids: list[bytes]) -> bytes:
    tokens = np.array([len(x) // 4 for x in ids], "<u4")
    flat = np.frombuffer(b"".join(ids), "<u4")
    counts = np.bincount(flat)
    seen = np.flatnonzero(counts)
    table = seen[np.argsort(-counts[seen], kind="stable")].astype("<u4")
    rank = np.empty(len(counts), np.uint64)
    rank[table] = np.arange(len(table), dtype=np.uint64)
    words = encode_words(rank[flat])
    head = struct.pack("<4sIIII", MAGIC, len(doc_ids), len(table), len(words), len(flat))
    return b"".join((head, np.array(doc_ids, "<i8").tobytes(), tokens.tobytes(), table.tobytes(), words.astype("<u8").tobytes()))


def decode_block(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, token counts and all ids (unsigned 32-bit) of a block."""
    magic, docs, table, words, n = struct.unpack_from("<4sIIII", payload)
    assert magic == MAGIC, "not a Simple-8b block"
    at = 20
    doc_ids = np.frombuffer(payload, "<i8", docs, at)
    tokens = np.frombuffer(payload, "<u4", docs, at := at + 8 * docs)
    ranks = np.frombuffer(payload, "<u4", table, at := at + 4 * docs)
    packed = np.frombuffer(payload, "<u8", words, at + 4 * table)
    return doc_ids, tokens, ranks[decode_words(packed, n)] if n else np.empty(0, "<u4")


def write_token_files(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text and writes it, in ascending doc_id order (ties: by text; nulls first), as block files at ``path``.

    One shuffle deals the texts by ranges of doc_id, whose cuts come from the ids
    alone; range k holds smaller ids than range k + 1, and numbers its blocks from
    k << 40.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(public_path(vocabulary), KEPT_CHUNKS).encode, np.array([END_ID], "<u4").tobytes()
        block = part = -1
        doc_ids: list[int] = []
        ids: list[bytes] = []
        held = written = 0

        def out() -> pa.RecordBatch:
            return pa.record_batch({"block": pa.array([block], pa.int64()), "n_before": pa.array([written], pa.int64()), "n_tokens": pa.array([held], pa.int64()), "has_null": pa.array([None in doc_ids]), "payload": pa.array([encode_block([x or 0 for x in doc_ids], ids)], pa.binary())})

        for batch in slices(batches):
            for own, doc_id, text in zip(batch["part"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = encode(text) + end
                if held and (own != part or held + len(found) // 4 > BLOCK_IDS or (doc_id is None) != (doc_ids[0] is None)):
                    yield out()
                    block, doc_ids, ids, written, held = block + 1, [], [], written + held, 0
                if own != part:
                    part, block, written = own, own << 40, 0
                doc_ids.append(doc_id)
                ids.append(found)
                held += len(found) // 4
        if ids:
            yield out()

    texts = id_and_text(docs, id_col, text_col)
    parts = shuffle_partitions(docs.sparkSession)
    cuts = bounds(texts, "doc_id", 4 * parts)  # several ranges to a task, so that hashing evens them out
    dealt = texts.select(bucket_of("doc_id", cuts).alias("part"), "doc_id", "text").repartition(parts, "part")
    ordered = dealt.sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(work, BLOCKS).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files at ``path``: doc_id, start (ids of all documents before), ids (unsigned 32-bit, little-endian)."""
    return _decoded(spark, path, True)


def token_file_digest(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_token_files``, with n_tokens and ids_crc32 in place of the ids."""
    return _decoded(spark, path, False)


def _decoded(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # ids before each part: one number per range, at most four times as many as shuffle partitions
    parts = sorted((r.part, r.n) for r in blocks.groupBy(F.shiftright("block", 40).alias("part")).agg(F.sum("n_tokens").alias("n")).collect())
    before, total = {}, 0
    for part, n in parts:
        before[part], total = total, total + n
    placed = blocks.select(F.shiftright("block", 40).alias("part"), "n_before", "has_null", "payload")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, within, has_null, payload in zip(batch["part"].to_pylist(), batch["n_before"].to_pylist(), batch["has_null"].to_pylist(), batch["payload"], strict=True):
                doc_ids, tokens, ids = decode_block(payload.as_py())
                data, ends = ids.astype("<u4").tobytes(), np.cumsum(tokens.astype(np.int64))
                starts = ends - tokens
                pieces = [data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = {"doc_id": pa.nulls(len(doc_ids), pa.int64()) if has_null else pa.array(doc_ids), "start": pa.array(starts + before[part] + within), "n_tokens": pa.array(tokens.astype(np.int64))}
                yield pa.record_batch(columns | ({"ids": pa.array(pieces, pa.binary())} if with_ids else {"ids_crc32": pa.array([zlib.crc32(x) for x in pieces], pa.int64())}))

    return placed.mapInArrow(work, f"doc_id long, start long, n_tokens long, {'ids binary' if with_ids else 'ids_crc32 long'}")


def stored_digest(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """Writes the token files of ``docs`` to the shared folder and reports what reading them back gives."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_token_files(docs, path, vocabulary)
    return token_file_digest(spark, path)
