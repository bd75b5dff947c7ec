"""Document fingerprints from closed syncmers.

A k-mer of bytes is a closed syncmer if the least of its s-mers (by hash) is its
first or its last. That is decided by the k-mer alone, never by its context, so
two texts that share a passage select the same anchors in it. A fingerprint is
the ``size`` least anchor hashes (a bottom sketch), written as hexadecimal.

Nulls and empty texts have the empty fingerprint; a text shorter than k bytes
has one anchor, the hash of the whole text. A longer one without a closed syncmer
(only below 2k - s - 1 bytes) has one for the fingerprint: the k-mer that holds
the least s-mer. Equal texts have equal fingerprints. Texts of any length are
read whole; repeated rows are repeated results; an empty table gives an empty one;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import bounds, bucket_of, id_and_text, shuffle_partitions, slices

S = 8
K = 24
SIZE = 64
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_32 = np.uint64(32)


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions (bytes) and 32-bit hashes of the closed syncmers of ``data``."""
    if len(data) < K:
        if not data:
            return np.empty(0, np.int64), np.empty(0, np.uint32)
        return np.zeros(1, np.int64), np.array([xxhash.xxh32_intdigest(data)], np.uint32)
    eight = np.ndarray(len(data) - S + 1, "<u8", data, strides=(1,))  # every s-mer, read in place
    h = eight * _A
    h ^= h >> _32
    h *= _B
    least = np.minimum(h[:-1], h[1:])
    least = np.minimum(least[:-2], least[2:])
    least = np.minimum(least[:-4], least[4:])
    least = np.minimum(least[:-8], least[8:])
    least = np.minimum(least[:-1], h[K - S :])
    at = np.flatnonzero((h[: len(least)] == least) | (h[K - S :] == least))
    mixed = (h[at] * _A) ^ (h[at + S] * _B) ^ (h[at + 2 * S] * _C)
    mixed ^= mixed >> np.uint64(29)
    return at, ((mixed * _A) >> _32).astype(np.uint32)


def sketch(data: bytes, size: int = SIZE) -> np.ndarray:
    """The ``size`` least distinct anchor hashes, ascending."""
    found = anchors(data)[1]
    if data and not len(found):
        eight = np.ndarray(len(data) - S + 1, "<u8", data, strides=(1,))
        h = eight * _A
        h ^= h >> _32
        h *= _B
        at = min(int(h.argmin()), len(data) - K)  # the k-mer that starts at the least s-mer, or the last
        found = np.array([xxhash.xxh32_intdigest(data[at : at + K])], np.uint32)
    return np.unique(found)[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Jaccard similarity of two anchor sets, estimated from their bottom sketches; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = np.union1d(a, b)[:size]
    return float((np.isin(least, a) & np.isin(least, b)).sum() / len(least))


def text_of(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def syncmer_anchors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per anchor: doc_id, position (byte), hash. For positional matching."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                at, h = anchors(text.encode())
                yield pa.record_batch({"doc_id": pa.array([doc_id] * len(at), pa.int64()), "position": pa.array(at, pa.int64()), "hash": pa.array(h.astype(np.int64))})

    return id_and_text(docs, id_col, text_col).mapInArrow(work, "doc_id long, position long, hash long")


def syncmer_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row per document: doc_id, fingerprint. No shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [text_of(sketch(text.encode(), size)) for text in batch["text"].to_pylist()]
            yield pa.record_batch({"doc_id": batch["doc_id"], "fingerprint": pa.array(found, pa.string())})

    return id_and_text(docs, id_col, text_col).mapInArrow(work, "doc_id long, fingerprint string")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints each text and its edited text: the last floor(n/2) code points give way to the first of the next document.

    The next document is the next in ascending doc_id (ties: by text; null ids
    come first); after the last comes the first. Documents are dealt once by
    ranges of doc_id. The first document of a range is also sent to the range
    before it, so that its last document finds its successor.
    """
    spark = docs.sparkSession
    docs = id_and_text(docs, id_col, text_col)
    parts = shuffle_partitions(spark)
    cuts = bounds(docs, "doc_id", 4 * parts)  # several ranges to a task, so that hashing evens them out
    dealt = docs.withColumn("bucket", bucket_of("doc_id", cuts))
    # one row per range, at most four times as many as shuffle partitions
    firsts = sorted((r.bucket, r.has_null, r.least) for r in dealt.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("has_null")).collect())
    heads = [(here[0], before[0], None if here[1] else here[2]) for before, here in zip([firsts[-1], *firsts[:-1]], firsts, strict=True)] if firsts else []
    rows = dealt.select("bucket", F.lit(False).alias("next"), "doc_id", "text")
    if heads:
        to = F.create_map(*(F.lit(x) for here, before, _ in heads for x in (here, before)))
        least = F.create_map(*(x for here, _, first in heads for x in (F.lit(here), F.lit(first).cast("long"))))
        is_head = F.when(F.col("doc_id").eqNullSafe(F.element_at(least, F.col("bucket"))), F.element_at(to, F.col("bucket")))
        copies = dealt.withColumn("to", is_head).where("to IS NOT NULL").select(F.col("to").alias("bucket"), F.lit(True).alias("next"), "doc_id", "text")
        rows = rows.union(copies)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, closed = None, None, False
        for batch in slices(batches):
            out: list[tuple] = []
            for b, is_next, doc_id, text in zip(*(batch[c].to_pylist() for c in ("bucket", "next", "doc_id", "text")), strict=True):
                if b != bucket:
                    bucket, held, closed = b, None, False
                if closed:
                    continue
                data = text.encode()
                own = sketch(data)
                if held is not None:
                    old_id, old_text, old = held
                    half = len(old_text) // 2
                    edited = (old_text[: len(old_text) - half] + text[:half]).encode()
                    new = sketch(edited)
                    out.append((old_id, len(old_text), hashlib.sha256(edited).hexdigest(), text_of(old), text_of(new), likeness(old, new), likeness(old, own)))
                held, closed = (doc_id, text, own), is_next
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)], names=[x.split()[0] for x in EDITED.split(", ")])

    sorted_rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "next", F.col("doc_id").asc_nulls_first(), "text")
    return sorted_rows.mapInArrow(work, EDITED)
