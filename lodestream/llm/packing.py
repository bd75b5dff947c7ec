"""Hierarchical packing of documents into sequences of several power-of-two lengths.

A document longer than the window is cut into whole windows and a remainder.
Each remainder (or short document) is routed to the least tier that holds it.
Tiers are packed from long to short: the longest remainders open a window of
their tier, and shorter documents, longest fitting first, fill its gap; what then
is still open is filled with a piece cut from the longest document left, whose
rest goes back to its tier. When the documents of a packing group run out, the
last open window gives way to sequences of the powers of two that add up to it,
so that every sequence has a power of two of tokens and nothing is padded.
Sequences are then dealt to step groups of equal token counts.

Packing groups are bounded runs of one input partition, so there is no shuffle
and memory is bounded. Nulls and empty texts are one end token; equal rows are
packed separately. Of pieces of one length the last put goes first. Texts of any
length are cut into windows; an empty table gives no pieces; other columns are
not read, whatever their names. A sequence id is (partition, running number), one long.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodestream.llm.common import id_and_text, slices
from lodestream.llm.tokens import END_ID, encoder, public_path

WINDOW = 4096
LEAST_TIER = 256
#: Tokens of one packing group; bounds the memory of a task.
GROUP_TOKENS = 4_000_000
#: Tokens of one step group: what one training step takes.
STEP_TOKENS = 64 * WINDOW


def tier_of(length: int, window: int = WINDOW, least: int = LEAST_TIER) -> int:
    """The least tier that holds ``length`` tokens."""
    return max(least, min(window, 1 << (length - 1).bit_length()))


class _Pool:
    """Pieces (length, doc, start) of one packing group, taken longest first or longest that fits."""

    def __init__(self, pieces: list[tuple[int, int, int]]):
        self.by_length: dict[int, list[tuple[int, int]]] = {}
        for n, doc, start in pieces:
            self.by_length.setdefault(n, []).append((doc, start))
        self.lengths = sorted(self.by_length)

    def put(self, n: int, doc: int, start: int) -> None:
        if n not in self.by_length:
            self.by_length[n] = []
            bisect.insort(self.lengths, n)
        self.by_length[n].append((doc, start))

    def take(self, most: int | None = None) -> tuple[int, int, int] | None:
        k = len(self.lengths) if most is None else bisect.bisect_right(self.lengths, most)
        if not k:
            return None
        n = self.lengths[k - 1]
        doc, start = self.by_length[n].pop()
        if not self.by_length[n]:
            del self.by_length[n]
            self.lengths.pop(k - 1)
        return n, doc, start


def pack_group(lengths: list[int], window: int = WINDOW, least: int = LEAST_TIER) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (length, pieces (doc, start, length)) that hold each token of documents of ``lengths`` once."""
    done, rest = [], []
    for doc, n in enumerate(lengths):
        whole = n // window
        done += [(window, [(doc, k * window, window)]) for k in range(whole)]
        if n % window:
            rest.append((n % window, doc, whole * window))
    pool = _Pool(rest)
    while (piece := pool.take()) is not None:
        n, doc, start = piece
        size = tier_of(n, window, least)
        pieces, gap = [(doc, start, n)], size - n
        while gap:
            if (fit := pool.take(gap)) is not None:
                n, doc, start = fit
                pieces.append((doc, start, n))
                gap -= n
            elif (longer := pool.take()) is not None:
                n, doc, start = longer
                pieces.append((doc, start, gap))
                pool.put(n - gap, doc, start + gap)
                gap = 0
            else:
                break
        if not gap:
            done.append((size, pieces))
            continue
        for bit in reversed(range((size - gap).bit_length())):  # the last window: a sequence for each power of two
            if (want := 1 << bit) & (size - gap):
                taken = []
                while want:
                    doc, start, n = pieces.pop(0)
                    taken.append((doc, start, min(n, want)))
                    if n > want:
                        pieces.insert(0, (doc, start + want, n - want))
                    want -= taken[-1][2]
                done.append((sum(x[2] for x in taken), taken))
    return done


def step_groups(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step for each sequence, so that steps have equal token counts: largest first to the emptiest step."""
    import heapq

    steps = [(0, k) for k in range(max(1, -(-sum(sizes) // step_tokens)))]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        held, step = steps[0]
        heapq.heapreplace(steps, (held + sizes[k], step))
        out[k] = step
    return out


PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_group")] + [("ids", pa.binary())])


def packed(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit integers.
    """

    def pack(docs: list[tuple[int, bytes]], base: int, sequences: int, steps: int) -> tuple[pa.RecordBatch, int, int]:
        done = pack_group([len(ids) // 4 for _, ids in docs], window)
        step_of = step_groups([n for n, _ in done])
        columns: list[list] = [[] for _ in PIECES]
        for (size, pieces), step in zip(done, step_of, strict=True):
            offset = 0
            for doc, start, n in pieces:
                doc_id, ids = docs[doc]
                part = ids[4 * start : 4 * (start + n)]
                for c, x in zip(columns, (doc_id, start, n, zlib.crc32(part), len(ids) // 4, base + sequences, offset, size, base + steps + step, part if with_ids else None), strict=True):
                    c.append(x)
                offset += n
            sequences += 1
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES), sequences, steps + max(step_of, default=-1) + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(public_path(vocabulary))
        encode, end = own.encode, np.array([END_ID], "<u4").tobytes()
        base, sequences, steps = TaskContext.get().partitionId() << 36, 0, 0
        held: list[tuple[int, bytes]] = []
        tokens = 0
        for batch in slices(batches):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                held.append((doc_id, encode(text) + end))
                tokens += len(held[-1][1]) // 4
                if tokens >= GROUP_TOKENS:
                    out, sequences, steps = pack(held, base, sequences, steps)
                    held, tokens = [], 0
                    yield out
        own.forget()
        if held:
            yield pack(held, base, sequences, steps)[0]

    ids = "" if not with_ids else ", ids binary"
    out = id_and_text(docs, id_col, text_col)
    schema = ", ".join(f"{f.name} long" for f in PIECES if f.name != "ids") + ids

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in work(batches):
            yield batch if with_ids else batch.select(PIECES.names[:-1])

    return out.mapInArrow(shaped, schema)
