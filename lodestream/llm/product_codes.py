"""Product codes of vectors, learned by Lloyd rounds over partition-local heaps.

A vector's entries become whole numbers, floor(1024 x), and are cut into equal
parts. Each part position has a codebook that starts with that part of the vectors
of the smallest ids. A round assigns every part to the nearest entry (ties: the
lower index) and moves each entry to floor(sum / count) of its parts.

No round scans every part against every entry. A part that was scanned at some time
with distances u to its entry and l to the second nearest keeps its entry as long as
l - u is above what its entry and the furthest-moving other entry have drifted since.
So a block of vectors has, for each position and entry, a heap of its parts keyed by
l - u plus the entry's cumulative drift at that time; in a round only the parts whose
key the cumulative drift has reached are popped, scanned exactly and pushed again.
Heaps, assignments and the whole numbers of a block are one row of a table in the
shared folder, so a lost executor costs its tasks of one round. Codebooks have a
fixed size; they and their sums, of which each block gives the change, are all that
comes to the driver. Distances are exact whole numbers; the keys are rounded, with a
margin that only causes more scans.

Rows without a vector, or with a null or non-finite entry, are dropped; so are
vectors of another length than the commonest (ties: the shorter). A length that
cannot be cut into equal parts is refused. Fewer vectors than entries give smaller
codebooks; equal ids take their place by the vector, null ids the last ones. Repeated
rows are repeated results. Labels of any type may be null; nulls are equal. An empty
table gives an empty result. Whole numbers whose squared distances leave the range of
a long raise an arithmetic error. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import removed, saved, shared_path
from lodestream.llm.vectors import batches_of, commonest_length, finite_vectors

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors whose heaps are one row of the state.
BLOCK = 4096
#: Rows that a label's sum is joined to in as many places.
_SALTS = 32
_STATE = "n int, vectors binary, assigned binary, keys binary, members binary, starts binary, entries binary, totals binary"


def scan(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each point (ties: the lower index), the squared distance to it and to the second nearest; exact."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    bound = points.shape[1] * (2 * most) ** 2
    if bound >= 1 << 62:
        raise OverflowError("a squared distance does not fit a long")
    kind = np.float64 if bound < 1 << 52 else np.int64  # products of matrices are fast for the one, exact for both
    p, c = points.astype(kind), entries.astype(kind)
    d = (p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)[None, :]
    near, rows = d.argmin(axis=1), np.arange(len(d))
    first = d[rows, near]
    d[rows, near] = np.inf if kind is np.float64 else (1 << 62)
    return near, first, d.min(axis=1, initial=np.inf if kind is np.float64 else 1 << 62)


class Heaps:
    """Parts of one position of a block, a heap for each entry: (key, part) in one array, those of an entry together."""

    def __init__(self, keys: np.ndarray, members: np.ndarray, starts: np.ndarray):
        self.keys, self.members, self.starts = keys, members, starts
        self.opened: dict[int, list[tuple[float, int]]] = {}

    @classmethod
    def empty(cls, entries: int) -> Heaps:
        return cls(np.empty(0), np.empty(0, np.int64), np.zeros(entries + 1, np.int64))

    def of(self, entry: int) -> list[tuple[float, int]]:
        if entry not in self.opened:
            own = slice(self.starts[entry], self.starts[entry + 1])
            self.opened[entry] = list(zip(self.keys[own].tolist(), self.members[own].tolist(), strict=True))
        return self.opened[entry]

    def violated(self, reached: np.ndarray) -> list[int]:
        """Pops the parts whose key is at most what their entry has reached."""
        filled = np.flatnonzero(np.diff(self.starts))
        out = []
        for entry in filled[self.keys[self.starts[filled]] <= reached[filled]].tolist():
            heap, limit = self.of(entry), reached[entry]
            while heap and heap[0][0] <= limit:
                out.append(heappop(heap)[1])
        return out

    def add(self, entries: np.ndarray, keys: np.ndarray, members: list[int]) -> None:
        if len(members) > len(self.members) // 2:  # many at once: heapify is linear
            for entry, key, member in zip(entries.tolist(), keys.tolist(), members, strict=True):
                self.of(entry).append((key, member))
            for entry in set(entries.tolist()):
                heapify(self.of(entry))
        else:
            for entry, key, member in zip(entries.tolist(), keys.tolist(), members, strict=True):
                heappush(self.of(entry), (key, member))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys, members, starts, with the heaps that were opened in place of what they were."""
        keys, members, sizes = [], [], np.diff(self.starts)
        for entry in range(len(sizes)):
            if (heap := self.opened.get(entry)) is None:
                own = slice(self.starts[entry], self.starts[entry + 1])
                keys.append(self.keys[own])
                members.append(self.members[own])
            else:
                keys.append(np.array([k for k, _ in heap], np.float64))
                members.append(np.array([m for _, m in heap], np.int64))
        return np.concatenate(keys), np.concatenate(members), np.concatenate(([0], np.cumsum([len(k) for k in keys])))


class Codebooks:
    """``at``: position, entry, entry's numbers; ``reached``: cumulative drift of an entry and the furthest-moving other one."""

    def __init__(self, at: np.ndarray):
        self.at = at
        self.reached = np.zeros(at.shape[:2])

    def moved_to(self, at: np.ndarray) -> None:
        drift = np.sqrt(((at - self.at).astype(np.float64) ** 2).sum(axis=2))
        order = np.sort(drift, axis=1)
        most, second = order[:, -1:], (order[:, -2:-1] if drift.shape[1] > 1 else np.zeros((len(at), 1)))
        self.reached += drift + np.where(drift == most, np.where((drift == most).sum(axis=1, keepdims=True) > 1, most, second), most)
        self.at = at

    def margin(self) -> np.ndarray:
        return self.reached + 1e-6 * (1 + self.reached)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.at.ravel().tolist())).encode()).hexdigest()


def assign(vectors: np.ndarray, assigned: np.ndarray | None, heaps: list[Heaps], books: Codebooks) -> tuple[np.ndarray, dict[int, tuple[int, np.ndarray]]]:
    """Assignments of a block to the current codebooks, and by position and entry how the count and the sums of its parts change."""
    positions, entries, width = books.at.shape
    changes: dict[int, tuple[int, np.ndarray]] = {}
    new = np.zeros((len(vectors), positions), np.int64) if assigned is None else assigned.copy()
    limits = books.margin()
    for q in range(positions):
        part = vectors[:, q * width : (q + 1) * width]
        at = list(range(len(vectors))) if assigned is None else heaps[q].violated(limits[q])
        if not at:
            continue
        near, first, second = scan(part[at], books.at[q])
        heaps[q].add(near, np.sqrt(second.astype(np.float64)) - np.sqrt(first.astype(np.float64)) + books.reached[q][near], at)
        new[at, q] = near
        count, sums = np.zeros(entries, np.int64), np.zeros((entries, width), np.int64)
        came = np.flatnonzero(near != assigned[at, q]) if assigned is not None else np.arange(len(at))
        rows = np.array(at)[came]
        np.add.at(sums, near[came], part[rows])
        count += np.bincount(near[came], minlength=entries)
        if assigned is not None:
            np.add.at(sums, assigned[rows, q], -part[rows])
            count -= np.bincount(assigned[rows, q], minlength=entries)
        for entry in np.flatnonzero((count != 0) | (sums != 0).any(axis=1)).tolist():
            changes[q * entries + entry] = (int(count[entry]), sums[entry])
    return new, changes


def _packed(vectors: np.ndarray) -> bytes:
    return vectors.astype("<i4" if np.abs(vectors).max(initial=0) < 1 << 31 else "<i8").tobytes()


def _unpacked(data: bytes, n: int, d: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // (n * d)}").reshape(n, d).astype(np.int64)


def _row(vectors: np.ndarray, assigned: np.ndarray, heaps: list[Heaps], changes: dict[int, tuple[int, np.ndarray]]) -> dict[str, list]:
    keys, members, starts = zip(*(h.arrays() for h in heaps), strict=True)
    totals = [np.append(count, sums) for count, sums in changes.values()]
    return {
        "n": [len(vectors)], "vectors": [_packed(vectors)], "assigned": [assigned.astype(np.uint8).tobytes()], "keys": [np.concatenate(keys).tobytes()],
        "members": [np.concatenate(members).astype("<u2").tobytes()], "starts": [np.concatenate(starts).astype("<u2").tobytes()],
        "entries": [np.array([*changes], "<i4").tobytes()], "totals": [np.concatenate(totals).astype("<i8").tobytes() if totals else b""],
    }


def _blocks(batch: pa.RecordBatch, shape: tuple[int, int, int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[Heaps]]]:
    """Row number, whole numbers, assignments and heaps of the state's rows, one at a time."""
    positions, entries, width = shape
    for k in range(batch.num_rows):
        raw = {c: batch[c][k].as_py() for c in ("n", "vectors", "assigned", "keys", "members", "starts")}
        n = raw["n"]
        keys, members = np.frombuffer(raw["keys"]).reshape(positions, n), np.frombuffer(raw["members"], "<u2").reshape(positions, n)
        starts = np.frombuffer(raw["starts"], "<u2").reshape(positions, entries + 1).astype(np.int64)
        yield k, _unpacked(raw["vectors"], n, positions * width), np.frombuffer(raw["assigned"], np.uint8).reshape(n, positions).astype(np.int64), [Heaps(*x) for x in zip(keys, members, starts, strict=True)]


def _state(spark, made: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = shared_path(spark, name)
    made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path), path


def _totals(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Changes of counts and sums over all blocks: one row for each number that a task changed, added up by Spark."""
    positions, entries, width = shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((positions * entries, width + 1), np.int64)
        for batch in batches:
            for at, own in zip(batch["entries"].to_pylist(), batch["totals"].to_pylist(), strict=True):
                total[np.frombuffer(at, "<i4")] += np.frombuffer(own, "<i8").reshape(-1, width + 1)
        entry, number = np.nonzero(total)
        yield pa.record_batch({"entry": pa.array(entry, pa.int32()), "number": pa.array(number, pa.int32()), "total": pa.array(total[entry, number], pa.int64())})

    out = np.zeros((positions * entries, width + 1), np.int64)
    for r in state.select("entries", "totals").mapInArrow(work, "entry int, number int, total long").groupBy("entry", "number").agg(F.sum("total").alias("total")).collect():
        out[r.entry, r.number] = r.total
    out = out.reshape(positions, entries, width + 1)
    return out[:, :, 0], out[:, :, 1:]


def product_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code (two hexadecimal digits a part), error, label_error, codebooks_sha256: one row for each usable vector.

    ``entries`` is 256 at most, as a code has one byte for each part.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    spark = df.sparkSession
    kept = finite_vectors(df, id_col, vector_col, F.col(label_col).alias("label"))
    label_type = kept.schema["label"].dataType.simpleString()
    d = commonest_length(kept)
    if not d:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    if d % parts:
        raise ValueError(f"vectors of {d} entries cannot be cut into {parts} equal parts")
    whole = kept.where(F.size("v") == d).select("vec_id", "label", F.transform("v", lambda c: F.floor(SCALE * c)).alias("x"))
    first = np.array([r.x for r in whole.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()], np.int64)
    books = Codebooks(np.stack(np.split(first, parts, axis=1)))
    shape = books.at.shape
    schema = f"ids array<bigint>, labels array<{label_type}>, {_STATE}"

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, pa.Array, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            ids, labels = (pa.concat_arrays([h[k] for h in held]) for k in (0, 1))
            vectors = np.concatenate([h[2] for h in held])
            held.clear()
            heaps = [Heaps.empty(shape[1]) for _ in range(parts)]
            assigned, changes = assign(vectors, None, heaps, books)
            ends = pa.array([0, len(ids)], pa.int32())
            return pa.record_batch({"ids": pa.ListArray.from_arrays(ends, ids), "labels": pa.ListArray.from_arrays(ends, labels), **_typed(_row(vectors, assigned, heaps, changes))})

        for batch, x in batches_of(batches, "x", d):
            at = 0
            while at < len(x):
                some = min(len(x) - at, BLOCK - sum(len(h[2]) for h in held))
                held.append((batch["vec_id"].slice(at, some), batch["label"].slice(at, some), x[at : at + some]))
                at += some
                if sum(len(h[2]) for h in held) == BLOCK:
                    yield block()
        if held:
            yield block()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, vectors, assigned, heaps in _blocks(batch, shape):
                new, changes = assign(vectors, assigned, heaps, books)
                yield pa.record_batch({"ids": batch["ids"].slice(k, 1), "labels": batch["labels"].slice(k, 1), **_typed(_row(vectors, new, heaps, changes))})

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = shape[2]
        for batch in batches:
            for k, vectors, assigned, heaps in _blocks(batch, shape):
                new, _ = assign(vectors, assigned, heaps, books)
                error = sum(((vectors[:, q * width : (q + 1) * width] - books.at[q][new[:, q]]) ** 2).sum(axis=1) for q in range(parts))
                codes = [row.tobytes().hex() for row in new.astype(np.uint8)]
                yield pa.record_batch({"vec_id": batch["ids"].slice(k, 1).flatten(), "label": batch["labels"].slice(k, 1).flatten(), "code": pa.array(codes, pa.string()), "error": pa.array(error, pa.int64())})

    state, path = _state(spark, whole.mapInArrow(begin, schema), "codes")
    count, sums = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)
    for turn in range(rounds):
        changed = _totals(state, shape)
        count, sums = count + changed[0], sums + changed[1]
        books.moved_to(np.where(count[:, :, None] > 0, sums // np.maximum(count, 1)[:, :, None], books.at))
        if turn < rounds - 1:
            before = path
            state, path = _state(spark, state.mapInArrow(again, schema), "codes")
            removed(spark, before)
    rows = saved(state.mapInArrow(end, f"vec_id long, label {label_type}, code string, error long"), "codes")
    removed(spark, path)
    # a label may have a third of all rows: its sum is laid out once for each salt
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    salted = rows.withColumn("own", F.pmod(F.xxhash64("vec_id", "code"), F.lit(_SALTS)).cast("int"))
    out = salted.join(by_label, (F.col("own") == F.col("salt")) & F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _typed(row: dict[str, list]) -> dict[str, pa.Array]:
    return {c: pa.array(v, pa.int32() if c == "n" else pa.binary()) for c, v in row.items()}
