"""Quality scores from a factorisation machine.

A text is a set of active features: its distinct words, hashed, with value
1 / sqrt(their number); and one bin for each structure statistic and each item
of metadata (length, lines), with value 1. The machine adds low-rank pairwise
interactions to a linear model; with the identity

    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

a text is scored in time linear in its active features.

The model is fitted on a bounded, hashed sample of labelled rows of the training
folds. A null text is the empty text: no words, and the lowest bins. Null labels
do not count; repeated rows are scored alike. Texts of any length are read whole.
Without labels every score is one half. A value on a bin's limit is in the upper
bin. Empty tables give empty results; other columns are not read, whatever their
names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestream.llm.common import id_and_text, slices
from lodestream.llm.toxicity import training_sample

#: At most so many labelled rows are used to fit the model.
LABELLED_ROWS = 4_000
BUCKETS = 1 << 12
RANK = 8
BINS = 8
EPOCHS = 25
STATS = ("chars", "words", "word_length", "lines", "upper", "digits", "punctuation", "symbols", "spaces", "distinct_words", "distinct_lines", "repeats", "shouts", "sentence")
_BYTE = np.zeros(256, np.int64)  # class of each byte: 1 upper, 2 lower, 3 digit, 4 sentence mark, 5 symbol, 6 white space, 7 beyond ASCII
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?'\"()-", b"!#$%&*+/<=>@[]\\^_`{|}~", b" \t\n\r\v\f"), 1):
    _BYTE[list(_chars)] = _k
_BYTE[128:] = 7


def words_of(text: str) -> tuple[np.ndarray, list[str]]:
    """Distinct hashed words, and the words."""
    words = text.lower().split()
    crc = zlib.crc32
    return np.unique(np.fromiter((crc(w.encode()) & (BUCKETS - 1) for w in set(words)), np.int64)), words


def statistics(text: str, words: list[str]) -> list[float]:
    data = text.encode()
    n, m = max(1, len(data)), max(1, len(words))
    c = np.bincount(_BYTE, np.bincount(np.frombuffer(data, np.uint8), minlength=256), minlength=8)
    lines = text.split("\n")
    return [
        np.log1p(len(data)), np.log1p(len(words)), len(data) / m, np.log1p(len(lines)), c[1] / n, c[3] / n, c[4] / n, c[5] / n, c[6] / n,
        len(set(words)) / m, len(set(lines)) / len(lines), sum(map(eq, words, words[1:])) / m, text.count("!") / m, m / (1 + text.count(". ") + text.count(".\n")),
    ]


@dataclass(frozen=True)
class FactorisationMachine:
    """Weights of fixed size; ``edges`` has the bin limits of each statistic."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    edges: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        active, sizes, values = [], [], []
        for text in texts:
            hashed, words = words_of(text)
            bins = np.array([np.searchsorted(e, s, "right") for e, s in zip(self.edges, statistics(text, words), strict=True)])
            active += [hashed, BUCKETS + np.arange(len(STATS)) * BINS + bins]
            sizes.append(len(hashed) + len(STATS))
            values += [np.full(len(hashed), 1 / np.sqrt(max(1, len(hashed))), np.float32), np.ones(len(STATS), np.float32)]
        if not texts:
            return np.empty(0)
        at, x = np.concatenate(active), np.concatenate(values)[:, None]
        starts = np.cumsum([0, *sizes[:-1]])
        vx = self.factors[at] * x
        pairs = 0.5 * (np.add.reduceat(vx, starts) ** 2 - np.add.reduceat(vx * vx, starts)).sum(axis=1)
        z = self.bias + np.add.reduceat(self.linear[at] * x[:, 0], starts) + pairs
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def fit_machine(hashed: list[np.ndarray], stats: np.ndarray, y: np.ndarray, seed: int = 7) -> FactorisationMachine:
    """Adam over mini-batches of the dense sample (at most ``LABELLED_ROWS`` rows of ``BUCKETS`` + bins)."""
    rng = np.random.default_rng(seed)
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T if len(stats) else np.zeros((len(STATS), BINS - 1))
    width = BUCKETS + len(STATS) * BINS
    linear, factors, bias = np.zeros(width, np.float32), rng.normal(0, 0.02, (width, RANK)).astype(np.float32), 0.0
    if not len(y):
        return FactorisationMachine(0.0, linear, np.zeros_like(factors), edges)
    x = np.zeros((len(y), width), np.float32)
    for row, h in zip(x, hashed, strict=True):
        row[h] = 1 / np.sqrt(max(1, len(h)))
    for k in range(len(STATS)):
        x[np.arange(len(y)), BUCKETS + k * BINS + np.searchsorted(edges[k], stats[:, k], "right")] = 1
    params = [linear, factors]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    decay, step, t = (1e-4, 2e-3), 0.02, 0
    bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    for epoch in range(EPOCHS):
        rate = step / (1 + epoch / 8)
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 256)):
            t += 1
            b = x[rows]
            vx = b @ factors
            z = bias + b @ linear + 0.5 * (vx**2 - (b * b) @ (factors * factors)).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]).astype(np.float32) / len(rows)
            bias -= rate * float(g.sum())
            grads = [b.T @ g, b.T @ (g[:, None] * vx) - factors * ((b * b).T @ g)[:, None]]
            for p, grad, (m1, m2), d in zip(params, grads, moments, decay, strict=True):
                grad = grad + d * p
                m1 += 0.1 * (grad - m1)
                m2 += 0.001 * (grad * grad - m2)
                p -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return FactorisationMachine(bias, linear, factors, edges)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> FactorisationMachine:
    """Features are made on the executors; the bounded sample's hashed words and statistics come to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(*words_of(x), x) for x in batch["text"].to_pylist()]
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"],
                    "label": batch["label"],
                    "hashed": pa.array([h.astype(np.int32) for h, _, _ in found], pa.list_(pa.int32())),
                    "stats": pa.array([statistics(x, w) for _, w, x in found], pa.list_(pa.float64())),
                }
            )

    got = training_sample(docs, labels, "quality", rows).mapInArrow(work, "doc_id long, label int, hashed array<int>, stats array<double>").toArrow().sort_by("doc_id")
    return fit_machine([np.array(x, np.int64) for x in got["hashed"].to_pylist()], np.array(got["stats"].to_pylist()).reshape(-1, len(STATS)), np.array(got["label"].to_pylist(), np.float32))


def quality_scores(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: one pass over the texts, no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            scores = [model.scores(texts[k : k + 256]) for k in range(0, len(texts), 256)]
            yield pa.record_batch({"doc_id": batch["doc_id"], "score": pa.array(np.concatenate(scores) if scores else [], pa.float64())})

    return id_and_text(docs, id_col, text_col).mapInArrow(work, "doc_id long, score double")
