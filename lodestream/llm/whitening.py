"""Whitening of embeddings: MLlib's singular values of the centred distributed rows.

Each entry c becomes the whole number floor(64 c) + 1000000. The model is fitted on
the fit list, which has every distinct vector once: with n of them and sums S, the
rows x - S/n go to ``RowMatrix.computeSVD`` as a DataFrame of vectors that Spark
makes and keeps; the singular values s give the eigenvalues s^2 / n of the
covariance (divisor n), and the right singular vectors are its components. Only
what is as large as a few vectors comes to the driver: S, the components, sums.

The total variance is not taken from the singular values (they may be fewer than
the entries): it is the sum of the exact deviations |n x - S|^2 over the fit list,
over n^3, in whole numbers.

Rows without a vector, or with a null or non-finite entry, are dropped. Vectors of
another length than the commonest one of the fit list (ties: the shorter) have no
place in its space and are dropped too. Repeated rows and ids are repeated results, a null id stays
null. Components whose eigenvalue is below ``RANK_TOLERANCE`` squared of the
largest have no variance to scale by and are left out; so an empty table, or one of
equal vectors only, gives no rows. Entries whose exact figures leave the range of a
long raise an arithmetic error rather than give wrong ones. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import saved, slices
from lodestream.llm.vectors import batches_of, commonest_length, finite_vectors, summed

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Singular values below this share of the largest count as zero.
RANK_TOLERANCE = 1e-6
#: Entries of a vector up to which the whole spectrum is computed, to double precision, from the covariance matrix.
DENSE = 15_000


@dataclass(frozen=True)
class Whitening:
    """``mean_of`` n vectors has sums ``sums``; ``project`` has a column for each component, over the root of its eigenvalue."""

    n: int
    sums: np.ndarray
    project: np.ndarray
    explained: list[float]
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _offsets(x, self.n, self.sums) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.project


def _offsets(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, exactly."""
    if x.size and n * (int(np.abs(x).max()) + 1) + int(np.abs(sums).max()) >= 1 << 63:
        raise OverflowError("n times an entry does not fit a long")
    return n * x - sums


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """The squared length of n x - S of each row, exactly."""
    off = _offsets(x, n, sums)
    if off.size and int(np.abs(off).max()) ** 2 * off.shape[1] >= 1 << 63:
        exact = [sum(int(v) ** 2 for v in row) for row in off]
        if max(exact) >= 1 << 63:
            raise OverflowError("a deviation does not fit a long")
        return np.array(exact, np.int64)
    return (off * off).sum(axis=1)


def whole_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x, the whole numbers of a usable vector."""
    kept = finite_vectors(df, id_col, vector_col)
    return kept.select("vec_id", F.transform("v", lambda c: F.floor(SCALE * c) + F.lit(SHIFT)).alias("x"))


def _sums(fit: DataFrame, d: int) -> tuple[int, np.ndarray]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in batches_of(batches, "x", d):
            # a column's total of one batch fits a long: its entries would not otherwise survive n x - S
            yield pa.record_batch({"k": pa.array(np.arange(-1, d), pa.int32()), "total": pa.array(np.append(batch.num_rows, x.sum(axis=0)), pa.int64())})

    got = dict(fit.mapInArrow(work, "k int, total long").groupBy("k").agg(F.sum("total")).collect())
    return got.get(-1, 0), np.array([got.get(k, 0) for k in range(d)], np.int64)


def _total_variance(fit: DataFrame, d: int, n: int, sums: np.ndarray) -> float:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in batches_of(batches, "x", d):
            yield pa.record_batch({"deviation": pa.array(deviations(x, n, sums), pa.int64())})

    total = fit.mapInArrow(work, "deviation long").agg(F.sum(F.col("deviation").cast("decimal(19,0)"))).first()[0]
    return int(total or 0) / n**3


def _identity_error(fit: DataFrame, d: int, model: Whitening) -> float:
    """The covariance of the whitened fit list, centred on its own mean, less the identity: the largest entry."""
    k = model.project.shape[1]

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in batches_of(batches, "x", d):
            yield pa.record_batch({"i": pa.array(np.arange(k), pa.int32()), "total": pa.array(model.whitened(x).sum(axis=0))})

    mean = np.zeros(k)
    for r in summed(fit, means, ["i"]):
        mean[r.i] = r.total / model.n

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in batches_of(batches, "x", d):
            w = model.whitened(x) - mean
            yield pa.record_batch({"i": pa.array(np.repeat(np.arange(k), k), pa.int32()), "j": pa.array(np.tile(np.arange(k), k), pa.int32()), "total": pa.array((w.T @ w).ravel())})

    return max(abs(r.total / model.n - (r.i == r.j)) for r in summed(fit, products, ["i", "j"]))


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fitted on the distinct ``x`` of ``vectors``; None where they have no variance."""
    fit = saved(vectors.select("x").distinct(), "fit_list")
    if not (d := commonest_length(fit, "x")):
        return None
    fit = fit.where(F.size("x") == d)
    n, sums = _sums(fit, d)
    total = _total_variance(fit, d, n, sums)
    if not total:
        return None
    centred = F.zip_with("x", F.array(*(F.lit(int(s)) for s in sums)), lambda a, s: (a * F.lit(n) - s) / F.lit(n))
    rows = MLUtils.convertVectorColumnsFromML(fit.select(array_to_vector(centred).alias("row")), "row")
    svd = RowMatrix(rows, n, d).computeSVD(d if d <= DENSE else components, computeU=False, rCond=RANK_TOLERANCE)
    s = svd.s.toArray()[:components]
    v = svd.V.toArray()[:, : len(s)]
    eigenvalues = s * s / n
    model = Whitening(n, sums, v / np.sqrt(eigenvalues), [float(e / total) for e in eigenvalues], 0.0)
    return Whitening(n, sums, model.project, model.explained, _identity_error(fit, d, model))


def whitened(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    vectors = whole_vectors(df, id_col, vector_col)
    model = fit_whitening(vectors, components)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    d, k = model.project.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in batches_of(slices(batches, 4096), "x", d):
            m = len(x)
            every = lambda values, t: pa.array(np.repeat(values, k), t)
            yield pa.record_batch({
                "vec_id": batch["vec_id"].take(pa.array(np.repeat(np.arange(m), k))), "component": pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                "n": every(np.full(m, model.n), pa.int64()), "deviation": every(deviations(x, model.n, model.sums), pa.int64()), "whitened": pa.array(model.whitened(x).ravel()),
                "explained": pa.array(np.tile(model.explained, m)), "identity_error": every(np.full(m, model.identity_error), pa.float64()),
            })

    return vectors.where(F.size("x") == d).mapInArrow(work, schema)
