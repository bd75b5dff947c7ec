"""What the vector operators share: which rows have a usable vector, and Arrow lists as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite_vectors(df: DataFrame, id_col: str, vector_col: str, *more: Column) -> DataFrame:
    """vec_id (long), v (array<double>) and ``more`` of the rows whose vector is not null and has finite entries only.

    An empty vector has no entry, so nothing to work on: its row goes too.
    """
    v = F.col(vector_col).cast("array<double>")
    good = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))  # NaN counts as larger than infinity
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), *more).where(F.col("v").isNotNull() & good)


def commonest_length(vectors: DataFrame, v: str = "v") -> int:
    """The length that most vectors have (ties: the least); 0 where there are none."""
    first = vectors.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return first.d if first else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, all of ``width`` entries."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def summed(rows: DataFrame, work, keys: list[str]) -> list:
    """What ``work`` gives for the batches of each task, (keys, total), added up by key: few rows, whatever the input."""
    made = rows.mapInArrow(work, ", ".join(f"{k} int" for k in keys) + ", total double")
    return made.groupBy(*keys).agg(F.sum("total").alias("total")).collect()


def batches_of(batches: Iterator[pa.RecordBatch], column: str, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, matrix(batch[column], width)
