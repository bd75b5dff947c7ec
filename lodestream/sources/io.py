"""Datasets by explicit format: nothing is guessed from a file name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from lodestream.operators.table import KernelError

FORMATS = ("parquet", "orc", "json", "csv", "text")
#: Formats that carry no schema of their own.
_NEED_SCHEMA = ("json", "csv")


def read(spark: SparkSession, path: str, format: str, schema: StructType | str | None = None, **options) -> DataFrame:
    """A lazy DataFrame over ``path``. json and csv need a schema, so that no extra pass infers one."""
    if format not in FORMATS:
        raise KernelError("plan", f"unknown format: {format}")
    if format in _NEED_SCHEMA and schema is None:
        raise KernelError("schema", f"{format} needs a schema")
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, format: str, mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options) -> None:
    """Writes through Spark's committer; ``partition_by`` lays out folders for partition pruning."""
    if format not in FORMATS:
        raise KernelError("plan", f"unknown format: {format}")
    df.write.format(format).mode(mode).options(**options).partitionBy(*partition_by).save(path)


def convert(spark: SparkSession, source: str, source_format: str, sink: str, sink_format: str, schema: StructType | str | None = None) -> None:
    write(read(spark, source, source_format, schema), sink, sink_format)


def read_database(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options) -> DataFrame:
    """A JDBC relation; with ``partition_column`` and its ``bounds`` it is read in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column:
        if bounds is None:
            raise KernelError("plan", "a partitioned read needs bounds")
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()
