"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` (long) and ``text`` (a null is the empty text) alone, whatever else ``docs`` has."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset (tests), below the warehouse."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ``shared_path`` that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes for no column of ``df`` to have it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a task holds few texts as Python strings at a time.

    At the end Arrow gives its free memory back: workers outlive their tasks.
    """
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    batch = None
    pa.default_memory_pool().release_unused()


def bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending cut points that deal the rows of ``df`` evenly by ``key``."""
    if parts < 2:
        return []
    cuts = df.select(F.percentile_approx(key, [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or []
    return sorted(set(cuts))


def bucket_of(key: str, cuts: list[int]) -> Column:
    """How many of ``cuts`` are at most ``key``; a null key is in bucket 0."""
    if not cuts:
        return F.lit(0)
    return F.when(F.col(key).isNull(), 0).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= F.col(key))))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a long, b long): node, root = smallest node reachable.

    First every node hooks to its least neighbour and to that one's, and the edges
    are contracted to the nodes hooked to: a dense group becomes a few nodes, so
    its many links are read once. Over the rest, each round takes for every node
    the least label among its neighbours and then the label's own label, so labels
    travel in doubling steps. Rounds are written to the shared folder; only a
    count comes to the driver. A hub is no hot spot: labels are aggregated
    map-side, and the joins are plain equi-joins that adaptive execution can split.
    """
    once = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), name)
    least = _both(once).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("hook"))
    least = saved(least, name)
    up = least.select(F.col("node").alias("up_node"), F.col("hook").alias("up_hook"))
    hooks = saved(least.join(up, least.hook == up.up_node).select("node", F.col("up_hook").alias("hook")), name)
    to_a, to_b = (hooks.select(F.col("node").alias(c), F.col("hook").alias(f"hook_{c}")) for c in ("a", "b"))
    rest = once.join(to_a, "a").join(to_b, "b").select(F.least("hook_a", "hook_b").alias("a"), F.greatest("hook_a", "hook_b").alias("b"))
    rest = saved(rest.where("a < b").distinct(), name)
    if not rest.limit(1).count():
        return hooks.select("node", F.col("hook").alias("root"))
    labels = _spread(_both(rest), name).select(F.col("node").alias("hook"), "root")
    return hooks.join(labels, "hook", "left").select("node", F.coalesce("root", "hook").alias("root"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _spread(both: DataFrame, name: str) -> DataFrame:
    """node, root of the components of edges given in both directions."""
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")), name)
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        stepped = labels.join(near, labels.node == near.a, "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        stepped = saved(stepped, name)
        up = stepped.select(F.col("node").alias("up_node"), F.col("root").alias("up_root"))
        jumped = saved(stepped.join(up, stepped.root == up.up_node, "left").select("node", "old", F.least("root", "up_root").alias("root")), name)
        if not jumped.where("root <> old").limit(1).count():
            return jumped.select("node", "root")
        labels = jumped.select("node", "root")
