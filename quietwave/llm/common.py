"""Shared small parts: text batches as bytes, fold numbers, work tables, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietwave.session import fresh_path


def crc_fold(key: str | Column, folds: int) -> Column:
    """crc32 of the key as text, modulo `folds`; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, end to end, and the n + 1 offsets; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    # Arrow allows bytes behind a null; take them out only if there are some
    if column.null_count and np.any(np.diff(offsets)[~column.is_valid().to_numpy(zero_copy_only=False)]):
        return text_bytes(pa.array([x or b"" for x in column.to_pylist()], pa.large_binary()))
    return flat[offsets[0]:offsets[-1]], offsets - offsets[0]


def each_text(column: pa.Array) -> Iterator[bytes]:
    """The texts of a column as bytes objects."""
    data, offsets = text_bytes(column)
    raw = data.tobytes()
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield raw[start:end]


class Work:
    """Work tables of one operator call, below the folder that the cluster shares.

    A table is written once and read back, which cuts the lineage and survives lost executors.
    `drop` removes tables that later tables no longer need.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, fresh_path(spark, name)

    def save(self, df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def within(self, name: str) -> Work:
        """Work tables of a further step, in a folder of their own below this one."""
        inner = Work.__new__(Work)
        inner.spark, inner.root = self.spark, f"{self.root}/{name}"
        return inner

    def release(self) -> None:
        """Asks the driver to collect what is no longer referred to, so that Spark deletes the shuffle files of steps that are over."""
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame, work: Work, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over undirected links, for every node with a link.

    Alternates the large-star and small-star steps on a table of edges (node, smaller neighbour): a
    step sends each neighbourhood to its smallest member, so the edges stay about as many as the links
    and the rounds grow with the logarithm of the longest chain. Minima are taken per node by partial
    aggregates; no neighbourhood is collected. Null ends and loops count as no link.
    """
    edges = links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, last, step = work.save(edges, "edges0"), None, 0
    while True:
        step += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above the node hang on to the node's least neighbour
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below the node, and the node, hang on to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = work.save(small, f"edges{step}")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        work.drop(f"edges{step - 1}")
        if state == last:
            break
        last = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
