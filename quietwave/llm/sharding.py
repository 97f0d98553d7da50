"""Sharding by an external shuffle of two passes, in built-in functions only.

Pass one scatters the records over buckets by seeded hashes and writes them with a number each. Pass two
sorts each bucket by a seeded hash of that number, by Spark's external sort, and numbers it behind the
buckets before it. Whole records go through both passes, their texts too. The shard depends on the key and
the shard count alone: the shard with the highest hash of (key, shard) wins, so one more shard takes rows
only into itself.

Defined results: a null key is a key like any other; a null text has no bytes; repeated rows and hot
keys are spread over the buckets of their shard by row number; an empty table gives no rows. The written
first pass makes a repeated task give the same places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quietwave.llm.common import Work

OVERHEAD = 8


def record_size(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def highest_hash(key: str, shards: int, seed: int) -> Column:
    """The shard whose hash with the key is highest."""
    weights = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), F.col(key)).alias("w"), F.lit(s).alias("s")) for s in range(shards)]
    return F.array_max(F.array(*weights))["s"]


def shuffle_into_shards(df: DataFrame, key: str, size: str, shards: int, seed: int = 11, bucket_bytes: int = 64 << 20,
                        shard: str = "shard", slot: str = "slot", grown: str | None = "grown_shard") -> DataFrame:
    """Adds shard, slot (gapless from 0 in each shard) and the shard under one more shard.

    A bucket holds about `bucket_bytes` of records; it is sorted, not gathered in memory. Rows come in order of
    shard and slot, in ranges of both.
    """
    spark, work = df.sparkSession, Work(df.sparkSession, "shards")
    total = df.agg(F.sum(size).alias("n")).first()["n"] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    columns = [c for c in df.columns if c not in (shard, slot, grown)]
    numbered = df.withColumn("_uid", F.monotonically_increasing_id())
    scattered = numbered.select(
        highest_hash(key, shards, seed).alias("_shard"), highest_hash(key, shards + 1, seed).alias("_grown"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "_uid"), F.lit(buckets)).cast("long").alias("_bucket"), "_uid", *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)])
    first = work.save(scattered, "first", "zstd")
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = first.groupBy("_shard", "_bucket").agg(F.count("*").alias("_n")).select(
        "_shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    mixed = Window.partitionBy("_shard", "_bucket").orderBy(F.xxhash64(F.lit(seed + 2), "_uid"), "_uid")
    placed = first.repartitionByRange("_shard", "_bucket").withColumn("_i", F.row_number().over(mixed) - 1).join(offsets, ["_shard", "_bucket"])
    return placed.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)], F.col("_shard").alias(shard),
        (F.col("_before") + F.col("_i")).cast("long").alias(slot), *([F.col("_grown").alias(grown)] if grown else []))


def write_shards(df: DataFrame, path: str, shard: str = "shard", slot: str = "slot", placed: bool = False) -> None:
    """One folder per shard, its rows in the order of their slots; a shard may span several range files.

    `placed` rows come straight from `shuffle_into_shards`: they lie in ranges already and are not exchanged again.
    """
    ranges = df if placed else df.repartitionByRange(shard, slot)
    ranges.sortWithinPartitions(shard, slot).write.option("compression", "zstd").partitionBy(shard).parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The records of written shards; the shard comes from the folder."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)
