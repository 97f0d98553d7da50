"""Structured Streaming forms of the incremental flows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quietwave.operators.noise import merge_moments

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; the schema is read once from what is there."""
    schema = spark.read.option("pathGlobFilter", glob or "*.parquet").parquet(path).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob or "*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def running_statistics(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean and population deviation per key, to be written in update or complete mode."""
    return stream.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


class Moments(StatefulProcessor):
    """Count, mean and sum of squares about the mean of each key, merged batch by batch.

    A key that has been silent for `keep` milliseconds of event time is closed: its last state goes out
    once more and is forgotten, so the state holds the keys of that span only. A key that comes back
    starts a new epoch, named by its first instant.
    """

    def __init__(self, keys: list[str], keep: int):
        self.keys, self.keep = keys, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("moments", "n long, mean double, m2 double, epoch long, timer long")

    def _row(self, key: tuple, state: tuple, closed: bool) -> pd.DataFrame:
        n, mean, m2, epoch, _ = state
        return pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key, strict=True)}, "epoch": [epoch], "n": [n], "mean": [mean], "m2": [m2], "closed": [closed]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, mean, m2, epoch, timer = self.state.get() if self.state.exists() else (0, 0.0, 0.0, None, None)
        last = 0
        for part in rows:
            instants = part["event_time"].to_numpy("datetime64[ms]").astype(np.int64)
            last, epoch = max(last, int(instants.max())), int(instants.min()) if epoch is None else epoch
            values = part["sample_value"].dropna().to_numpy(float)
            if len(values):
                own, both = values.mean(), n + len(values)
                m2 += ((values - own) ** 2).sum() + (own - mean) ** 2 * n * len(values) / both
                mean += (own - mean) * len(values) / both
                n = both
        until = max(last + self.keep, timer or 0)
        if timer != until:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(until)
        state = (n, float(mean), float(m2), epoch, until)
        self.state.update(state)
        yield self._row(key, state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.state.get()
        self.state.clear()
        yield self._row(key, state, True)

    def close(self) -> None:
        pass


def running_moments(stream: DataFrame, ts: str, keys: list[str], value: str, late: str, keep_ms: int) -> DataFrame:
    """Moments of each key after every micro-batch, for `write_latest`; rows behind the watermark are dropped.

    Columns: keys, epoch, n, mean, m2, closed; the newest row of each (key, epoch) counts, see `read_moments`.
    Keys may not be null. Null values are not counted.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    # Spark renames columns with a leading underscore on their way to the processor
    timed = stream.select(*keys, F.col(ts).cast("timestamp").alias("event_time"), F.col(value).cast("double").alias("sample_value")).withWatermark("event_time", late)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in timed.select(*keys).schema.fields)
    return timed.groupBy(*keys).transformWithStateInPandas(
        Moments(keys, keep_ms), f"{fields}, epoch long, n long, mean double, m2 double, closed boolean", "Update", "EventTime")


def read_moments(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """n, mean and population deviation per key: its newest state and its closed epochs merged."""
    epochs = read_latest(spark, path, [*keys, "epoch"])
    return merge_moments(epochs.where("n > 0").select(*keys, "n", "mean", "m2"), keys)


def live_windows(stream: DataFrame, ts: str, keys: list[str], value: str, length: str, stride: str, late: str,
                 expected: int | None = None) -> DataFrame:
    """Sliding windows on a live record: count, mean and deviation once the watermark passes.

    Rows later than the watermark are dropped; with `expected` only full windows stay.
    """
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    stats = timed.groupBy(F.window("_ts", length, stride).alias("_w"), *keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    if expected is not None:
        stats = stats.where(F.col("n") == expected)
    return stats.select(F.unix_micros("_w.start").alias("ws"), F.unix_micros("_w.end").alias("we"), *keys, "n", "mean", "sd")


def write_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-mode file sink over all that is available now."""
    return stream.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def write_latest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Update-mode sink: every micro-batch adds its changed rows under its batch id."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.outputMode("update").foreachBatch(save).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest state of each key written by `write_latest`."""
    frame = spark.read.option("recursiveFileLookup", "true").parquet(path)
    rest = [c for c in frame.columns if c not in keys]
    newest = F.max_by(F.struct(*[c for c in rest if c != "batch_id"]), "batch_id")
    return frame.groupBy(*keys).agg(newest.alias("_s")).select(*keys, "_s.*")


def append_stream(stream: DataFrame, key: list[str], path: str, checkpoint: str, ts: str | None = None, late: str = "1 hour") -> StreamingQuery:
    """Results to a growing table, each key once, exactly once per micro-batch.

    With an event time the remembered keys are forgotten behind the watermark.
    """
    if ts is not None:
        unique = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark(key).drop("_ts")
    else:
        unique = stream.dropDuplicates(key)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return unique.writeStream.outputMode("append").foreachBatch(save).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
