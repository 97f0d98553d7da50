"""Streaming forms: files arrive in parts, the stream is restarted after each, and the sink is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietwave.operators.intervals import as_us
from quietwave.session import fresh_path
from quietwave.streaming import live as L
from workbook.registry import R, query, rnd, table

MIN = 60_000_000


PARTS = 3


def fed(spark, sf_dir, columns, start):
    """Events arrive in three parts in order of time; after each the stream starts again from its checkpoint.

    `start` makes the query of a stream. So every entry sees three micro-batches and two restarts.
    """
    events = table(spark, sf_dir, "events")
    instant = as_us("ts")
    first, last = events.agg(F.min(instant), F.max(instant)).first()
    place = fresh_path(spark, "arriving")
    part = F.floor((instant - first) * PARTS / (last - first + 1)).cast("int")
    for number in range(PARTS):
        events.where(part == number).write.mode("append").parquet(place)
        start(spark.readStream.schema(events.schema).parquet(place).select(*columns)).awaitTermination()


@query("incremental_noise_statistics", f"SELECT user_id % 10 AS station, event_type AS component, count(value) AS n, {R('avg(value)', 5)} AS mean, {R('stddev_pop(value)', 5)} AS sd FROM events GROUP BY 1, 2")
def incremental_noise_statistics(spark, sf_dir):
    keys, path, checkpoint = ["station", "component"], fresh_path(spark, "running"), fresh_path(spark, "checkpoint")
    columns = [(F.col("user_id") % 10).alias("station"), F.col("event_type").alias("component"), "ts", "value"]
    # a key that is silent for two hours is closed and merged when read
    fed(spark, sf_dir, columns, lambda s: L.write_latest(L.running_moments(s, "ts", keys, "value", "60 minutes", 120 * MIN // 1000), path, checkpoint))
    return L.read_moments(spark, path, keys).select(*keys, "n", rnd("mean", 5).alias("mean"), rnd("sd", 5).alias("sd"))


@query("live_sliding_windows", f"""WITH m AS (SELECT max(epoch_us(ts)) - {60 * MIN} AS mark FROM events), w AS (SELECT user_id % 10 AS station, value, unnest(generate_series((epoch_us(ts) - {29 * MIN}) // {3 * MIN} + 1, epoch_us(ts) // {3 * MIN})) * {3 * MIN} AS ws FROM events)
SELECT station, ws, ws + {29 * MIN} AS we, count(*) AS n, {R('avg(value)', 5)} AS mean, {R('stddev_pop(value)', 5)} AS sd FROM w, m WHERE ws + {29 * MIN} <= mark GROUP BY 1, 2 HAVING count(*) = 2""")
def live_sliding_windows(spark, sf_dir):
    path, checkpoint = fresh_path(spark, "windows"), fresh_path(spark, "checkpoint")
    windows = lambda s: L.live_windows(s, "ts", ["station"], "value", "29 minutes", "3 minutes", "60 minutes", expected=2)
    fed(spark, sf_dir, [(F.col("user_id") % 10).alias("station"), "ts", "value"], lambda s: L.write_files(windows(s), path, checkpoint))
    w = spark.read.schema("ws long, we long, station long, n long, mean double, sd double").parquet(path)
    return w.select("station", "ws", "we", "n", rnd("mean", 5).alias("mean"), rnd("sd", 5).alias("sd"))


def _queue(spark, sf_dir):
    """Each (event, method) of a day once: repeats come within a day, and keys are forgotten a day after."""
    path, checkpoint = fresh_path(spark, "queue"), fresh_path(spark, "checkpoint")
    columns = [F.col("user_id").alias("event"), F.col("event_type").alias("method"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts"]
    fed(spark, sf_dir, columns, lambda s: L.append_stream(s, ["event", "method", "day"], path, checkpoint, ts="ts", late="1 day"))
    return spark.read.option("recursiveFileLookup", "true").schema("event long, method string, day string").parquet(path)


@query("result_queue_daily", "SELECT user_id AS event, event_type AS method, strftime(ts, '%Y-%m-%d') AS day, count(*) - count(*) + 1 AS n FROM events GROUP BY 1, 2, 3")
def result_queue_daily(spark, sf_dir):
    return _queue(spark, sf_dir).groupBy("event", "method", "day").agg(F.count(F.lit(1)).alias("n"))


@query("result_queue_to_sink", "SELECT DISTINCT user_id AS event, event_type AS method FROM events")
def result_queue_to_sink(spark, sf_dir):
    return _queue(spark, sf_dir).select("event", "method").distinct()
