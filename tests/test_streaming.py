import datetime

import pytest
from pyspark.sql import functions as F

from quietwave.streaming import live as L

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def put(spark, rows, path):
    spark.createDataFrame(rows, "station string, ts timestamp, x double").coalesce(1).write.mode("append").parquet(str(path))


def test_running_statistics_over_two_runs_equal_batch(spark, tmp_path):
    put(spark, [("a", at(i), float(i)) for i in range(20)], tmp_path / "in")
    for step in range(2):
        stream = L.file_stream(spark, str(tmp_path / "in"))
        L.write_latest(L.running_statistics(stream, ["station"], "x"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        if step == 0:
            put(spark, [("a", at(30), 100.0), ("b", at(31), 5.0)], tmp_path / "in")
    got = {r["station"]: r for r in L.read_latest(spark, str(tmp_path / "out"), ["station"]).collect()}
    want = {r["station"]: r for r in spark.read.parquet(str(tmp_path / "in")).groupBy("station").agg(F.count("x").alias("n"), F.stddev_pop("x").alias("sd")).collect()}
    for k in want:
        assert got[k]["n"] == want[k]["n"] and got[k]["sd"] == pytest.approx(want[k]["sd"])


def test_late_rows_are_dropped_and_only_full_windows_kept(spark, tmp_path):
    put(spark, [("a", at(i), 1.0) for i in range(0, 60)], tmp_path / "in")
    schema = None
    for step in range(3):
        stream = L.file_stream(spark, str(tmp_path / "in"))
        windows = L.live_windows(stream, "ts", ["station"], "x", "10 minutes", "5 minutes", "5 minutes", expected=10)
        schema = windows.schema
        L.write_files(windows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        if step == 0:
            put(spark, [("a", at(2), 50.0)], tmp_path / "in")  # far behind the watermark
        if step == 1:
            put(spark, [("a", at(i), 1.0) for i in range(60, 90)], tmp_path / "in")
    rows = spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()
    starts = [r["ws"] for r in rows]
    assert len(starts) == len(set(starts)) and all(r["n"] == 10 and r["mean"] == 1.0 for r in rows)
    first = int(START.timestamp() * 1e6)
    assert min(starts) == first and len(starts) >= 13


def test_each_result_reaches_the_sink_once(spark, tmp_path):
    put(spark, [("a", at(0), 1.0), ("a", at(1), 1.0), ("b", at(1), 2.0)], tmp_path / "in")
    for step in range(2):
        stream = L.file_stream(spark, str(tmp_path / "in"))
        L.append_stream(stream.select("station"), ["station"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        put(spark, [("b", at(5), 2.0), ("c", at(6), 3.0)], tmp_path / "in")
    got = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))
    assert sorted(r["station"] for r in got.collect()) == ["a", "b", "c"]


def test_moments_over_restarts_equal_batch_and_forget_silent_keys(spark, tmp_path):
    """Three micro-batches, each after a restart; a late row is dropped, a silent key is closed and comes back."""
    steps = [
        [("a", at(i), float(i)) for i in range(20)] + [("b", at(3), 1.0), ("b", at(4), None)],
        [("a", at(i), 100.0 + i) for i in range(200, 240)],
        [("a", at(1), 5e5), ("b", at(245), 9.0), ("a", at(250), 7.0)],  # the first is far behind the watermark
    ]
    for rows in steps:
        put(spark, rows, tmp_path / "in")
        stream = L.file_stream(spark, str(tmp_path / "in"))
        L.write_latest(L.running_moments(stream, "ts", ["station"], "x", "5 minutes", 60 * 60 * 1000), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["station"]: r for r in L.read_moments(spark, str(tmp_path / "out"), ["station"]).collect()}
    values = {"a": [float(i) for i in range(20)] + [100.0 + i for i in range(200, 240)] + [7.0], "b": [1.0, 9.0]}
    for k, v in values.items():
        assert got[k]["n"] == len(v) and got[k]["mean"] == pytest.approx(sum(v) / len(v))
        assert got[k]["sd"] == pytest.approx((sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v)) ** 0.5)
    raw = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))
    assert raw.where("station = 'b' AND closed").count() == 1 and raw.where("station = 'b'").select("epoch").distinct().count() == 2
