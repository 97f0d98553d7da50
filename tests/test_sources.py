import datetime

import pytest

from quietwave.operators.intervals import DAY
from quietwave.sources import catalogue as C
from quietwave.sources import layers as L
from quietwave.sources import records as R
from quietwave.sources import stations as S


def test_station_files_maps_and_networks(spark, tmp_path):
    (tmp_path / "stations.txt").write_text("# head\nAAA XX 1.5  -2.25 # note\n\n  BBB YY\t3 4\nCCC XX 5 6\n")
    found = {r["station"]: r for r in S.read_stations(spark, str(tmp_path / "stations.txt")).collect()}
    assert set(found) == {"AAA", "BBB", "CCC"} and found["AAA"]["lon"] == -2.25 and found["BBB"]["network"] == "YY"
    (tmp_path / "c.json").write_text('{"AAA": ["Z", "N"],\n "BBB": []}')
    (tmp_path / "s.json").write_text('{"AAA": 4}')
    stations = S.read_stations(spark, str(tmp_path / "stations.txt"))
    components = S.parse_component_map(S.read_json_documents(spark, str(tmp_path / "c.json")))
    shifts = S.parse_shift_map(S.read_json_documents(spark, str(tmp_path / "s.json")))
    ready = S.with_components(stations, components, shifts).collect()
    assert [(r["station"], r["components"], r["time_shift"]) for r in ready] == [("AAA", ["Z", "N"], 4)]
    assert [r["station"] for r in S.stations_without_components(stations, components).collect()] == ["CCC"]
    S.write_stations(stations, str(tmp_path / "out"))
    assert S.read_stations(spark, str(tmp_path / "out")).count() == 3


def test_catalogue_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Year,Month,Day,Time,Lat,Lon,Depth,Mag,Region,Timestamp\n2024,09,19,10:17:52,-5.6,82.6,10.9,5.1,\"SEA, EAST\",1\n")
    row = C.read_catalogue(spark, str(tmp_path / "c.csv")).first()
    want = datetime.datetime(2024, 9, 19, 10, 17, 52, tzinfo=datetime.timezone.utc).timestamp()
    assert row["ts"] == int(want * 1e6) and row["region"] == "SEA, EAST" and row["mag"] == 5.1


def test_models_in_line_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# h vp vs rho qp qs\n5.5 5.5 3.18 2.4 600 300\n10.5 6.3 3.64 2.67 600 300\n")
    (tmp_path / "b.txt").write_text("1 2 1 2 1 1\n")
    rows = sorted((r["model_id"], r["layer"], r["vp"]) for r in L.read_models(spark, str(tmp_path)).collect())
    assert rows == [("a.txt", 0, 5.5), ("a.txt", 1, 6.3), ("b.txt", 0, 2.0)]


def test_archive_reads_only_its_days_and_whole_stations(spark, tmp_path):
    rows = [(s, c, d * DAY + 1000, float(d)) for s in ("A", "B") for c in ("Z", "1", "2") for d in range(5) if not (s == "B" and c == "2" and d == 2)]
    R.write_archive(spark.createDataFrame(rows, "station string, channel string, ts long, x double"), str(tmp_path / "a"))
    found = R.read_archive(spark, str(tmp_path / "a"), 2 * DAY, 2 * DAY + 5000)
    assert {(r["station"], r["channel"]) for r in found.collect()} == {("A", "Z"), ("A", "1"), ("A", "2")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "jday" in plan.split("PartitionFilters: [")[1][:300]


def test_missing_truth_and_empty_ensemble_are_errors(spark, tmp_path):
    R.append_results(spark.createDataFrame([(1, "m", 0, 0, 1.0, None)], "event int, method string, sample_id int, pos int, value double, truth double"), str(tmp_path / "r"))
    bounds = spark.createDataFrame([(0, 0.0, 2.0)], "pos int, lo double, hi double")
    with pytest.raises(Exception, match="no truth"):
        R.collect_runs(spark, [str(tmp_path / "r")], ["m"], bounds).collect()
    spark.createDataFrame([], "id int").write.parquet(str(tmp_path / "e"))
    with pytest.raises(FileNotFoundError):
        R.read_ensemble(spark, str(tmp_path / "e"), required=True)


def test_archive_manifest_decides_and_the_archive_is_read_once(spark, tmp_path):
    day = 86_400_000_000
    rows = [(s, c, d * day + h * day // 24, 1.0) for s in "ab" for c in "Z12" for d in range(3) for h in range(24) if not (s == "b" and c == "2" and d == 1)]
    write = lambda rows, mode: R.write_archive(spark.createDataFrame(rows, "station string, channel string, ts long, x double"), str(tmp_path / "a"), mode)
    write([r for r in rows if r[2] < day], "errorifexists")
    write([r for r in rows if r[2] >= day], "append")
    one_day = R.read_archive(spark, str(tmp_path / "a"), day, 2 * day - 1)
    assert {r["station"] for r in one_day.select("station").distinct().collect()} == {"a"} and one_day.count() == 72
    plan = one_day._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema: struct<channel:string,ts:bigint,x:double>") == 1  # other scans are of the manifest
    # a range inside a day may fall into a gap: station b has no channel 2 there, and both have none between the hours
    within = R.read_archive(spark, str(tmp_path / "a"), 10 * day // 24 - 5, 11 * day // 24 + 5)
    assert within.count() == 12
    assert R.read_archive(spark, str(tmp_path / "a"), 10 * day // 24 + 5, 11 * day // 24 - 5).count() == 0
    assert R.read_archive(spark, str(tmp_path / "a"), day + 10 * day // 24 - 5, day + 11 * day // 24 + 5).select("station").distinct().collect()[0][0] == "a"
