import random

import pytest
from pyspark.sql import functions as F

from quietwave.operators import intervals as I
from quietwave.plans.quiet_noise import quiet_window_statistics


def frame(spark, rows):
    return spark.createDataFrame(rows, "s long, e long")


def merged(rows):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(r) for r in out]


CASES = {
    "none": [], "one": [(5, 9)], "touching": [(3, 4), (4, 5)], "nested": [(2, 20), (4, 6), (7, 30)],
    "before": [(-10, 3), (50, 60)], "past": [(80, 200)], "random": [(s, s + random.Random(s).randint(1, 9)) for s in range(0, 90, 4)],
}


@pytest.mark.parametrize("name", CASES)
def test_islands_and_quiet_regions_partition_the_range(spark, name):
    rows, t0, t1 = CASES[name], 0, 100
    islands = sorted(tuple(r) for r in I.merge_intervals(frame(spark, rows)).collect())
    assert islands == merged(rows)
    quiet = sorted(tuple(r) for r in I.quiet_regions(frame(spark, rows), t0, t1).collect())
    covered = set()
    for s, e in islands + quiet:
        cells = set(range(max(s, t0), min(e, t1)))
        assert not cells & covered
        covered |= cells
    assert covered == set(range(t0, t1))


def test_unclipped_regions_keep_the_plain_sweep(spark):
    quiet = sorted(tuple(r) for r in I.quiet_regions(frame(spark, [(-10, 3), (90, 130)]), 0, 100, clip=False).collect())
    assert quiet == [(0, -10), (3, 90), (130, 100)]


def test_chunked_sweep_equals_single_sweep(spark):
    rng = random.Random(2)
    rows = [(s, s + rng.randint(0, 40)) for s in (rng.randint(0, 20000) for _ in range(1500))]
    assert sorted(tuple(r) for r in I.merge_intervals(frame(spark, rows), rows_per_chunk=100).collect()) == merged(rows)


def test_window_end_is_strict_and_short_regions_give_none(spark):
    rows = [(0, 2 * 15 + 29), (1000, 1000 + 2 * 15 + 29 + 1), (5000, 5010)]
    got = [tuple(r)[2:] for r in I.sliding_windows(frame(spark, rows), 29, 15, 3).collect()]
    assert got == [(1015, 1044)]


def test_windows_follow_the_stepping_loop(spark):
    region, length, buffer, stride = (7, 20011), 290, 15, 11
    want, at = [], region[0] + buffer
    while at + length < region[1] - buffer:
        want.append((at, at + length))
        at += stride
    got = sorted(tuple(r)[2:] for r in I.sliding_windows(frame(spark, [region]), length, buffer, stride).collect())
    assert got == want


def test_same_day_drops_windows_across_midnight(spark):
    region = (I.DAY - I.HOUR, I.DAY + I.HOUR)
    got = I.sliding_windows(frame(spark, [region]), 30 * I.MINUTE, 0, 10 * I.MINUTE, same_day=True).collect()
    assert got and all(r["ws"] // I.DAY == r["we"] // I.DAY for r in got)


def test_pane_statistics_equal_the_window_join(spark):
    rng = random.Random(4)
    minute = I.MINUTE
    regions = frame(spark, [(0, 200 * minute), (300 * minute, 420 * minute)])
    samples = [("a" if i % 3 else "b", rng.choice([rng.randint(0, 420 * minute), rng.randint(0, 420) * minute]), rng.gauss(5, 2)) for i in range(2500)]
    df = spark.createDataFrame(samples, "station string, ts long, x double")
    length, stride, buffer = 29 * minute, 3 * minute, 15 * minute
    got = {(r["station"], r["ws"]): r for r in I.pane_statistics(df, regions, ["station"], length, stride, buffer, minute).collect()}
    windows = I.sliding_windows(regions, length, buffer, stride)
    want = I.cut_windows(df, windows, I.HOUR).groupBy("station", "ws").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance")).collect()
    direct = quiet_window_statistics(df, regions, ["station"], length, stride, buffer, None).collect()
    assert {(r["station"], r["ws"], r["n"]) for r in direct} == {(k[0], k[1], r["n"]) for k, r in got.items()}
    assert len(want) == len(got) > 50
    for w in want:
        g = got[(w["station"], w["ws"])]
        assert g["n"] == w["n"] and abs(g["mean"] - w["mean"]) < 1e-9 and abs(g["variance"] - w["variance"]) < 1e-9


def test_range_anti_join_against_brute_force(spark):
    rng = random.Random(9)
    windows = [(i, s, s + 500) for i, s in enumerate(rng.randint(0, 100000) for _ in range(300))]
    blackout = [(s, s + rng.randint(1, 900)) for s in (rng.randint(0, 100000) for _ in range(60))]
    got = {r["id"] for r in I.exclude_intervals(
        spark.createDataFrame(windows, "id int, ws long, we long"), ["id"], frame(spark, blackout), 10, bucket=1000).collect()}
    want = {i for i, s, e in windows if not any(s <= b + 10 and e >= a - 10 for a, b in blackout)}
    assert got == want


def test_long_padded_window_keeps_whole_days(spark):
    df = spark.createDataFrame([(0, 3 * I.DAY + I.SECOND)], "s long, e long")
    assert df.select(I.rounded_length("s", "e", 2.0)).first()[0] == 3 * 86400 + 2
    half, end = I.central_window("s", "e", I.DAY)
    row = df.select(half.alias("h"), end.alias("e2")).first()
    assert row["h"] == (2 * I.DAY + I.SECOND) // 2 and row["e2"] - row["h"] == I.DAY
