"""Filters, gates and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietwave.functions.angles import distance_degrees
from quietwave.functions.draws import uniform
from quietwave.operators.ordering import ROWS_PER_CHUNK, first_n, ranked

VARIANCE_FLOOR = 1e-30


def standard_channel(channel: str, station_has_n: str | None = None) -> Column:
    """Component letter of a channel: 1 is E and 2 is N where the station has an N channel."""
    last = F.substring(F.col(channel), -1, 1)
    if station_has_n is None:
        return last
    return F.when(F.col(station_has_n) & (last == "1"), "E").when(
        F.col(station_has_n) & (last == "2"), "N").otherwise(last)


def output_component(channel: str) -> Column:
    """Z, 1 or 2: Z anywhere in the name, then 1 or a final E, then 2 or a final N."""
    c = F.col(channel)
    last = F.substring(c, -1, 1)
    return (
        F.when(c.contains("Z"), "Z").when(c.contains("1") | (last == "E"), "1")
        .when(c.contains("2") | (last == "N"), "2")
    )


def time_slice(samples: DataFrame, t0: int, t1: int, ts: str = "ts") -> DataFrame:
    """Samples with t0 <= ts <= t1."""
    return samples.where(F.col(ts).between(t0, t1))


def finished_day_windows(windows: DataFrame, names: DataFrame, day_us: int, name: str = "name", ws: str = "ws") -> DataFrame:
    """Windows of the days that already have outputs; `names` start with yyyy.MM.dd."""
    days = names.select(
        F.unix_micros(F.to_timestamp(F.substring(name, 1, 10), "yyyy.MM.dd")).alias("_day")
    ).distinct()
    return windows.withColumn("_day", F.floor(F.col(ws) / day_us) * day_us).join(days, "_day", "left_semi").drop("_day")


def length_gate(counts: DataFrame, window: list[str], n: int, count: str = "n") -> DataFrame:
    """Windows in which every trace has exactly n samples."""
    return counts.groupBy(*window).agg(F.bool_and(F.col(count) == n).alias("_ok")).where("_ok").drop("_ok")


def window_verdicts(traces: DataFrame, window: list[str], components: int = 3) -> DataFrame:
    """First failing reason per window, null when it is clean.

    `traces` has station, component, n, variance.  Stations are checked in name order,
    first for their components and data, then all of them for their variance.
    """
    per_station = traces.groupBy(*window, "station").agg(
        F.countDistinct("component").alias("_c"), F.max("n").alias("_top"), F.min("n").alias("_low"),
        F.min("variance").alias("_v"),
    )
    shape = F.when(F.col("_c") != components, "comp").when(F.col("_top") == 0, "empty").when(F.col("_low") == 0, "no data")
    flat = F.when(F.col("_v") <= VARIANCE_FLOOR, "variance")

    def fault(stage: int, reason: Column) -> Column:
        return F.when(reason.isNotNull(), F.struct(F.lit(stage).alias("stage"), F.col("station"), reason.alias("reason")))

    first = F.min(F.least(fault(0, shape), fault(1, flat)))
    return per_station.groupBy(*window).agg(first.alias("_f")).select(
        *window, F.when(F.col("_f").isNotNull(), F.concat_ws(" ", "_f.station", "_f.reason")).alias("reason")
    )


def available_stations(
    samples: DataFrame, t0: int, t1: int, buffer: int, components: int = 3, ts: str = "ts",
) -> DataFrame:
    """Stations with all components present over the event window widened by the buffer."""
    inside = time_slice(samples, t0 - buffer, t1 + buffer, ts)
    return inside.groupBy("station").agg(F.countDistinct("component").alias("_c")).where(
        F.col("_c") == components).drop("_c")


def select_catalogue(
    catalogue: DataFrame, lat: float, lon: float, t0: int, t1: int,
    far_radius: float = 15, far_magnitude: float = 6.0, near_radius: float = 15, near_magnitude: float = 4,
) -> DataFrame:
    """Far strong events and near events of a time range; adds degrees and part (far, near)."""
    strong = F.col("mag") >= min(far_magnitude, near_magnitude)
    ranged = catalogue.where(F.col("ts").between(t0, t1) & strong).withColumn(
        "degrees", distance_degrees(F.lit(float(lat)), F.lit(float(lon)), F.col("lat"), F.col("lon")))
    far = (F.col("degrees") >= far_radius) & (F.col("mag") >= far_magnitude)
    near = (F.col("degrees") <= near_radius) & (F.col("mag") >= near_magnitude)
    # an event on both sides of the radius counts in both parts, as in a union; one scan
    parts = F.array_compact(F.array(F.when(far, F.lit("far")), F.when(near, F.lit("near"))))
    return ranged.withColumn("part", F.explode(parts))


def drop_bad_compressions(df: DataFrame, truth: str, estimate: str, factor: float = 100.0, signed: bool = False) -> DataFrame:
    """Keep rows whose mean |c-t|/|t| over the parameters is below `factor`.

    `signed=True` divides by t itself.  A zero truth gives an infinite error: dropped.
    """
    def error(t: Column, c: Column) -> Column:
        bottom = t if signed else F.abs(t)
        return F.when(t == 0, F.lit(float("inf"))).otherwise(F.abs(c - t) / F.when(t != 0, bottom))

    errors = F.zip_with(F.col(truth), F.col(estimate), error)
    mean = F.aggregate(errors, F.lit(0.0), lambda a, v: a + v) / F.size(truth)
    return df.where(mean < factor)


def split_by_name(df: DataFrame, name: str, train_share: float = 0.9, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add part: the first int(share*n) rows by name train, the rest validate."""
    size = df.agg(F.count(F.lit(1))).scalar()
    order = ranked(df, [name], name="_rank", rows_per_chunk=rows_per_chunk)
    return order.withColumn(
        "part", F.when(F.col("_rank") <= F.floor(size * F.lit(train_share)), "train").otherwise("validate")
    ).drop("_rank")


def random_subset(df: DataFrame, groups: list[str], row_id: list[str], n: int, stream: str) -> DataFrame:
    """n rows per group in a reproducible shuffled order; each task keeps n per group first."""
    order = Window.partitionBy(*groups).orderBy("_u", *row_id)
    return (
        df.withColumn("_u", uniform(row_id, stream)).withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= n).drop("_u", "_rank")
    )


def within_extents(df: DataFrame, extents: dict[str, tuple[float, float]]) -> DataFrame:
    """Strictly lower < x < upper for each named parameter."""
    for name, (lo, hi) in extents.items():
        df = df.where((F.col(name) > lo) & (F.col(name) < hi))
    return df


def match_methods(results: DataFrame, keys: list[str], method: str = "method") -> DataFrame:
    """Rows with the key their method contains; with several such keys only an exact one stays."""
    known = F.array(*[F.lit(k) for k in keys])
    hits = F.filter(known, lambda k: F.col(method).contains(k))
    kept = F.when(F.size(hits) > 1, F.filter(hits, lambda k: k == F.col(method))).otherwise(hits)
    return results.withColumn("key", F.explode(kept))


def inside_prior_box(draws: DataFrame, bounds: dict[str, tuple[float, float]], n: int, order: str, **way) -> DataFrame:
    """The first n draws by `order` that lie strictly inside the location box."""
    return first_n(within_extents(draws, bounds), [order], n, **way)


def trace_lengths(long: DataFrame, keys: list[str], expected: int | None = None) -> DataFrame:
    """Samples per trace, with `ok` = equal to the expected (or to each other's) length."""
    counts = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    wanted = F.lit(expected) if expected is not None else counts.agg(F.min("n")).scalar()
    return counts.withColumn("ok", F.col("n") == wanted)


def vector_length(duration: float, rate: float) -> int:
    """Samples of one trace: int(duration * rate) + 1."""
    return int(duration * rate) + 1
