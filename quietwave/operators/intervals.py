"""Intervals and windows.  All instants are BIGINT microseconds since the epoch, UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwave.operators.ordering import ROWS_PER_CHUNK, join_same, order_cuts, running
from quietwave.session import materialise

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR
_BLOCK = 4096
_FOREVER = 2**63 - 1


def as_us(column: str | Column) -> Column:
    """Timestamp (with or without zone, read as UTC) to microseconds."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def as_timestamp(column: str | Column) -> Column:
    return F.timestamp_micros(column)


def blackout_per_event(
    pairs: DataFrame, event: list[str], origin: str, first: str, last: str
) -> DataFrame:
    """One interval per event: origin + earliest first arrival to origin + latest last arrival.

    Pairs without an arrival are skipped; an event with none at all has no interval.
    """
    return pairs.groupBy(*event).agg(
        (F.min(F.col(origin)) + F.min(F.round(F.col(first) * SECOND).cast("long"))).alias("s"),
        (F.min(F.col(origin)) + F.max(F.round(F.col(last) * SECOND).cast("long"))).alias("e"),
    ).where(F.col("s").isNotNull() & F.col("e").isNotNull())


def _swept(intervals: DataFrame, rows_per_chunk: int) -> tuple[DataFrame, list[tuple]]:
    """Unique starts with the largest end, and the largest end of everything earlier; also the cuts.

    The reduced intervals are written once: what they derive from (a catalogue against
    all stations) is then not computed again for the cuts, the summary and the sweep.
    """
    unique = materialise(intervals.groupBy("s").agg(F.max("e").alias("e")), "intervals")
    cuts = order_cuts(unique, ["s"], rows_per_chunk)
    return running(unique, ["s"], {"_before": ("max", "e")}, before=True, cuts=cuts), cuts


def merge_intervals(intervals: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Join overlapping or touching intervals (s, e): a new island iff start > running end."""
    swept, cuts = _swept(intervals, rows_per_chunk)
    swept = swept.withColumn(
        "_head", F.when(F.col("_before").isNull() | (F.col("s") > F.col("_before")), F.col("s"))
    )
    labelled = running(swept, ["s"], {"_island": ("last", "_head")}, cuts=cuts)
    return labelled.groupBy(F.col("_island").alias("s")).agg(F.max("e").alias("e"))


def quiet_regions(
    intervals: DataFrame, t0: int, t1: int, clip: bool = True,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """The complement of the intervals in [t0, t1], lead-in and lead-out included.

    Without intervals the whole range is one region.  `clip=False` keeps lead-in and
    lead-out as they fall, even when they lie outside the range or are inverted.
    """
    # one interval at the end of time: the gap before it is the lead-out
    end = intervals.sparkSession.range(1).select(F.lit(_FOREVER).alias("s"), F.lit(_FOREVER).alias("e"))
    swept, _ = _swept(intervals.select("s", "e").unionByName(end), rows_per_chunk)
    regions = swept.where(F.col("_before").isNull() | (F.col("s") > F.col("_before"))).select(
        F.coalesce("_before", F.lit(t0)).alias("s"), F.when(F.col("s") == _FOREVER, F.lit(t1)).otherwise(F.col("s")).alias("e")
    )
    if clip:
        regions = regions.select(
            F.greatest("s", F.lit(t0)).alias("s"), F.least("e", F.lit(t1)).alias("e")
        ).where("s < e")
    return regions


def sliding_windows(
    regions: DataFrame, length: int, buffer: int = 15 * MINUTE, stride: int | None = None,
    same_day: bool = False,
) -> DataFrame:
    """Windows (ws, we) from s+buffer by `stride` while ws+length < e-buffer, strictly.

    The default stride is the buffer; `same_day` keeps windows inside one date.
    """
    stride = buffer if stride is None else stride
    span = F.col("e") - F.lit(2 * buffer) - F.col("s") - F.lit(length)
    steps = F.ceil(span / F.lit(float(stride))).cast("long")
    blocks = (
        regions.withColumn("_n", steps).where("_n > 0")
        .withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(_BLOCK).cast("long"))))
    )
    windows = blocks.withColumn(
        "_k", F.explode(F.sequence("_b", F.least(F.col("_b") + (_BLOCK - 1), F.col("_n") - 1)))
    )
    out = windows.withColumn("ws", F.col("s") + F.lit(buffer) + F.col("_k") * F.lit(stride))
    out = out.withColumn("we", F.col("ws") + F.lit(length)).drop("_n", "_b", "_k")
    if same_day:
        out = out.where(F.floor(F.col("ws") / DAY) == F.floor(F.col("we") / DAY))
    return out


def day_windows(windows: DataFrame) -> DataFrame:
    """00:00:00 to 23:59:59 of every date that has a window."""
    days = windows.select(F.floor(F.col("ws") / DAY).alias("_d")).distinct()
    return days.select((F.col("_d") * DAY).alias("ds"), (F.col("_d") * DAY + (DAY - SECOND)).alias("de"))


def window_name(column: str = "ws") -> Column:
    """Name of a window: yyyy.MM.dd.HH.mm of its start."""
    return F.date_format(as_timestamp(column), "yyyy.MM.dd.HH.mm")


def rounded_length(start: str, end: str, step_seconds: float) -> Column:
    """Window length in seconds, rounded up to the sampling step; whole days are kept."""
    seconds = (F.col(end) - F.col(start)) / F.lit(float(SECOND))
    return F.ceil(seconds / F.lit(step_seconds)) * F.lit(step_seconds)


def central_window(start: str, end: str, length: int, fraction: float = 0.5) -> tuple[Column, Column]:
    """Window of `length` inside a padded one; `fraction` of the slack goes before it."""
    slack = F.col(end) - F.col(start) - F.lit(length)
    begin = F.col(start) + F.floor(slack * F.lit(fraction)).cast("long")
    return begin, begin + F.lit(length)


def _buckets(start: Column, end: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(start / size), F.floor(end / size)))


def windows_touching(
    windows: DataFrame, window_id: list[str], intervals: DataFrame, buffer: int = 0,
    bucket: int = HOUR,
) -> DataFrame:
    """Ids of windows that touch an interval widened by `buffer`: bucketed equi join."""
    islands = merge_intervals(
        intervals.select((F.col("s") - buffer).alias("s"), (F.col("e") + buffer).alias("e"))
    )
    left = windows.withColumn("_bucket", _buckets(F.col("ws"), F.col("we"), bucket))
    right = islands.withColumn("_bucket", _buckets(F.col("s"), F.col("e"), bucket))
    return (
        left.join(right.withColumnsRenamed({"s": "_s", "e": "_e"}), "_bucket")
        .where("ws <= _e AND we >= _s").select(*window_id).distinct()
    )


def exclude_intervals(
    windows: DataFrame, window_id: list[str], intervals: DataFrame, buffer: int = 0,
    bucket: int = HOUR,
) -> DataFrame:
    """Range anti join: windows that touch no interval."""
    touched = windows_touching(windows, window_id, intervals, buffer, bucket)
    return windows.join(touched, window_id, "left_anti")


def cut_windows(samples: DataFrame, windows: DataFrame, bucket: int, ts: str = "ts") -> DataFrame:
    """Every sample of every window it falls in (closed interval): bucketed equi join.

    The window side is one row per window and bucket; Spark broadcasts it while it
    is below its own size threshold and sort-merges (splitting skewed buckets) beyond.
    """
    left = samples.withColumn("_bucket", F.floor(F.col(ts) / bucket))
    right = windows.withColumn("_bucket", _buckets(F.col("ws"), F.col("we"), bucket))
    return left.join(right, "_bucket").where(
        (F.col(ts) >= F.col("ws")) & (F.col(ts) <= F.col("we"))
    ).drop("_bucket")


def pane_statistics(
    samples: DataFrame, regions: DataFrame, keys: list[str], length: int, stride: int,
    buffer: int, pane: int, bucket: int = HOUR, ts: str = "ts", value: str = "x",
) -> DataFrame:
    """Count, mean and population variance per sliding window and `keys`.

    Samples are first reduced to panes: each belongs to one quiet region, hence to one
    pane, so rows are not multiplied by the overlap of the windows.  `pane` must divide
    the length and the stride.  Windows are closed: a sample exactly at a window end is
    the start edge of the pane after it and is kept as a statistic of its own.
    """
    if length % pane or stride % pane:
        raise ValueError("pane must divide the window length and the stride")
    live = regions.where(F.col("e") - F.lit(2 * buffer) - F.col("s") > length)
    within = live.withColumn("_bucket", _buckets(F.col("s"), F.col("e"), bucket))
    placed = (
        samples.withColumn("_bucket", F.floor(F.col(ts) / bucket)).join(within, "_bucket")
        .withColumn("_off", F.col(ts) - F.col("s") - F.lit(buffer))
        .where((F.col("_off") >= 0) & (F.col(ts) <= F.col("e") - F.lit(buffer)))
    )
    edge = F.pmod(F.col("_off"), F.lit(pane)) == 0
    panes = placed.groupBy(*keys, "s", "e", F.floor(F.col("_off") / pane).alias("_pane")).agg(
        F.count(value).alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"),
        F.count(F.when(edge, F.col(value))).alias("_n0"),
        F.avg(F.when(edge, F.col(value))).alias("_m0"), F.var_pop(F.when(edge, F.col(value))).alias("_v0"),
    )
    # sums are taken about the least pane mean of the region, so an offset does not cancel the spread
    own = [*keys, "s", "e"]
    panes = join_same(panes, panes.groupBy(*own).agg(F.min("_m").alias("_c")), own)
    per, step = length // pane, stride // pane
    last = F.ceil((F.col("e") - F.lit(2 * buffer) - F.col("s") - F.lit(length)) / F.lit(float(stride))) - 1
    low = F.greatest(F.lit(0), F.ceil((F.col("_pane") - per) / F.lit(float(step))))
    high = F.least(last, F.floor(F.col("_pane") / step))
    spread = panes.where(low <= high).withColumn("_k", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    at_end = F.col("_pane") == F.col("_k") * step + per
    parts = spread.select(
        *keys,
        (F.col("s") + F.lit(buffer) + F.col("_k") * F.lit(stride)).alias("ws"),
        "_c",
        F.when(at_end, F.col("_n0")).otherwise(F.col("_n")).alias("n"),
        (F.when(at_end, F.col("_m0")).otherwise(F.col("_m")) - F.col("_c")).alias("_d"),
        F.when(at_end, F.col("_v0")).otherwise(F.col("_v")).alias("_v"),
    )
    sums = parts.groupBy(*keys, "ws", "_c").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("_d")).alias("_t"),
        F.sum(F.col("n") * (F.col("_v") + F.col("_d") * F.col("_d"))).alias("_q"))
    shift = F.col("_t") / F.col("n")
    return sums.where("n > 0").select(
        *keys, "ws", "n", (F.col("_c") + shift).alias("mean"), (F.col("ws") + F.lit(length)).alias("we"),
        F.greatest(F.lit(0.0), F.col("_q") / F.col("n") - shift * shift).alias("variance"))
