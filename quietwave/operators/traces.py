"""Long and array forms of traces, gap filling, rotation, flattening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietwave.operators.ordering import ROWS_PER_CHUNK, running


def to_long(traces: DataFrame, keys: list[str], x: str = "x", i: str = "i") -> DataFrame:
    """One row per sample, 0-based position."""
    return traces.select(*keys, F.posexplode(x).alias(i, x))


def to_array(long: DataFrame, keys: list[str], i: str = "i", x: str = "x") -> DataFrame:
    """One row per trace.  A trace is bounded by its window length."""
    packed = F.array_sort(F.collect_list(F.struct(i, x)))
    return long.groupBy(*keys).agg(F.transform(packed, lambda s: s[x]).alias(x))


def fill_gaps(samples: DataFrame, keys: list[str], step: int, ts: str = "ts", x: str = "x",
              rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Merge pieces of a trace on a regular grid; gaps take the latest value.

    Pieces that agree at a slot merge; where they differ the slot is a gap.  Each
    sample fills the gap before it, so no grid is joined and a long trace is spread
    over many tasks.  Columns: keys, slot (ts // step), x, filled.
    """
    slots = samples.groupBy(*keys, F.floor(F.col(ts) / step).alias("slot")).agg(
        F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    known = slots.withColumn(x, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))).drop("_lo", "_hi")
    known = known.withColumn("_at", F.when(F.col(x).isNotNull(), F.col("slot")))
    before = running(known, ["slot"], {"_pslot": ("last", "_at"), "_px": ("last", x), "_seen": ("max", "slot")},
                     keys, before=True, rows_per_chunk=rows_per_chunk)
    first_gap = F.coalesce(F.col("_seen") + 1, F.col("slot"))
    gap = F.when(first_gap < F.col("slot"), F.transform(
        F.sequence(first_gap, F.col("slot") - 1),
        lambda s: F.struct(s.alias("slot"), F.col("_px").alias("x"), F.lit(True).alias("filled")),
    )).otherwise(F.array().cast("array<struct<slot:bigint,x:double,filled:boolean>>"))
    own = F.array(F.struct(
        F.col("slot"), F.coalesce(F.col(x), F.col("_px")).alias("x"), F.col(x).isNull().alias("filled")))
    out = before.select(*keys, F.explode(F.concat(gap, own)).alias("_r"))
    return out.select(*keys, "_r.slot", F.col("_r.x").alias(x), "_r.filled").where(F.col(x).isNotNull())


def rotate_horizontals(samples: DataFrame, keys: list[str], back_azimuth: str, north: str = "N", east: str = "E",
                       component: str = "component", x: str = "x") -> DataFrame:
    """Radial and transverse from both horizontals at each instant (back-azimuth in degrees)."""
    both = samples.where(F.col(component).isin(north, east)).groupBy(*keys).agg(
        F.max(F.when(F.col(component) == north, F.col(x))).alias("_n"),
        F.max(F.when(F.col(component) == east, F.col(x))).alias("_e"),
        F.max(back_azimuth).alias("_ba"),
    ).where("_n IS NOT NULL AND _e IS NOT NULL")
    ba = F.radians("_ba")
    return both.select(
        *keys,
        (-F.col("_e") * F.sin(ba) - F.col("_n") * F.cos(ba)).alias("radial"),
        (-F.col("_e") * F.cos(ba) + F.col("_n") * F.sin(ba)).alias("transverse"),
    )


def flatten_record(traces: DataFrame, record: list[str], order: str, length: int | None = None,
                   factor: str | None = None, x: str = "x") -> DataFrame:
    """Concatenate the traces of a record in `order`, cut to the length of the first one.

    With `factor` each trace is divided by its square root.  A record holds one row per
    station component, so its size is bounded by the network.
    """
    value = F.col(x) if factor is None else F.transform(x, lambda v: F.try_divide(v, F.sqrt(F.col(factor))))
    packed = traces.groupBy(*record).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("x")))).alias("_t"))
    common = F.size(F.col("_t")[0]["x"])
    if length is not None:
        common = F.least(common, F.lit(length))
    return packed.select(*record, F.flatten(F.transform("_t", lambda t: F.slice(t["x"], F.lit(1), common))).alias(x))


def stack_record(traces: DataFrame, record: list[str], station_order: str, component_order: str, length: int | None = None, x: str = "x") -> DataFrame:
    """As `flatten_record`, axes kept: an array over stations of arrays over components of traces."""
    def nested(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
        packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
        return rows.groupBy(*keys).agg(F.transform(packed, lambda t: t["v"]).alias(value))

    cut = traces if length is None else traces.withColumn(x, F.slice(x, 1, length))
    return nested(nested(cut, [*record, station_order], component_order, x), record, station_order, x)


def split_record(df: DataFrame, n_traces: int, x: str = "x") -> DataFrame:
    """The flat vector of a record as rows (trace, x)."""
    n = F.floor(F.size(x) / n_traces).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(n_traces - 1)), lambda k: F.slice(x, k * n + 1, n))
    keep = [c for c in df.columns if c != x]
    return df.select(*keep, F.posexplode(cut).alias("trace", x))


def arrival_slice(x: Column, arrival: Column, rate: float) -> Column:
    """Samples from max(0, (arrival-60) rate), 50 rate + 2 arrival rate of them."""
    start = F.greatest(F.lit(0.0), (arrival - 60) * rate).cast("int")
    count = (50 * rate + 2 * arrival * rate).cast("int")
    return F.slice(x, start + 1, count)


def order_by_arrival(stations: DataFrame, groups: list[str], arrival: str, descending: bool = False) -> DataFrame:
    """Add position: ascending (stacked view) or descending (moveout view) arrival.

    The stations of one event are few; events partition the work.
    """
    key = F.col(arrival).desc() if descending else F.col(arrival).asc()
    return stations.withColumn("position", F.row_number().over(Window.partitionBy(*groups).orderBy(key, "station")))


def normalise_by_observation(traces: DataFrame, observed: DataFrame, groups: list[str], x: str = "x") -> DataFrame:
    """Divide all traces of a group by the largest |observed| sample (1 when that is zero)."""
    top = observed.groupBy(*groups).agg(F.max(F.array_max(F.transform(x, lambda v: F.abs(v)))).alias("_top"))
    scale = F.when(F.col("_top") == 0, F.lit(1.0)).otherwise(F.col("_top"))
    return traces.join(top, groups).withColumn(x, F.transform(x, lambda v: v / scale)).drop("_top")


def offset_scale(traces: DataFrame, groups: list[str], x: str = "x") -> DataFrame:
    """Ten times the mean absolute sample per group."""
    sums = F.aggregate(F.col(x), F.lit(0.0), lambda a, v: a + F.abs(v))
    return traces.groupBy(*groups).agg((F.try_divide(F.sum(sums), F.sum(F.size(x)).cast("double")) * 10).alias("offset_scale"))
