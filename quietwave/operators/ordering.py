"""Running aggregates and ranks over a total order, without a one-task window.

A window with no (or a hot) partition key sorts all its rows in one task.  Here the
order is cut into chunks of similar size at sampled key values; each chunk is a
window partition of its own and a small chunk summary carries the state across.
The sample only chooses where to cut, so results are exact for any sample.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

ROWS_PER_CHUNK = 1_000_000
CUT_SAMPLE = 4096
TREE_CUTS = 64
FEW_ROWS = 10_000
NEAR_CUTS = 24


def join_same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on equal keys, nulls equal to each other; the keys stand once. Without keys, `right` is one row."""
    if not keys:
        return left.crossJoin(right)
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [left[k].eqNullSafe(named[f"_r_{k}"]) for k in keys]
    return left.join(named, same).drop(*[f"_r_{k}" for k in keys])


def order_cuts(df: DataFrame, keys: list[str], rows_per_chunk: int = ROWS_PER_CHUNK) -> list[tuple]:
    """Sorted key tuples at which to cut the order; empty when one chunk is enough.

    A uniform sample of at most CUT_SAMPLE rows reaches the driver.  The largest
    random number among the kept rows also tells how many rows there are.
    """
    rows = (
        df.select(*keys).dropna().withColumn("_r", F.rand(17))
        .orderBy("_r").limit(CUT_SAMPLE).collect()
    )
    if not rows:
        return []
    total = len(rows) if len(rows) < CUT_SAMPLE else (len(rows) - 1) / max(rows[-1]["_r"], 1e-300)
    chunks = min(math.ceil(total / rows_per_chunk), len(rows))
    ordered = sorted(tuple(row[k] for k in keys) for row in rows)
    cuts = [ordered[len(ordered) * c // chunks] for c in range(1, chunks)]
    return sorted(set(cuts))


def _reaches(keys: list[str], cut: tuple) -> Column:
    """Lexicographic keys >= cut."""
    test = F.col(keys[-1]) >= F.lit(cut[-1])
    for key, value in reversed(list(zip(keys[:-1], cut[:-1]))):
        test = (F.col(key) > F.lit(value)) | ((F.col(key) == F.lit(value)) & test)
    return test


def chunk_of(keys: list[str], cuts: list[tuple]) -> Column:
    """Chunk number of a row: a balanced comparison tree, log2(chunks) deep."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(_reaches(keys, cuts[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(cuts))


def with_chunk(df: DataFrame, keys: list[str], cuts: list[tuple], out: str = "_chunk") -> DataFrame:
    """Add the chunk number: a comparison tree for few cuts, else a binary search in constant arrays.

    The search is one short column per halving, so thousands of cuts still compile.
    """
    if len(cuts) < TREE_CUTS:
        return df.withColumn(out, chunk_of(keys, cuts))
    size = 1 << len(cuts).bit_length()
    arrays = [
        F.array(*[F.lit(c[k]) for c in cuts], *[F.lit(None)] * (size - len(cuts))).cast(ArrayType(df.schema[key].dataType))
        for k, key in enumerate(keys)]
    columns = df.columns
    df = df.withColumn(out, F.lit(0))
    half = size // 2
    while half:
        at = F.col(out) + F.lit(half - 1)
        test = F.col(keys[-1]) >= arrays[-1][at]
        for key, values in reversed(list(zip(keys[:-1], arrays[:-1]))):
            test = (F.col(key) > values[at]) | ((F.col(key) == values[at]) & test)
        df = df.select(*columns, (F.col(out) + F.when(test, F.lit(half)).otherwise(F.lit(0))).alias(out))
        half //= 2
    return df


def searched_chunk(df: DataFrame, keys: list[str], cuts: list[tuple]) -> Column:
    """Chunk number by a binary search in one constant array: code of one size for any number of cuts.

    Keys compare as structs, nulls first.
    """
    if not cuts:
        return F.lit(0)
    own = F.struct(*keys)
    listed = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, cut)]) for cut in cuts]).cast(ArrayType(df.select(*keys).schema))
    halves = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(halves, F.lit(0), lambda at, half: at + F.when(F.get(listed, at + half - 1) <= own, half).otherwise(0))


def _aggregate(kind: str, value: str, keys: list[str]) -> Column:
    if kind == "count":
        return F.count(F.lit(1))
    if kind == "last":
        return F.max(F.when(F.col(value).isNotNull(), F.struct(*keys, F.col(value).alias("_v"))))["_v"]
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value)


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind in ("count", "sum"):
        total = F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
        return F.when(carry.isNull() & local.isNull(), F.lit(None)).otherwise(total)
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    return F.coalesce(local, carry)


def running(
    df: DataFrame,
    keys: list[str],
    wanted: dict[str, tuple],
    groups: list[str] | None = None,
    before: bool = False,
    rows_per_chunk: int = ROWS_PER_CHUNK,
    cuts: list[tuple] | None = None,
) -> DataFrame:
    """Add running aggregates in ascending `keys` order within `groups`.

    `wanted` maps a new column to (kind, value column) with kind one of sum, max,
    min, count, last (latest non-null).  `before=True` leaves out the current row.
    `keys` should identify rows, so that the order is total.  `cuts` reuses known cuts.
    """
    groups = list(groups or [])
    cuts = order_cuts(df, keys, rows_per_chunk) if cuts is None else cuts
    chunked = with_chunk(df, keys, cuts) if cuts else df
    frame_end = -1 if before else 0
    parts = groups + (["_chunk"] if cuts else [])
    window = (
        Window.partitionBy(*parts).orderBy(*keys).rowsBetween(Window.unboundedPreceding, frame_end)
    )

    def local(kind: str, value: str | None) -> Column:
        if kind == "last":
            return F.last(value, ignorenulls=True).over(window)
        if kind == "count":
            return F.count(F.lit(1)).over(window)
        return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value).over(window)

    out = chunked.withColumns({name: local(kind, value) for name, (kind, value) in wanted.items()})
    if not cuts:
        return out
    summary = chunked.groupBy(*parts).agg(
        *[_aggregate(kind, value, keys).alias(f"_s_{n}") for n, (kind, value) in wanted.items()]
    )
    earlier = (
        Window.partitionBy(*groups).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )

    def carried(name: str, kind: str) -> Column:
        column = f"_s_{name}"
        if kind == "last":
            return F.last(column, ignorenulls=True).over(earlier)
        if kind in ("count", "sum"):
            return F.sum(column).over(earlier)
        return {"max": F.max, "min": F.min}[kind](column).over(earlier)

    carry = summary.select(
        *[F.col(p).alias(f"_k_{p}") for p in parts],
        *[carried(n, kind).alias(f"_c_{n}") for n, (kind, _) in wanted.items()],
    )
    on = [F.col(p).eqNullSafe(F.col(f"_k_{p}")) for p in parts]
    joined = out.join(carry, on, "left")
    return joined.select(
        *df.columns,
        *[_combine(kind, F.col(f"_c_{n}"), F.col(n)).alias(n) for n, (kind, _) in wanted.items()],
    )


def with_totals(df: DataFrame, totals: DataFrame, groups: list[str]) -> DataFrame:
    """Each row with the totals of its group; without groups the one row of totals is a scalar."""
    if groups:
        return df.join(totals, groups)
    one = totals.select(F.struct("*")).scalar()
    return df.withColumn("_all", one).select(*df.columns, "_all.*")


def ranked(
    df: DataFrame, keys: list[str], groups: list[str] | None = None,
    name: str = "rank", rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """1-based position in ascending `keys` order within `groups`."""
    return running(df, keys, {name: ("count", None)}, groups, rows_per_chunk=rows_per_chunk)


def first_n(df: DataFrame, order: list[str], n: int, groups: list[str] | None = None, few: int = FEW_ROWS) -> DataFrame:
    """The first n rows by `order` (of each group), in no particular order; of equal rows at the end any.

    Up to `few` rows without groups go through Spark's own top-n. Otherwise the order is cut at sampled keys into
    chunks well below n rows. Chunks are counted; those wholly among the first n are kept as they are, and only
    the one in which the n-th row lies is ranked, in many tasks. So about n rows are kept and few more are ranked.
    """
    groups = list(groups or [])
    if n <= few and not groups:
        return df.orderBy(*order).limit(n)
    if n <= 0:
        return df.where(F.lit(False))
    columns = df.columns
    cuts = order_cuts(df, order, max(1, n // 8))
    # the n-th row lies near the eighth cut, those of larger groups further on: few cuts in all, close ones first
    cuts = cuts[:NEAR_CUTS] + cuts[NEAR_CUTS::max(1, len(cuts) // NEAR_CUTS)]
    chunked = df.withColumn("_chunk", searched_chunk(df, order, cuts))
    counts = chunked.groupBy(*groups, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    needed = counts.withColumn("_left", F.lit(n) - F.coalesce(F.sum("_n").over(earlier), F.lit(0))).where("_left > 0").select(
        *groups, "_chunk", "_left", (F.col("_left") >= F.col("_n")).alias("_whole"))
    kept = join_same(chunked, needed, [*groups, "_chunk"])
    part = ranked(kept.where("NOT _whole").withColumn("_tie", F.xxhash64(*columns)), [*order, "_tie"], groups, "_rank")
    return kept.where("_whole").select(*columns).unionByName(part.where("_rank <= _left").select(*columns))


def group_quantiles(
    df: DataFrame, groups: list[str], value: str, tie: str, quantiles: list[float],
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Exact linear-interpolation quantiles per group: columns q, value.

    Selects the two neighbouring ranks, so no group is ever held in one task.
    """
    live = df.select(*groups, value, tie).where(F.col(value).isNotNull() & ~F.isnan(value))
    ordered = ranked(live, [value, tie], groups, "_rank", rows_per_chunk)
    sizes = live.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    targets = sizes.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    targets = targets.withColumn("_pos", F.col("q") * (F.col("_n") - 1) + 1)
    targets = targets.withColumn("_lo", F.floor("_pos")).withColumn("_f", F.col("_pos") - F.col("_lo"))
    needed = targets.select(
        *groups, "q", "_f",
        F.explode(F.array(
            F.struct(F.col("_lo").alias("_rank"), (1 - F.col("_f")).alias("_w")),
            F.struct((F.col("_lo") + 1).alias("_rank"), F.col("_f").alias("_w")),
        )).alias("_t"),
    ).select(*groups, "q", "_t._rank", "_t._w").where("_w > 0")
    return (
        ordered.join(needed, [*groups, "_rank"])
        .groupBy(*groups, "q").agg(F.sum(F.col("_w") * F.col(value)).alias("value"))
    )
