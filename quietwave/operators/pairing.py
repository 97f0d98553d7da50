"""Joins: every-with-every against a bounded side, lookups, routes, noise pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwave.functions.draws import uniform
from quietwave.operators.ordering import ROWS_PER_CHUNK, ranked, running, with_totals

SMALL_SIDE_ROWS = 10_000


def with_every(left: DataFrame, right: DataFrame, limit: int = SMALL_SIDE_ROWS) -> DataFrame:
    """Each left row with each right row.

    A right side of at most `limit` rows (counted) becomes one array that is inlined
    row by row.  A larger one is cut into slices of about `limit` rows, and the left
    rows are sent to every slice by an equi join, so no task sees all of it.
    """
    rows = right.limit(limit + 1).count()
    if rows <= limit:
        packed = right.agg(F.collect_list(F.struct(*right.columns))).scalar()
        return left.withColumn("_every", packed).select(*left.columns, F.inline("_every"))
    slices = -(-right.count() // limit)
    sliced = right.withColumn("_slice", F.pmod(F.xxhash64(*right.columns), F.lit(slices)).cast("int"))
    spread = left.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(int(slices) - 1))))
    return spread.join(sliced, "_slice").drop("_slice")


def bracketed(left: DataFrame, table: DataFrame, at: str, columns: list[str], by: list[str] | None = None, key: str | None = None) -> DataFrame:
    """Adds `columns` of `table`, linear between its rows next below and above the value `at` of each left row.

    `table` has `by` columns (its bins), `key` (default: the name of `at`) on any grid, regular or not, each value
    once per bin, and the columns. Its segments are dealt to buckets as wide as their average, so the join is on
    equal bin and bucket: Spark broadcasts a small table, and sorts or splits otherwise. Left rows outside the
    grid, without a bin or with a null get nulls; so do columns that are null at either end of a segment.
    """
    by, key = list(by or []), key or at
    rows = table.select(*by, F.col(key).cast("double").alias("_a"), F.struct(F.col(key).cast("double").alias("_a"), *[F.col(c).cast("double").alias(c) for c in columns]).alias("_row")).where("_a IS NOT NULL")
    spans = rows.groupBy(*by).agg(F.min("_a").alias("lo"), F.max("_a").alias("hi"), F.count(F.lit(1)).alias("n"))
    size = spans.agg(F.max(F.col("hi") - F.col("lo")), F.avg("n")).first()
    width = (size[0] / size[1]) if size[0] else 1.0
    following = running(rows.withColumn("_down", -F.col("_a")), ["_down"], {"_next": ("last", "_row")}, by, before=True)
    end = F.coalesce(F.col("_next._a"), F.col("_a"))
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    dealt = following.select(*[F.col(b).alias(f"_t_{b}") for b in by], "_a", "_row", "_next", F.explode(F.sequence(bucket(F.col("_a")), bucket(end))).alias("_bucket"))
    named = left.withColumns({"_x": F.col(at).cast("double"), "_b": bucket(F.col(at).cast("double"))})
    inside = (F.col("_x") >= F.col("_a")) & ((F.col("_x") < F.col("_next._a")) | (F.col("_next").isNull() & (F.col("_x") == F.col("_a"))))
    same = [named[b].eqNullSafe(dealt[f"_t_{b}"]) for b in by]
    joined = named.join(dealt, [F.col("_b") == F.col("_bucket"), inside, *same], "left")
    share = (F.col("_x") - F.col("_a")) / (F.col("_next._a") - F.col("_a"))
    between = {c: F.when(F.col("_next").isNull(), F.col(f"_row.{c}")).otherwise(F.col(f"_row.{c}") + share * (F.col(f"_next.{c}") - F.col(f"_row.{c}"))) for c in columns}
    return joined.select(*left.columns, *[value.alias(c) for c, value in between.items()])


def arrivals(pairs: DataFrame, table: DataFrame, distance: str, by: list[str] | None = None, phases: list[str] | None = None, first_p: bool = False) -> DataFrame:
    """Add first and last arrival (seconds) of each pair, linear between the distances of `table`.

    `table` has columns distance and `by` (depth bin), and either first and last, or a column of travel times for
    each of `phases`, null where the phase does not arrive; `first_p` takes the phase P alone. Pairs beyond
    the table keep null arrivals, which later minima and maxima skip.
    """
    if first_p:
        phases = ["P"]
    if phases is None:
        return bracketed(pairs, table, distance, ["first", "last"], by, "distance")
    timed = bracketed(pairs, table.withColumnsRenamed({p: f"_phase_{p}" for p in phases}), distance, [f"_phase_{p}" for p in phases], by, "distance")
    times = [F.col(f"_phase_{p}") for p in phases]
    first, last = (times[0], times[0]) if len(times) == 1 else (F.least(*times), F.greatest(*times))
    return timed.withColumns({"first": first, "last": last}).drop(*[f"_phase_{p}" for p in phases])


def station_arrival(first: str = "first", offset: float = 60.0) -> Column:
    """Arrival used for slicing: first phase plus a fixed offset."""
    return F.col(first) + F.lit(offset)


def dense_index(df: DataFrame, order: list[str], name: str = "idx", rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """0-based dense index in `order`, distributed."""
    return ranked(df, order, name=name, rows_per_chunk=rows_per_chunk).withColumn(name, F.col(name) - 1)


def pair_with_noise(
    sims: DataFrame, noise: DataFrame, sim_id: str, noise_order: list[str], stream: str,
    fixed: int | None = None,
) -> DataFrame:
    """Each simulation with one noise record, drawn uniformly with replacement.

    `noise` must hold complete records only; `fixed` picks the same index for all.
    """
    indexed = dense_index(noise, noise_order, "noise_idx")
    if fixed is not None:
        one = indexed.where(F.col("noise_idx") == fixed)
        return with_totals(sims, one, [])
    size = noise.agg(F.count(F.lit(1))).scalar()
    return sims.withColumn("noise_idx", F.floor(uniform([sim_id], stream) * size)).join(indexed, "noise_idx")


def inject_noise(pairs: DataFrame, signal: str = "x", noise: str = "noise", out: str = "y") -> DataFrame:
    """observation = simulation + noise, sample by sample."""
    return pairs.withColumn(out, F.zip_with(signal, noise, lambda a, b: a + b))


def job_table(
    tests: DataFrame, real: DataFrame, noises: list[str], job: str = "job",
) -> DataFrame:
    """Test simulations and real events, each with every noise model.

    Real rows keep their covariance and prior columns; tests have nulls there.
    """
    names = F.explode(F.array(*[F.lit(n) for n in noises]))
    made = tests.withColumn("source", F.lit("simulated")).withColumn("noise", names)
    observed = real.withColumn("source", F.lit("real")).withColumn("noise", names)
    return made.unionByName(observed, allowMissingColumns=True)


def look_up_results(left: DataFrame, results: DataFrame,
                    key: tuple = ("event", "train_noise", "test_noise", "method")) -> DataFrame:
    """Results by composite key."""
    return left.join(results, list(key))


def route_stations(stations: DataFrame, models: DataFrame, order: str = "model_idx") -> DataFrame:
    """Stations with their owning model: the first by index when several own one."""
    owner = models.groupBy("station").agg(F.min_by(F.struct(*[c for c in models.columns if c != "station"]), order).alias("_o"))
    joined = stations.join(owner, "station")
    return joined.select(*stations.columns, "_o.*")


def uncovered(needed: DataFrame, covered: DataFrame, key: list[str]) -> DataFrame:
    """Stations (or station-components) that no model covers; must be empty."""
    return needed.join(covered.select(*key).distinct(), key, "left_anti")


def kernel_ids(pairs: DataFrame, group: list[str], distance_km: str) -> DataFrame:
    """1-based three-digit id of each distance rounded to 0.1 km, among the distinct ones of its group."""
    keyed = pairs.withColumn("dist", F.round(distance_km, 1))
    order = ranked(keyed.select(*group, "dist").distinct(), ["dist"], group, "_n")
    return keyed.join(order.withColumn("kernel", F.lpad(F.col("_n").cast("string"), 3, "0")).drop("_n"), [*group, "dist"])


def component_alias(component: str | Column) -> Column:
    """E to 1 and N to 2."""
    column = F.col(component) if isinstance(component, str) else component
    return F.translate(column, "EN", "12")


def look_up_component(wanted: DataFrame, traces: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Match station and component, else the alias of the component; `found` says which.

    Traces are matched once on the alias, where both spellings meet, and the exact
    spelling wins.
    """
    keys = keys or ["station"]
    offers = traces.groupBy(*keys, component_alias("component").alias("_alias")).agg(
        F.max(F.when(F.col("component") != component_alias("component"), F.struct("component", value))).alias("_raw"),
        F.max(F.when(F.col("component") == component_alias("component"), F.struct("component", value))).alias("_plain"),
    )
    joined = wanted.withColumn("_alias", component_alias("component")).join(offers, [*keys, "_alias"], "left")
    exact = F.when(F.col("_raw.component") == F.col("component"), F.col(f"_raw.{value}")).when(
        F.col("_plain.component") == F.col("component"), F.col(f"_plain.{value}"))
    alias = F.col(f"_plain.{value}")
    return joined.withColumns({
        value: F.coalesce(exact, alias),
        "found": F.when(exact.isNotNull(), "exact").when(alias.isNotNull(), "alias").otherwise("missing"),
    }).drop("_alias", "_raw", "_plain")


def zero_fill(traces: DataFrame, record: list[str], components: list[str], n: int,
              station: str = "station", component: str = "component", x: str = "x") -> DataFrame:
    """Every component of every station of a record; a missing trace is n zeros."""
    held = traces.groupBy(*record, station).agg(
        *[F.max(F.when(F.col(component) == c, F.col(x))).alias(f"_x{k}") for k, c in enumerate(components)]
    )
    return held.select(
        *record, station,
        F.explode(F.array(*[
            F.struct(F.lit(c).alias(component), F.coalesce(F.col(f"_x{k}"), F.array_repeat(F.lit(0.0), n)).alias(x))
            for k, c in enumerate(components)
        ])).alias("_t"),
    ).select(*record, station, f"_t.{component}", f"_t.{x}")


def pin_known(bounds: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Parameters sampled as 'uniform known' become constants at the truth of the job."""
    joined = bounds.join(truth.withColumnRenamed("value", "_truth"), keys, "left")
    known = (F.col("sampling") == "uniform known") & F.col("_truth").isNotNull()
    return joined.withColumns({
        "lo": F.when(known, F.col("_truth")).otherwise(F.col("lo")),
        "hi": F.when(known, F.col("_truth")).otherwise(F.col("hi")),
        "sampling": F.when(known, F.lit("constant")).otherwise(F.col("sampling")),
    }).drop("_truth")
