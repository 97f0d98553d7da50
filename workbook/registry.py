"""Query registry and the adapters that read driver tables as waveform tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietwave.operators.intervals import as_us

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register a query; `check` is the same result as DuckDB SQL."""
    def keep(function):
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = function
        if check is not None:
            CHECKS[name] = check
        return function

    return keep


@lru_cache(maxsize=64)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; footers are read once per session, whose clock is set to UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def R(expression: str, digits: int = 6) -> str:
    """SQL: rounded double without negative zero."""
    return f"(round(({expression})::DOUBLE, {digits}) + 0.0::DOUBLE)"


def rnd(column: str | Column, digits: int = 6) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def uniform_sql(keys: str, stream: str, start: int = 1) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', {keys}, '{stream}')), {start}, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


def normal_sql(keys: str, stream: str) -> str:
    a, b = uniform_sql(keys, stream), uniform_sql(keys, stream, 14)
    return f"(sqrt(-2.0 * ln({a})) * cos(2.0 * pi() * {b}))"


# --- adapters, Spark side and SQL side -------------------------------------------

T0, T1 = 1704067200000000, 1706659200000000  # 2024-01-01 and 2024-01-31, the span of the samples
COMPONENTS = ["Z", "1", "2"]


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("ens"), F.col("embedding").cast("array<double>").alias("x"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces with a station (ensemble) and a component."""
    pick = F.array(*[F.lit(c) for c in COMPONENTS])
    return traces(spark, sf_dir).select(
        "id", F.col("ens").alias("station"), pick[F.pmod("id", F.lit(3)).cast("int")].alias("component"), "x")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    component = F.when(F.col("event_type") == "view", "Z").when(F.col("event_type") == "click", "2").when(F.col("event_type") == "error", "1")
    return e.where(F.col("event_type").isin("view", "click", "error")).select(
        (F.col("user_id") % 10).alias("station"), component.alias("component"), as_us("ts").alias("ts"), F.col("value").alias("x"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where(F.col("event_type").isin("purchase", "signup")).select(
        "event_id", as_us("ts").alias("ts"), (F.col("value") / 100).alias("mag"), (F.col("value") / 10).alias("depth"),
        ((F.col("user_id") * 37 % 1200) / 10 - 60).alias("lat"), ((F.col("user_id") * 61 % 3600) / 10 - 180).alias("lon"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("station")).distinct()
    return e.select("station", F.lit("QW").alias("network"), (30 + F.col("station") * 1.5).alias("lat"), (-120 + F.col("station") * 2.5).alias("lon"))


def travel_times(spark: SparkSession) -> DataFrame:
    d = F.col("id").cast("double")
    return spark.range(0, 181).select(d.alias("distance"), (10 * d - 0.02 * d * d).alias("first"), (20 * d + 60).alias("last"))


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select("id", "ens", *[(F.col("x")[k] * 1e16).alias(f"m{k + 1}") for k in range(6)])


def tensor_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensors(spark, sf_dir).groupBy("ens").agg(*[F.avg(f"m{k}").alias(f"m{k}") for k in range(1, 7)])


P, N = 6, 58


def sims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select("id", "ens", F.slice("x", 1, P).alias("theta"), F.slice("x", P + 1, N).alias("d"))


def gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (i, g, v, d0) derived from all simulations."""
    long = sims(spark, sf_dir).select("theta", F.posexplode("d").alias("i", "v"))
    return long.groupBy("i").agg(
        F.array(*[F.sum(F.col("theta")[a] * F.col("v")) for a in range(P)]).alias("g"),
        F.var_pop("v").alias("_v"), F.avg("v").alias("d0")).select("i", "g", F.col("_v").alias("v"), "d0")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    lines = table(spark, sf_dir, "lineitem")
    # a model has few layers, so a plain window numbers them: one exchange, and a sort that may spill
    order = Window.partitionBy("l_orderkey").orderBy(*[F.asc_nulls_last(c) for c in ("l_linenumber", *rest)])
    ordered = lines.select("l_orderkey", "l_linenumber", *rest).withColumn("_k", F.row_number().over(order))
    return ordered.select(
        F.col("l_orderkey").alias("model"), (F.col("_k") - 1).cast("int").alias("layer"), F.col("l_quantity").alias("thickness"),
        (F.lit(5.0) + F.col("l_discount") * 20).alias("vp"), (F.lit(3.0) + F.col("l_tax") * 20).alias("vs"))


_CTE = {
    "tr": "SELECT vec_id AS id, label AS ens, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings",
    "lg": "SELECT id, ens, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM tr",
    "rec": "SELECT id, ens AS station, (['Z','1','2'])[1 + id % 3] AS component, x FROM tr",
    "rl": "SELECT id, station, component, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM rec",
    "samples": "SELECT user_id % 10 AS station, CASE event_type WHEN 'view' THEN 'Z' WHEN 'click' THEN '2' ELSE '1' END AS component, "
               "epoch_us(ts) AS ts, value AS x FROM events WHERE event_type IN ('view', 'click', 'error')",
    "catalogue": "SELECT event_id, epoch_us(ts) AS ts, value / 100 AS mag, value / 10 AS depth, (user_id * 37 % 1200) / 10::DOUBLE - 60 AS lat, "
                 "(user_id * 61 % 3600) / 10::DOUBLE - 180 AS lon FROM events WHERE event_type IN ('purchase', 'signup')",
    "stations": "SELECT DISTINCT user_id % 10 AS station, 30 + (user_id % 10) * 1.5::DOUBLE AS lat, -120 + (user_id % 10) * 2.5::DOUBLE AS lon FROM events",
    "travel": "SELECT d::DOUBLE AS distance, 10 * d::DOUBLE - 0.02 * d::DOUBLE * d::DOUBLE AS first, 20 * d::DOUBLE + 60 AS last "
              "FROM generate_series(0, 180) t(d)",
    "mt": "SELECT id, ens, x[1]*1e16 AS m1, x[2]*1e16 AS m2, x[3]*1e16 AS m3, x[4]*1e16 AS m4, x[5]*1e16 AS m5, x[6]*1e16 AS m6 FROM tr",
    "truth": "SELECT ens, avg(m1) AS m1, avg(m2) AS m2, avg(m3) AS m3, avg(m4) AS m4, avg(m5) AS m5, avg(m6) AS m6 FROM mt GROUP BY ens",
    "sims": "SELECT id, ens, x[1:6] AS theta, x[7:64] AS d FROM tr",
    "sl": "SELECT id, ens, theta, unnest(d) AS v, generate_subscripts(d, 1) - 1 AS i FROM sims",
    "grad": "SELECT i, [sum(theta[1]*v), sum(theta[2]*v), sum(theta[3]*v), sum(theta[4]*v), sum(theta[5]*v), sum(theta[6]*v)] AS g, "
            "var_pop(v) AS v, avg(v) AS d0 FROM sl GROUP BY i",
    "layers": "SELECT l_orderkey AS model, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, "
              "l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS layer, l_quantity AS thickness, "
              "5.0::DOUBLE + l_discount * 20 AS vp, 3.0::DOUBLE + l_tax * 20 AS vs FROM lineitem",
}
_NEEDS = {"lg": ["tr"], "rec": ["tr"], "rl": ["rec"], "mt": ["tr"], "truth": ["mt"], "sims": ["tr"], "sl": ["sims"], "grad": ["sl"]}


def ctes(*names: str, **more: str) -> str:
    """WITH clause of the named adapters and what they need, then further named selects."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({_CTE[n]})" for n in order] + [f"{n} AS ({text})" for n, text in more.items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def degrees_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle degrees by the chord between unit vectors."""
    return (f"degrees(2 * asin(least(1.0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) "
            f"+ cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))")
