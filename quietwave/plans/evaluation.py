"""Posterior tensors to source parameters, bias and z-scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwave.functions.tensors import M6, convert_axes, magnitude, nodal_planes, with_source_type
from quietwave.operators.posterior import PERIODS, align_planes, bias_table


def with_both_planes(samples: DataFrame, m: list[str] = M6) -> DataFrame:
    turned = convert_axes(samples, "use", "planes", m, prefix="_q")
    out = turned.withColumn("planes", nodal_planes(*[f"_q{k}" for k in range(1, 7)]))
    return out.drop(*[f"_q{k}" for k in range(1, 7)])


def reparametrise(samples: DataFrame, select: Callable[[Column], Column] | None = None, m: list[str] = M6) -> DataFrame:
    """Add gamma, delta, Mw, strike, dip, rake; `select` picks one of the two planes.

    `select` gets the struct strike1..rake2 and returns a struct strike, dip, rake; the
    default is the first plane.
    """
    out = with_source_type(with_both_planes(samples, m), m).withColumn("Mw", magnitude(m))
    pair = F.col("planes")
    chosen = select(pair) if select else F.struct(
        pair["strike1"].alias("strike"), pair["dip1"].alias("dip"), pair["rake1"].alias("rake"))
    return out.withColumn("_plane", chosen).select(*samples.columns, "gamma", "delta", "Mw", "_plane.*")


def tensor_posterior_scores(samples: DataFrame, truth: DataFrame, event: list[str], m: list[str] = M6) -> DataFrame:
    """Bias, z, u and spread of the six source quantities per event.

    `samples` and `truth` hold tensor elements; planes are aligned to the truth first.
    """
    def described(df: DataFrame) -> DataFrame:
        wide = with_source_type(with_both_planes(df, m), m).withColumn("Mw", magnitude(m))
        return wide.select(*[c for c in df.columns if c not in m], "gamma", "delta", "Mw", "planes.*")

    known = described(truth)
    source = known.select(*event, *[F.col(q).alias(f"true_{q}") for q in ("gamma", "delta", "Mw")])
    planes = known.select(*event, *[f"{q}{i}" for i in (1, 2) for q in ("strike", "dip", "rake")])
    joined = align_planes(described(samples), planes, event).join(source, event)
    entries = F.array(*[
        F.struct(F.lit(q).alias("quantity"), F.col(q).alias("value"), F.col(f"true_{q}").alias("truth"),
                 F.lit(p).cast("double").alias("period")) for q, p in PERIODS.items()])
    long = joined.select(*event, F.inline(entries))
    return bias_table(long, [*event, "quantity"])
