"""Covariance tables, Gram sums, and inverse-covariance products on trace rows.

Long Toeplitz columns are (keys, k, c); dense blocks are rows (keys, t, row array).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwave.operators.factors import PART_SAMPLES, colour, dense_factors, solve, toeplitz_factors
from quietwave.operators.ordering import join_same, with_totals
from quietwave.operators.traces import to_array
from quietwave.session import materialise

BLOCK_BYTES = 64 * 1024 * 1024


def toeplitz_rows(cov: DataFrame, keys: list[str], k: str = "k", c: str = "c") -> DataFrame:
    """Rows (keys, t, row) of C[t,u] = c[|t-u|]."""
    packed = to_array(cov, keys, k, c).withColumnRenamed(c, "_c")
    n = F.size("_c")
    rows = packed.withColumn("t", F.explode(F.sequence(F.lit(0), n - 1)))
    left = F.reverse(F.slice("_c", F.lit(2), F.col("t")))
    return rows.select(*keys, "t", F.concat(left, F.slice("_c", F.lit(1), n - F.col("t"))).alias("row"))


def diagonal_rows(variances: DataFrame, keys: list[str], n: int, variance: str = "variance") -> DataFrame:
    """Dense rows of variance * identity: the scalar and diagonal covariances as blocks."""
    rows = variances.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    zeros = F.array_repeat(F.lit(0.0), n)
    return rows.select(*keys, "t", F.transform(
        zeros, lambda v, u: F.when(u == F.col("t"), F.col(variance)).otherwise(v)).alias("row"))


def add_covariances(theory: DataFrame, data: DataFrame, keys: list[str], diagonal_share: float = 0.001) -> DataFrame:
    """theory + data + max(diag theory) * share on the diagonal; a side may lack a block."""
    top = theory.groupBy(*keys).agg(F.max(F.element_at("row", F.col("t").cast("int") + 1)).alias("_top"))
    both = theory.select(*keys, "t", F.col("row").alias("_a")).join(
        data.select(*keys, "t", F.col("row").alias("_b")), [*keys, "t"], "full")
    none = F.transform(F.coalesce("_a", "_b"), lambda v: F.lit(0.0))
    total = F.zip_with(F.coalesce("_a", none), F.coalesce("_b", none), lambda a, b: a + b)
    lift = F.coalesce(F.col("_top"), F.lit(0.0)) * diagonal_share
    return both.join(top, keys, "left").select(
        *keys, "t", F.transform(total, lambda v, u: F.when(u == F.col("t"), v + lift).otherwise(v)).alias("row"))


def _key(key: tuple) -> tuple:
    """A pandas group key with None for every kind of null."""
    return tuple(None if pd.isna(k) else k for k in key)


def gram_rows(vectors: DataFrame, keys: list[str], x: str = "x", memory: int = BLOCK_BYTES) -> DataFrame:
    """Sum over rows of x_t x_u per `keys`, as rows (keys, t, row, n).

    Each task adds the outer products of its own rows with NumPy and emits one matrix
    per key, so a key that holds most rows shuffles one matrix per task only.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*keys).schema.fields)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}

        def flush() -> Iterator[pd.DataFrame]:
            for key, (matrix, count) in sums.items():
                out = {k: [v] * len(matrix) for k, v in zip(keys, key)}
                out.update(t=np.arange(len(matrix)), row=list(matrix), n=[count] * len(matrix))
                yield pd.DataFrame(out)
            sums.clear()

        for batch in batches:
            for key, part in batch.groupby(keys, sort=False, dropna=False):
                key = _key(key)
                block = np.stack([np.asarray(v, float) for v in part[x]])
                matrix, count = sums.get(key, (0.0, 0))
                sums[key] = (matrix + block.T @ block, count + len(block))
            if sum(8 * m.size for m, _ in sums.values()) > memory:
                yield from flush()
        yield from flush()

    parts = vectors.select(*keys, x).mapInPandas(partial, f"{fields}, t int, row array<double>, n bigint")
    long = parts.select(*keys, "t", "n", F.posexplode("row").alias("u", "v"))
    cells = long.groupBy(*keys, "t", "u").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    packed = F.array_sort(F.collect_list(F.struct("u", "v")))
    return cells.groupBy(*keys, "t").agg(F.transform(packed, lambda s: s["v"]).alias("row"), F.max("n").alias("n"))


def mean_vectors(vectors: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Elementwise mean of the arrays of each key; pre-aggregated per task."""
    long = vectors.select(*keys, F.posexplode(x).alias("i", "v"))
    means = long.groupBy(*keys, "i").agg(F.avg("v").alias("v"))
    return to_array(means, keys, "i", "v").withColumnRenamed("v", x)


def theory_covariance(realisations: DataFrame, keys: list[str], fiducial: DataFrame | None = None, x: str = "x") -> DataFrame:
    """sum_r (x_rt - m_t)(x_ru - m_u) / (R-1) per trace; m = fiducial trace or ensemble mean."""
    centre = fiducial if fiducial is not None else mean_vectors(realisations, keys, x)
    residual = join_same(realisations, centre.select(*keys, F.col(x).alias("_m")), keys).select(
        *keys, F.zip_with(x, "_m", lambda a, b: a - b).alias(x))
    return gram_rows(residual, keys, x).select(
        *keys, "t", F.transform("row", lambda v: F.try_divide(v, (F.col("n") - 1).cast("double"))).alias("row"))


def weighted_moments(df: DataFrame, groups: list[str], columns: list[str], weight: str | None = None) -> DataFrame:
    """Weighted mean and covariance of a few columns, one row per group and pair (a, b).

    Covariance uses reliability weights with one degree of freedom removed.  Two passes,
    both plain aggregates: no pair of rows is ever formed.
    """
    w = F.lit(1.0) if weight is None else F.col(weight)
    means = df.groupBy(*groups).agg(
        F.sum(w).alias("_w"), F.sum(w * w).alias("_ww"),
        *[(F.sum(w * F.col(c)) / F.sum(w)).alias(f"_m_{c}") for c in columns])
    joined = with_totals(df, means, groups)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = joined.groupBy(*groups).agg(
        F.max("_w").alias("_w"), F.max("_ww").alias("_ww"), *[F.max(f"_m_{c}").alias(f"_m_{c}") for c in columns],
        *[F.sum(w * (F.col(a) - F.col(f"_m_{a}")) * (F.col(b) - F.col(f"_m_{b}"))).alias(f"_s_{a}_{b}") for a, b in pairs])
    free = F.col("_w") - F.col("_ww") / F.col("_w")
    return sums.select(*groups, F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_m_{a}").alias("mean_a"), F.col(f"_m_{b}").alias("mean_b"),
                 F.try_divide(F.col(f"_s_{a}_{b}"), free).alias("cov")) for a, b in pairs])).alias("_p")).select(*groups, "_p.*")


def solve_toeplitz(vectors: DataFrame, cov: DataFrame, keys: list[str], x: str = "x", out: str = "y", memory: int = BLOCK_BYTES) -> DataFrame:
    """C^-1 x for Toeplitz columns (keys, k, c), each factored once; without a column of its key a vector gets null."""
    factors = materialise(toeplitz_factors(cov, keys), "factors")
    return solve(vectors, factors, keys, x, out, memory=memory)


def apply_blocks(vectors: DataFrame, blocks: DataFrame, keys: list[str], mode: str, x: str = "x", out: str = "y",
                 memory: int = BLOCK_BYTES, part_samples: int = PART_SAMPLES) -> DataFrame:
    """Dense blocks on the vectors of their key: mode solve (C^-1 x) or colour (L x, L L' = C), see `factors`."""
    factors = materialise(dense_factors(blocks, keys, inverse=mode == "solve"), "factors")
    use = solve if mode == "solve" else colour
    return use(vectors, factors, keys, x, out, memory=memory, part_samples=part_samples)
