"""Covariances factored once per key, and their use on the vectors of that key.

A factor table has one row per key: (keys, kind, n, log_det, factor). The factoring runs in the task
that holds the key; nothing of it is done again per batch, and the table is written to the shared folder.

- `toeplitz`: first column of the inverse and of the matrix; the inverse is applied by FFT (four
  convolutions of the Gohberg-Semencul form and one step of refinement), n numbers per vector and no
  n x n matrix. Below `SMALL` samples the matrix is written out instead.
- `dense`: the packed inverse of the Cholesky factor, a whitening matrix.
- `root`: the packed Cholesky factor itself, to colour white noise.
- `diagonal`: the variances, one for all samples or one for each.

Tables up to `memory` bytes go to every task, and vectors are not shuffled. Beyond that, vectors and
factors are grouped by key; a key with many samples is split by written row numbers, and each of its
parts gets the factor once. Both ways keep every vector: without a factor of its key the result is
null, and a null key is a key like any other. A vector of another length than its factor is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwave.functions.batches import blocks, lists_of
from quietwave.operators.traces import to_array
from quietwave.session import materialise

MEMORY = 64 * 1024 * 1024
PART_SAMPLES = 8_000_000
SMALL = 256
_FIELDS = "kind string, n int, log_det double, factor array<double>"


def _fields(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*names).schema.fields)


def inverse_column(column: np.ndarray) -> tuple[np.ndarray, float]:
    """First column of the inverse of a positive definite Toeplitz matrix, and log det, by Durbin's recursion."""
    n = len(column)
    if not np.all(column[:1] > 0):
        raise np.linalg.LinAlgError("the Toeplitz matrix is not positive definite")
    first, log_det = np.zeros(n), 0.0
    first[0] = 1 / column[0]
    for k in range(1, n):
        log_det -= np.log(first[0])
        off = column[k:0:-1] @ first[:k]
        rest = 1 - off * off
        if not rest > 0:
            raise np.linalg.LinAlgError("the Toeplitz matrix is not positive definite")
        first[:k + 1] = (first[:k + 1] - off * first[k::-1]) / rest
    return first, float(log_det - np.log(first[0]))


def toeplitz_inverse(column: np.ndarray) -> np.ndarray:
    """The inverse written out: down each diagonal it grows by products of its first column and of that reversed."""
    first, n = inverse_column(column)[0], len(column)
    steps = np.outer(first, first / first[0])
    steps[1:, 1:] -= np.outer(first[:0:-1], first[:0:-1] / first[0])
    for i in range(1, n):
        steps[i, 1:] += steps[i - 1, :-1]
    return steps


@dataclass
class Factor:
    kind: str
    n: int | None
    log_det: float | None
    values: np.ndarray

    @cached_property
    def triangle(self) -> np.ndarray:
        out = np.zeros((self.n, self.n))
        out[np.tril_indices(self.n)] = self.values
        return out

    @cached_property
    def inverse(self) -> np.ndarray:
        return toeplitz_inverse(self.values[self.n:])

    @cached_property
    def spectra(self) -> tuple[np.ndarray, ...]:
        """Transforms of the lower triangular columns of the inverse and of the matrix wrapped to a circle."""
        first, column, size = self.values[:self.n], self.values[self.n:], 2 * self.n
        shifted = np.concatenate([[0.0], first[:0:-1]])
        wrapped = np.concatenate([column, [0.0], column[:0:-1]])
        return np.fft.rfft(first, size), np.fft.rfft(shifted, size), np.fft.rfft(wrapped, size)

    def _by_fft(self, x: np.ndarray) -> np.ndarray:
        n, size = self.n, 2 * self.n
        a, b, c = self.spectra

        def times(spectrum: np.ndarray, rows: np.ndarray) -> np.ndarray:
            return np.fft.irfft(np.fft.rfft(rows, size, axis=1) * spectrum, size, axis=1)[:, :n]

        def once(rows: np.ndarray) -> np.ndarray:
            # (L L' - U U') / first[0]; the transposed factors act on the reversed vector
            back = rows[:, ::-1]
            return (times(a, times(a, back)[:, ::-1]) - times(b, times(b, back)[:, ::-1])) / self.values[0]

        y = once(x)
        return y + once(x - times(c, y))

    def checked(self, x: np.ndarray) -> np.ndarray:
        if self.n is not None and x.shape[1] != self.n:
            raise ValueError(f"a vector has {x.shape[1]} samples, its covariance {self.n}")
        return x

    def solve(self, x: np.ndarray) -> np.ndarray:
        """C^-1 of every row."""
        x = self.checked(x)
        if self.kind == "diagonal":
            return x / self.values
        if self.kind == "toeplitz":
            return x @ self.inverse if self.n < SMALL else self._by_fft(x)
        return x @ self.triangle.T @ self.triangle

    def colour(self, x: np.ndarray) -> np.ndarray:
        """L of every row, L L' = C."""
        x = self.checked(x)
        return x * np.sqrt(self.values) if self.kind == "diagonal" else x @ self.triangle.T

    def log_determinant(self, samples: int) -> float:
        return self.log_det if self.n is not None else samples * float(np.log(self.values[0]))


def toeplitz_factors(cov: DataFrame, keys: list[str], k: str = "k", c: str = "c") -> DataFrame:
    """Factor table of Toeplitz columns in long form (keys, k, c)."""
    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, column in enumerate(batch.column(len(keys)).to_pylist()):
                first, log_det = inverse_column(np.array(column, float))
                one = [col.slice(i, 1) for col in batch.columns[:len(keys)]]
                yield pa.RecordBatch.from_arrays(
                    [*one, pa.array(["toeplitz"]), pa.array([len(column)], pa.int32()), pa.array([log_det]), pa.array([[*first, *column]], pa.list_(pa.float64()))],
                    names=[*keys, "kind", "n", "log_det", "factor"])

    packed = to_array(cov, keys, k, c).select(*keys, c)
    return packed.mapInArrow(factor, _fields(packed, keys) + _FIELDS)


def dense_factors(rows: DataFrame, keys: list[str], inverse: bool = True) -> DataFrame:
    """Factor table of dense blocks in rows (keys, t, row): whitening matrices, or roots without `inverse`."""
    def factor(block: pa.Table) -> pa.Table:
        block = block.sort_by("t")
        root = np.linalg.cholesky(np.array(block.column("row").to_pylist(), float))
        log_det = 2 * float(np.log(np.diag(root)).sum())
        values = (np.linalg.inv(root) if inverse else root)[np.tril_indices(len(root))]
        return pa.table([*[block.column(k).slice(0, 1) for k in keys], pa.array(["dense" if inverse else "root"]), pa.array([len(root)], pa.int32()),
                         pa.array([log_det]), pa.array([values], pa.list_(pa.float64()))], names=[*keys, "kind", "n", "log_det", "factor"])

    return rows.select(*keys, "t", "row").groupBy(*keys).applyInArrow(factor, _fields(rows, keys) + _FIELDS)


def diagonal_factors(variances: DataFrame, keys: list[str], variance: str = "variance") -> DataFrame:
    """Factor table of variances: a number for all samples of the key, or an array with one for each."""
    if variances.schema[variance].dataType.typeName() == "array":
        logs = F.aggregate(variance, F.lit(0.0), lambda total, v: total + F.ln(v))
        return variances.select(*keys, F.lit("diagonal").alias("kind"), F.size(variance).alias("n"), logs.alias("log_det"), F.col(variance).cast("array<double>").alias("factor"))
    none = F.lit(None)
    return variances.select(*keys, F.lit("diagonal").alias("kind"), none.cast("int").alias("n"), none.cast("double").alias("log_det"),
                            F.array(F.col(variance).cast("double")).alias("factor"))


def _factors_of(table: pa.Table, keys: list[str]) -> dict[tuple, Factor]:
    columns = [table.column(k).to_pylist() for k in keys]
    lists = table.column("factor").combine_chunks()
    parts = zip(table.column("kind").to_pylist(), table.column("n").to_pylist(), table.column("log_det").to_pylist(), strict=True)
    return {tuple(c[i] for c in columns): Factor(kind, n, log_det, lists[i].values.to_numpy(zero_copy_only=False)) for i, (kind, n, log_det) in enumerate(parts)}


Job = Callable[[Factor, np.ndarray], list[np.ndarray]]


def _run(job: Job, outputs: list[str], groups: list[tuple[Factor | None, np.ndarray]], lists: pa.Array) -> list[pa.Array]:
    """`job` on the vectors of each factor; one list column per output."""
    parts: list[list] = [[] for _ in outputs]
    for factor, rows in groups:
        if factor is None:
            continue
        for own, block in blocks(lists.take(pa.array(rows))):
            for part, result in zip(parts, job(factor, block), strict=True):
                part.append((rows[own], result))
    return [lists_of(len(lists), part) for part in parts]


def _merged(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def with_factors(vectors: DataFrame, factors: DataFrame, keys: list[str], job: Job, outputs: list[str], x: str = "x", memory: int = MEMORY, part_samples: int = PART_SAMPLES) -> DataFrame:
    """Array columns `outputs` that `job` makes of the vectors of each key and its factor."""
    names = vectors.columns
    schema = _fields(vectors, names) + ", ".join(f"`{o}` array<double>" for o in outputs)
    size = factors.agg(F.sum(F.size("factor")).cast("long").alias("n")).first()["n"] or 0
    if size * 8 <= memory:
        shared = vectors.sparkSession.sparkContext.broadcast(_factors_of(factors.toArrow(), keys))

        def by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                members: dict[tuple, list[int]] = {}
                columns = [batch.column(k).to_pylist() for k in keys]
                for i in range(batch.num_rows):
                    members.setdefault(tuple(c[i] for c in columns), []).append(i)
                groups = [(shared.value.get(key), np.array(rows)) for key, rows in members.items()]
                made = _run(job, outputs, groups, batch.column(x))
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, *outputs])

        return vectors.mapInArrow(by_batch, schema)

    counted = vectors.groupBy(*keys).agg(F.greatest(F.lit(1), F.ceil(F.sum(F.coalesce(F.size(x), F.lit(0))) / part_samples)).cast("int").alias("_parts"))
    counted = materialise(counted, "parts")
    split = (counted.agg(F.max("_parts")).first()[0] or 1) > 1
    same = lambda left, right: [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys] or [F.lit(True)]
    renamed = counted.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    if split:
        numbered = materialise(vectors.withColumn("_row", F.monotonically_increasing_id()), "vectors")
        placed = numbered.join(renamed, same(numbered, renamed)).withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int")).select(*names, "_part")
        copies = factors.join(renamed, same(factors, renamed)).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(*factors.columns, "_part")
    else:
        placed, copies = vectors.withColumn("_part", F.lit(0)), factors.withColumn("_part", F.lit(0))

    def by_group(rows: pa.Table, own: pa.Table) -> pa.Table:
        found = list(_factors_of(own, keys).values())
        groups = [(found[0] if found else None, np.arange(rows.num_rows))]
        made = _run(job, outputs, groups, _merged(rows.column(x)))
        return pa.table([*[rows.column(c) for c in names], *made], names=[*names, *outputs])

    return placed.groupBy(*keys, "_part").cogroup(copies.groupBy(*keys, "_part")).applyInArrow(by_group, schema)


def solve(vectors: DataFrame, factors: DataFrame, keys: list[str], x: str = "x", out: str = "y", **way) -> DataFrame:
    """C^-1 x."""
    return with_factors(vectors, factors, keys, lambda factor, block: [factor.solve(block)], [out], x, **way)


def colour(vectors: DataFrame, factors: DataFrame, keys: list[str], x: str = "x", out: str = "y", **way) -> DataFrame:
    """L x with L L' = C, of `root` or `diagonal` factors."""
    return with_factors(vectors, factors, keys, lambda factor, block: [factor.colour(block)], [out], x, **way)


def quadratic_forms(vectors: DataFrame, factors: DataFrame, keys: list[str], parts: int = 1, x: str = "x", forms: str = "forms", log_det: str = "log_det", **way) -> DataFrame:
    """Upper triangle of X C^-1 X' per row, where x holds `parts` vectors of the key end to end, and log det C."""
    upper = np.triu_indices(parts)

    def job(factor: Factor, block: np.ndarray) -> list[np.ndarray]:
        stacked = block.reshape(len(block) * parts, -1)
        solved = factor.solve(stacked).reshape(len(block), parts, -1)
        gram = stacked.reshape(solved.shape) @ solved.transpose(0, 2, 1)
        return [gram[:, upper[0], upper[1]], np.full((len(block), 1), factor.log_determinant(stacked.shape[1]))]

    made = with_factors(vectors, factors, keys, job, [forms, "_log_dets"], x, **way)
    return made.withColumn(log_det, F.col("_log_dets")[0]).drop("_log_dets")
