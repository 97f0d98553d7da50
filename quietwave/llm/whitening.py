"""Embedding whitening by mixed-precision eigenvectors of a distributed, exact covariance.

Entries become integers, floor(scale * entry) + offset. The fit list is each distinct vector once. Tasks
sum integers only: first the sums, then the products of entries less the floor of their mean, so the
covariance comes out exact and is rounded once; it does not depend on partitions or retries. Only
dimensions x dimensions numbers reach the driver.

Eigenvectors start in float32. Each refinement step of Ogita and Aishima then corrects all of them by
matrix products in extended precision, from the residuals of orthogonality and of the diagonal form,
and doubles the number of right digits. The step cannot part eigenvalues nearer than its own error
bound; such a cluster is rotated by the eigenvectors of its own small matrix, shifted by its mean so
that the digits in which its members differ are not lost, and the steps go on.

Defined results: rows go whose vector is null or holds a null or non-finite entry; so do vectors of
another length than the commonest (the longer of equally common ones), which lie in no common space.
An entry of 2^27 or more after scaling is an error. Repeated vectors count once in the fit and all get
their rows. A component without spread (fewer different vectors than dimensions) has a null `whitened`;
`identity_error` is over the components with spread, null without any. Null keys are kept. A `deviation`
beyond a long is null. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwave.llm.common import Work
from quietwave.llm.vectors import as_block, integer_vectors, per_task, summed, whole_lists

# Products of two numbers below 2^20 add up without rounding in doubles over blocks of 2^13 rows.
DIGIT, BLOCK = 20, 1 << 13
HIGH = np.longdouble


@dataclass
class Whitening:
    """n and sums of the fit list, components (dims x parts), eigenvalues and trace; identity_error over the fit list."""

    n: int
    sums: list[int]
    offset: int
    components: np.ndarray
    eigenvalues: np.ndarray
    spread: np.ndarray
    trace: float
    identity_error: float | None = None

    def centred(self, block: np.ndarray) -> np.ndarray:
        """(n * x - S) / n in doubles; the difference is exact."""
        return self.scaled(block).astype(np.float64) / self.n

    def scaled(self, block: np.ndarray) -> np.ndarray:
        """n * x - S, exact; Python integers where a long might not hold it. The offset cancels out."""
        rest = np.array([s - self.n * self.offset for s in self.sums], dtype=object)
        bound = self.n * int(np.abs(block).max(initial=0)) + max((abs(r) for r in rest), default=0)
        kind = np.int64 if bound < 1 << 62 else object
        return block.astype(kind) * self.n - rest.astype(kind)

    def whitened(self, block: np.ndarray) -> np.ndarray:
        """Coordinates along the components with spread, NaN along the others."""
        with np.errstate(divide="ignore", invalid="ignore"):
            along = self.components / np.sqrt(self.eigenvalues)
        return np.where(self.spread, self.centred(block) @ np.where(self.spread, along, 0.0), np.nan)


def commonest_length(df: DataFrame, vector: str) -> int:
    lengths = df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("d")).count()
    row = lengths.orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return row[0]["d"] if row else 0


def exact_products(block: np.ndarray) -> np.ndarray:
    """block' * block in Python integers: the entries are cut into digits whose products are exact in doubles."""
    dims = block.shape[1]
    total = np.zeros((dims, dims), dtype=object)
    for start in range(0, len(block), BLOCK):
        rest, digits = block[start:start + BLOCK], []
        while True:
            high = rest >> DIGIT
            if np.all((rest >= -(1 << DIGIT)) & (rest < 1 << DIGIT)):
                digits.append(rest.astype(np.float64))
                break
            digits.append((rest - (high << DIGIT)).astype(np.float64))
            rest = high
        for a, left in enumerate(digits):
            for b, right in enumerate(digits):
                total += (left.T @ right).astype(np.int64).astype(object) << (DIGIT * (a + b))
    return total


def exact_covariance(fit: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """n, sums, and n^2 times the covariance of the integer vectors `x`, all exact."""
    def add_sums(state: dict, column: pa.Array) -> None:
        block = as_block(column, dims)
        state["n"] += len(block)
        state["sums"] += block.sum(axis=0).astype(object)

    partial = per_task(fit, ["x"], lambda: {"n": 0, "sums": np.zeros(dims, dtype=object)}, add_sums,
                       lambda s: {"parts": whole_lists([[s["n"], *s["sums"].tolist()]])}, "parts array<decimal(38,0)>")
    parts = summed(partial, [], "parts").get((), {0: 0})
    n, sums = parts[0], [parts.get(1 + d, 0) for d in range(dims)]
    if not n:
        return 0, sums, []
    centre = np.array([s // n for s in sums], dtype=np.int64)

    def add_products(state: dict, column: pa.Array) -> None:
        state["gram"] += exact_products(as_block(column, dims) - centre)

    partial = per_task(fit, ["x"], lambda: {"gram": np.zeros((dims, dims), dtype=object)}, add_products,
                       lambda s: {"i": pa.array(range(dims), pa.int32()), "row": whole_lists([s["gram"][i, i:].tolist() for i in range(dims)])}, "i int, row array<decimal(38,0)>")
    gram, rest = summed(partial, ["i"], "row"), [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    return n, sums, [[n * gram[(min(i, j),)][abs(i - j)] - rest[i] * rest[j] for j in range(dims)] for i in range(dims)]


def in_high_precision(numerators: list[list[int]], denominator: int) -> np.ndarray:
    """Quotients of integers in extended precision, as the sum of two doubles."""
    def quotient(a: int) -> np.longdouble:
        first = a / denominator
        return HIGH(first) + HIGH(float(Fraction(a, denominator) - Fraction(first)))

    return np.array([[quotient(a) for a in row] for row in numerators], dtype=HIGH)


def clusters_of(values: np.ndarray, bound: float) -> list[np.ndarray]:
    """Places of eigenvalues that follow one another at no more than `bound`, in groups of two or more."""
    order = np.argsort(values)
    cuts = np.nonzero(np.diff(values[order]) > bound)[0] + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def refined_eigenvectors(matrix: np.ndarray, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of a symmetric matrix, both in extended precision."""
    a = matrix.astype(HIGH)
    size, scale = len(a), np.abs(a).max(initial=HIGH(0))
    if not size or not scale:
        return np.zeros(size, HIGH), np.eye(size, dtype=HIGH)
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(HIGH)
    def straightened(x: np.ndarray) -> np.ndarray:
        """A rotation by e inside a narrow cluster leaves e^2 of skewness behind, which would hide the next rotation."""
        return x + x @ (unit - x.T @ x) / 2

    unit, norm, goal = np.eye(size, dtype=HIGH), np.linalg.norm(a.astype(np.float64), 2), 8 * size * np.finfo(HIGH).eps
    for _ in range(steps):
        r = unit - x.T @ x
        s = x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        error = float(np.sqrt((off ** 2).sum()) + norm * np.sqrt((r ** 2).sum()))
        if error <= goal:
            break
        bound = max(2 * error, float(goal))
        gaps = values[None, :] - values[:, None]
        far = np.abs(gaps) > bound
        turn = (s + r * values[None, :]) / np.where(far, gaps, 1)
        x = straightened(x + x @ np.where(far & (np.abs(turn) < 0.125), turn, r / 2))
        for group in clusters_of(values, bound):
            own = x[:, group]
            small = own.T @ a @ own
            small = small - np.eye(len(group), dtype=HIGH) * np.trace(small) / len(group)
            width = np.abs(small).max()
            if width:
                x[:, group] = own @ np.linalg.eigh((small / width).astype(np.float64))[1].astype(HIGH)
        x = straightened(x)
    x = straightened(straightened(x))
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    return values[order] * scale, x


def fit(vectors: DataFrame, dims: int, parts: int = 16, offset: int = 0) -> Whitening | None:
    """Whitening of the distinct integer vectors `x` (offset not yet added); None for an empty table."""
    listed = Work(vectors.sparkSession, "whitening").save(vectors.select("x").distinct(), "fit")
    n, sums, numerators = exact_covariance(listed, dims)
    if not n or not dims:
        return None
    covariance = in_high_precision(numerators, n * n)
    values, components = refined_eigenvectors(covariance)
    parts = min(parts, dims)
    spread = (values > values[0] * dims * np.finfo(np.float64).eps) & (np.arange(dims) < n - 1) if values[0] > 0 else np.zeros(dims, dtype=bool)
    model = Whitening(n, [s + n * offset for s in sums], offset, components[:, :parts].astype(np.float64), values[:parts].astype(np.float64),
                      spread[:parts], float(np.trace(covariance)))
    model.identity_error = identity_error(listed, dims, model)
    return model


def identity_error(listed: DataFrame, dims: int, model: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, measured in a pass of its own."""
    k = int(model.spread.sum())
    if not k:
        return None

    def add(state: dict, column: pa.Array) -> None:
        w = model.whitened(as_block(column, dims))[:, :k]
        state["sums"] += w.sum(axis=0)
        state["gram"] += w.T @ w

    partial = per_task(listed, ["x"], lambda: {"sums": np.zeros(k), "gram": np.zeros((k, k))}, add,
                       lambda s: {"parts": pa.array([[*s["sums"], *s["gram"].reshape(-1)]], pa.list_(pa.float64()))}, "parts array<double>")
    rows = partial.select(F.posexplode("parts").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    flat = np.array([r["v"] for r in rows]) / model.n
    return float(np.abs(flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k]) - np.eye(k)).max())


def transform(vectors: DataFrame, key: str, dims: int, model: Whitening) -> DataFrame:
    """A row per vector and component: key, component, n, deviation, whitened, explained, identity_error."""
    parts = len(model.eigenvalues)
    explained = model.eigenvalues / model.trace if model.trace > 0 else None

    def deviations(block: np.ndarray) -> pa.Array:
        scaled = model.scaled(block)
        if scaled.dtype == object or float(np.abs(scaled).max(initial=0)) ** 2 * dims >= 2.0 ** 62:
            sums = (scaled.astype(object) ** 2).sum(axis=1)
            return pa.array([v if v < 1 << 63 else None for v in sums.tolist()], pa.int64())
        return pa.array((scaled ** 2).sum(axis=1))

    def spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block, rows = as_block(batch.column(1), dims), batch.num_rows
            pick = pa.array(np.repeat(np.arange(rows), parts))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pick), pa.array(np.tile(np.arange(1, parts + 1, dtype=np.int32), rows)), pa.array(np.full(rows * parts, model.n, np.int64)),
                deviations(block).take(pick), pa.array(model.whitened(block).reshape(-1), from_pandas=True),
                pa.array([None] * (rows * parts) if explained is None else np.tile(explained, rows), pa.float64()),
                pa.array([model.identity_error] * (rows * parts), pa.float64()),
            ], names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, "x").mapInArrow(spread_out, f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 16, scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """Fits on the distinct vectors of `df` and whitens all of them along the first `parts` components."""
    dims = commonest_length(df, vector)
    vectors = integer_vectors(df, [key], vector, dims, scale)
    model = fit(vectors, dims, parts, offset)
    if model is None:
        empty = Whitening(1, [0] * dims, offset, np.zeros((dims, 0)), np.zeros(0), np.zeros(0, dtype=bool), 0.0)
        return transform(vectors.where("false"), key, dims, empty)
    return transform(vectors, key, dims, model)
