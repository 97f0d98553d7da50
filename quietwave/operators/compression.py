"""Score compression: finite differences, Fisher matrix, scores, estimates, least squares.

Gradients are rows (i, g array<double>, v, d0): sample index, one derivative per
parameter, noise variance and fiducial value.  Under block covariances a column
w array<double> = C^-1 g takes the place of g / v.  Records are rows with an array `x`.
Only p x p matrices and, while it is small, the p x n gradient reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwave.functions.batches import blocks, lists_of, on_blocks
from quietwave.operators.factors import diagonal_factors, quadratic_forms
from quietwave.operators.ordering import join_same
from quietwave.session import materialise

MATRIX_BYTES = 128 * 1024 * 1024
# Of the long way of `synthesize`: samples in a block of kernels, rows that share a copy of it, bytes of records in a task.
BLOCK_SAMPLES, GROUP_ROWS, PART_BYTES = 4096, 65_536, 32 * 1024 * 1024
# Five-point stencil, offset -> weight, over 12 delta and 12 delta^2.
FIRST_WEIGHTS = {-2: 1.0, -1: -8.0, 1: 8.0, 2: -1.0}
SECOND_WEIGHTS = {-2: -1.0, -1: 16.0, 0: -30.0, 1: 16.0, 2: -1.0}
# Fixed values: (offset i, offset j) -> weight, over 4 delta_i delta_j.
MIXED_WEIGHTS = {(-1, -1): 1.0, (-1, 1): -1.0, (1, -1): -1.0, (1, 1): 1.0}


def _packed(params: DataFrame) -> DataFrame:
    """The whole (short) parameter list as one row of arrays."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "fiducial", "delta")))
    return params.agg(rows.alias("_p"))


def stencil_candidates(params: DataFrame) -> DataFrame:
    """Fiducial (pos null, offset 0) and offsets -2, -1, 1, 2 times delta of each parameter."""
    packed = _packed(params)
    moves = packed.withColumn("_pos", F.explode(F.transform("_p", lambda r: r["pos"]))).withColumn(
        "offset", F.explode(F.array(*[F.lit(o) for o in FIRST_WEIGHTS])))
    moved = moves.select(F.col("_pos").alias("pos"), "offset", F.transform(
        "_p", lambda r: r["fiducial"] + F.when(r["pos"] == F.col("_pos"), F.col("offset") * r["delta"]).otherwise(0.0)).alias("theta"))
    centre = packed.select(F.lit(None).cast("int").alias("pos"), F.lit(0).alias("offset"),
                           F.transform("_p", lambda r: r["fiducial"]).alias("theta"))
    return centre.unionByName(moved.withColumn("pos", F.col("pos").cast("int")))


def mixed_candidates(params: DataFrame) -> DataFrame:
    """Pairs i > j moved by (-1,-1), (-1,1), (1,-1), (1,1) deltas."""
    packed = _packed(params)
    pairs = packed.withColumn("i", F.explode(F.transform("_p", lambda r: r["pos"]))).withColumn(
        "j", F.explode(F.transform("_p", lambda r: r["pos"]))).where("i > j")
    signs = F.array(*[F.struct(F.lit(a).alias("oi"), F.lit(b).alias("oj")) for a, b in MIXED_WEIGHTS])
    moves = pairs.withColumn("_s", F.explode(signs))
    move = lambda r: (
        r["fiducial"] + F.when(r["pos"] == F.col("i"), F.col("_s.oi") * r["delta"]).otherwise(0.0)
        + F.when(r["pos"] == F.col("j"), F.col("_s.oj") * r["delta"]).otherwise(0.0))
    return moves.select("i", "j", "_s.oi", "_s.oj", F.transform("_p", move).alias("theta"))


def _weighted_sum(parts: dict[str, float], divide: Column) -> Column:
    """Elementwise sum of weight * array column, over a scalar."""
    total = None
    for name, w in parts.items():
        term = F.transform(name, lambda v: v * w / divide)
        total = term if total is None else F.zip_with(total, term, lambda a, b: a + b)
    return total


def first_and_second_derivatives(sims: DataFrame, deltas: DataFrame, x: str = "x") -> DataFrame:
    """Rows (pos, gradient, curvature) from stencil records (pos, offset, x)."""
    centre = sims.where("offset = 0").agg(F.first(x).alias("_c")).select("_c")
    sides = sims.where("offset != 0").groupBy("pos").agg(*[
        F.max(F.when(F.col("offset") == o, F.col(x))).alias(f"_o{k}") for k, o in enumerate(FIRST_WEIGHTS)])
    joined = sides.join(deltas.select("pos", "delta"), "pos").withColumn("_o4", centre.scalar())
    first = {f"_o{k}": w for k, w in enumerate(FIRST_WEIGHTS.values())}
    second = {f"_o{k}": SECOND_WEIGHTS[o] for k, o in enumerate(FIRST_WEIGHTS)} | {"_o4": SECOND_WEIGHTS[0]}
    d = F.col("delta")
    return joined.select("pos", _weighted_sum(first, 12 * d).alias("gradient"), _weighted_sum(second, 12 * d * d).alias("curvature"))


def hessian(mixed: DataFrame, curvature: DataFrame, deltas: DataFrame, x: str = "x") -> DataFrame:
    """Symmetric rows (i, j, h): mixed derivatives mirrored, second derivatives on the diagonal."""
    corners = mixed.groupBy("i", "j").agg(*[
        F.max(F.when((F.col("oi") == a) & (F.col("oj") == b), F.col(x))).alias(f"_o{k}") for k, (a, b) in enumerate(MIXED_WEIGHTS)])
    joined = corners.join(deltas.select(F.col("pos").alias("i"), F.col("delta").alias("_di")), "i").join(
        deltas.select(F.col("pos").alias("j"), F.col("delta").alias("_dj")), "j")
    weights = {f"_o{k}": w for k, w in enumerate(MIXED_WEIGHTS.values())}
    lower = joined.select("i", "j", _weighted_sum(weights, 4 * F.col("_di") * F.col("_dj")).alias("h"))
    upper = lower.select(F.col("j").alias("i"), F.col("i").alias("j"), "h")
    diagonal = curvature.select(F.col("pos").alias("i"), F.col("pos").alias("j"), F.col("curvature").alias("h"))
    return lower.unionByName(upper).unionByName(diagonal)


def gradient_rows(derivatives: DataFrame, fiducial: DataFrame, variance: DataFrame, p: int,
                  pos: str = "pos", gradient: str = "gradient") -> DataFrame:
    """Rows (i, g, v, d0) from one gradient array per parameter, (i, d0) and (i, v)."""
    long = derivatives.select(pos, F.posexplode(gradient).alias("i", "_g"))
    wide = long.groupBy("i").agg(*[F.max(F.when(F.col(pos) == a, F.col("_g"))).alias(f"_g{a}") for a in range(p)])
    return wide.select("i", F.array(*[f"_g{a}" for a in range(p)]).alias("g")).join(fiducial, "i").join(variance, "i")


def _weights(gradients: DataFrame) -> DataFrame:
    """Gradients with the column w = C^-1 g."""
    if "w" in gradients.columns:
        return gradients
    return gradients.withColumn("w", F.transform("g", lambda v: v / F.col("v")))


def block_gradient_rows(derivatives: DataFrame, fiducial: DataFrame, solve: Callable[[DataFrame], DataFrame], keys: list[str],
                        order: str, p: int, pos: str = "pos", gradient: str = "gradient") -> DataFrame:
    """Rows (i, g, w, d0) when each trace has a covariance block.

    `derivatives` has keys, pos and the gradient array of the trace, `fiducial` keys,
    `order` and x; `solve` adds y = C^-1 gradient.  i runs over the traces in `order`.
    """
    solved = solve(derivatives)
    long = solved.select(*keys, pos, F.posexplode(F.arrays_zip(gradient, "y")).alias("_t", "_z"))
    wide = long.groupBy(*keys, "_t").agg(*[
        F.max(F.when(F.col(pos) == a, F.col("_z")[c])).alias(f"_{c}{a}") for a in range(p) for c in (gradient, "y")])
    level = fiducial.select(*keys, order, F.size("x").alias("_n"), F.posexplode("x").alias("_t", "d0"))
    return wide.join(level, [*keys, "_t"]).select(
        (F.col(order) * F.col("_n") + F.col("_t")).cast("int").alias("i"),
        F.array(*[f"_{gradient}{a}" for a in range(p)]).alias("g"), F.array(*[f"_y{a}" for a in range(p)]).alias("w"), "d0")


def fisher_matrix(gradients: DataFrame, p: int, prior_variance: list[float] | None = None) -> np.ndarray:
    """F_ab = g_a C^-1 g_b, symmetrised, plus 1/prior variance on the diagonal.

    p(p+1)/2 sums in one aggregate: no self join of samples.
    """
    pairs = [(a, b) for a in range(p) for b in range(a, p)]
    g, w = F.col("g"), F.col("w")
    row = _weights(gradients).agg(*[F.sum((g[a] * w[b] + g[b] * w[a]) / 2).alias(f"f{a}_{b}") for a, b in pairs]).first()
    out = np.zeros((p, p))
    for a, b in pairs:
        out[a, b] = out[b, a] = row[f"f{a}_{b}"] or 0.0
    if prior_variance is not None:
        out += np.diag(1.0 / np.asarray(prior_variance, float))
    return out


def _bounded_table(df: DataFrame, row_bytes: int, memory: int) -> pa.Table | None:
    """The rows in order of i as one Arrow table if they fit in `memory`, else None.

    They are written once, counted, and come to the driver from all tasks at a time; nothing passes through one task.
    """
    if memory < row_bytes:
        return None
    held = materialise(df, "bounded")
    rows = held.count()
    return held.toArrow().sort_by("i") if 0 < rows <= memory // row_bytes else None


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)


def _small_matrix(gradients: DataFrame, p: int, memory: int) -> tuple | None:
    """(C^-1 G^T, d0) as arrays when p x n fits in `memory`, else None."""
    table = _bounded_table(_weights(gradients).select("i", "w", "d0"), 8 * (p + 1), memory)
    return None if table is None else (_matrix(table, "w"), table.column("d0").to_numpy())


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """`df` with a row number _row, written: both sides of a join back to the rows see the same numbers."""
    return materialise(df.withColumn("_row", F.monotonically_increasing_id()), name)


def _checked(block: np.ndarray, length: int) -> np.ndarray:
    if block.shape[1] != length:
        raise ValueError(f"an array has {block.shape[1]} elements, not {length}")
    return block


def _of_length(array: str, length: Column, value: Column) -> Column:
    """`value` for arrays of that length; null arrays give null, empty ones an empty array, others an error."""
    wrong = F.raise_error(F.format_string("%s has %d elements, not %d", F.lit(array), F.size(array), length)).cast("array<double>")
    return F.when(F.col(array).isNull(), F.lit(None)).when(F.size(array) == 0, F.array().cast("array<double>")).when(
        F.size(array) == length, value).otherwise(wrong)


def scores(records: DataFrame, gradients: DataFrame, p: int, x: str = "x", out: str = "score",
           prior_term: list[float] | None = None, memory: int = MATRIX_BYTES) -> DataFrame:
    """s_a = g_a C^-1 (D - D0) (+ prior term) for every record.

    A gradient within `memory` is broadcast and records are multiplied batch by batch
    without a shuffle; a larger one is joined sample by sample.  Either way every record
    stays one row: a null record has a null score, a null sample makes it NaN, and a
    record of another length than the gradient is an error.
    """
    prior = np.zeros(p) if prior_term is None else np.asarray(prior_term, float)
    small = _small_matrix(gradients, p, memory)
    if small is not None:
        shared = records.sparkSession.sparkContext.broadcast(small)

        @F.arrow_udf("array<double>")
        def job(traces: pa.Array) -> pa.Array:
            weights, centre = shared.value
            return on_blocks(traces, lambda block: (_checked(block, len(centre)) - centre) @ weights + prior)

        return records.withColumn(out, job(F.col(x)))
    held, weights = _numbered(records, "scores"), _weights(gradients)
    long = held.select("_row", F.posexplode(x).alias("i", "_x")).join(weights, "i")
    sample = F.coalesce("_x", F.lit(float("nan"))) - F.col("d0")
    sums = long.groupBy("_row").agg(F.array(*[F.sum(F.col("w")[a] * sample) + float(prior[a]) for a in range(p)]).alias("_sums"))
    length = weights.agg(F.count(F.lit(1)).alias("_length")).scalar()
    summed = held.join(sums, "_row", "left").withColumn(out, _of_length(x, length, F.col("_sums")))
    return summed.drop("_row", "_sums")


def score_terms(records: DataFrame, gradients: DataFrame, keys: list[str], p: int, x: str = "x") -> DataFrame:
    """The sum of `scores` left open: one row per record and sample, an array over parameters."""
    long = records.select(*keys, F.posexplode(x).alias("i", "_x")).join(gradients, "i")
    return long.select(*keys, "i", F.array(*[
        F.col("g")[a] * (F.col("_x") - F.col("d0")) / F.col("v") for a in range(p)]).alias("terms"))


def estimates(scored: DataFrame, fisher: np.ndarray, theta: list[float], damping: float | None = None,
              score: str = "score", out: str = "estimate") -> DataFrame:
    """theta + F^-1 s, with F + damping diag F when damped."""
    matrix = fisher if not damping else fisher + damping * np.diag(np.diag(fisher))
    inverse = np.linalg.inv(matrix)

    def element(a: int) -> Column:
        total = F.lit(float(theta[a]))
        for b in np.flatnonzero(inverse[a]).tolist():
            total = total + F.lit(float(inverse[a, b])) * F.col(score)[b]
        return total

    return scored.withColumn(out, F.array(*[element(a) for a in range(len(theta))]))


def stacked_points(tables: list[DataFrame]) -> DataFrame:
    """Gradient tables of several expansion points side by side: (i, g, w, d0, shift).

    g and w are the arrays of all points end to end and d0 that of the first point; `shift` holds the part of each
    score that comes from the difference of the fiducial values, w (d0 of the first point - own d0).
    """
    out = None
    for k, table in enumerate(tables):
        own = _weights(table).select("i", F.col("g").alias(f"_g{k}"), F.col("w").alias(f"_w{k}"), F.col("d0").alias(f"_d{k}"))
        out = own if out is None else out.join(own, "i")
    every = range(len(tables))
    shift = F.concat(*[_shifted(k) for k in every])
    return out.select("i", F.concat(*[f"_g{k}" for k in every]).alias("g"), F.concat(*[f"_w{k}" for k in every]).alias("w"), F.col("_d0").alias("d0"), shift.alias("shift"))


def _shifted(k: int) -> Column:
    return F.transform(f"_w{k}", lambda v: v * (F.col("_d0") - F.col(f"_d{k}")))


def estimates_at_points(records: DataFrame, points: list[tuple[DataFrame, list[float]]], x: str = "x", out: str = "estimate", damping: float | None = None,
                        prior: tuple | None = None, **way) -> DataFrame:
    """theta_k + F_k^-1 s_k of every expansion point k, end to end, by one product per record.

    The weights of all points form one matrix, so the records are read once and not shuffled, however many points
    there are. `prior` is a mean and its variances, the same for all points.
    """
    p = len(points[0][1])
    stacked = materialise(stacked_points([g for g, _ in points]), "points")
    size = p * len(points)
    blocks_only = np.kron(np.eye(len(points)), np.ones((p, p)))
    fisher = fisher_matrix(stacked, size, None if prior is None else list(prior[1]) * len(points)) * blocks_only
    offset = np.array(stacked.agg(F.array(*[F.sum(F.col("shift")[a]) for a in range(size)])).first()[0], float)
    theta = [t for _, own in points for t in own]
    if prior is not None:
        offset += np.array([(m - t) / v for _, own in points for m, v, t in zip(*prior, own, strict=True)])
    scored = scores(records, stacked, size, x, "_score", prior_term=offset.tolist(), **way)
    inverse = np.linalg.inv(fisher if not damping else fisher + damping * np.diag(np.diag(fisher)))
    lines = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.array(*[F.lit(float(v)) for v in line]).alias("line")) for t, line in zip(theta, inverse, strict=True)])
    product = F.transform(lines, lambda r: r["t"] + F.aggregate(F.zip_with(r["line"], "_score", lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v))
    return scored.withColumn(out, F.when(F.col("_score").isNotNull(), product)).drop("_score")


def observed_information(records: DataFrame, gradients: DataFrame, fisher: np.ndarray, p: int, x: str = "x", score: str = "score", out: str = "information", **way) -> DataFrame:
    """Score and observed information F - (second derivatives) C^-1 (D - D0) of each record, from one product.

    `gradients` holds the p first and p * p second derivatives side by side.
    """
    both = scores(records, gradients, p + p * p, x, "_both", **way)
    flat = [float(v) for v in np.asarray(fisher).ravel()]
    return both.withColumns({score: F.slice("_both", 1, p), out: F.zip_with(F.array(*[F.lit(v) for v in flat]), F.slice("_both", p + 1, p * p), lambda f, h: f - h)}).drop("_both")


def stack_estimates(parts: DataFrame, keys: list[str], point: str, estimate: str = "estimate", out: str = "stacked") -> DataFrame:
    """Estimates from several expansion points side by side, in point order."""
    packed = F.array_sort(F.collect_list(F.struct(point, estimate)))
    return parts.groupBy(*keys).agg(F.flatten(F.transform(packed, lambda s: s[estimate])).alias(out))


def linear_log_likelihood(df: DataFrame, theta: str, fiducial: list[float], score: str = "score", base: float = 0.0) -> Column:
    """L0 + (theta - fiducial) . s"""
    total = F.lit(base)
    for a, f in enumerate(fiducial):
        total = total + (F.col(theta)[a] - F.lit(float(f))) * F.col(score)[a]
    return total


def synthesize(params: DataFrame, kernels: DataFrame, p: int, theta: str = "theta", out: str = "x", factor: float = 1.0,
               memory: int = MATRIX_BYTES) -> DataFrame:
    """x(i) = factor * sum_a theta_a K_a(i); kernels are rows (i, g array<double>).

    Kernels beyond `memory` are packed into blocks of samples and joined block by block: a row and a block give
    a piece of the record at once, and only pieces are put together.  Either way every row of `params`
    stays one row: a null vector has a null record, a null element makes it NaN, and a
    vector of another length than p is an error.
    """
    table = _bounded_table(kernels.select("i", "g"), 8 * p, memory)
    if table is not None:
        shared = params.sparkSession.sparkContext.broadcast(_matrix(table, "g").T * factor)

        @F.arrow_udf("array<double>")
        def job(thetas: pa.Array) -> pa.Array:
            return on_blocks(thetas, lambda block: _checked(block, p) @ shared.value)

        return params.withColumn(out, job(F.col(theta)))
    held = _numbered(params, "synthesize")
    kernels = materialise(kernels.select("i", "g"), "kernels")
    rows, samples = held.count(), kernels.count()
    groups, parts = rows // GROUP_ROWS + 1, max(params.sparkSession.sparkContext.defaultParallelism, -(-rows * 8 * (samples + 16) // PART_BYTES))
    sample = F.struct(F.col("i"), F.col("g"))
    packed = kernels.groupBy(F.coalesce(F.floor(F.col("i") / BLOCK_SAMPLES), F.lit(-1)).alias("_block")).agg(F.array_sort(F.collect_list(sample)).alias("_k"))
    # written, so that Spark joins the copies by their known size
    packed = materialise(packed.select("_block", F.transform("_k", lambda s: s["g"]).alias("_k"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group")), "blocks")
    vectors = held.where(F.size(theta) == p).select("_row", F.pmod("_row", F.lit(groups)).cast("int").alias("_group"), F.col(theta).alias("_m")).repartition(parts, "_row")
    named = vectors.crossJoin(packed.select("_block").distinct()) if samples > BLOCK_SAMPLES else vectors
    joined = named.join(packed, ["_group", "_block"] if samples > BLOCK_SAMPLES else ["_group"])
    nan = F.lit(float("nan"))
    dot = lambda g: sum((F.coalesce(F.col("_m")[a], nan) * F.coalesce(g[a], nan) for a in range(1, p)), F.coalesce(F.col("_m")[0], nan) * F.coalesce(g[0], nan)) * factor
    piece = F.struct("_block", F.transform("_k", dot).alias("_v"))
    kind = "struct<_block:bigint,_v:array<double>>"
    pieces = joined.select("_row", piece.cast(kind).alias("_piece"), F.lit(None).cast(params.select(F.struct(*params.columns)).schema[0].dataType).alias("_own"))
    whole = held.select("_row", F.lit(None).cast(kind).alias("_piece"), F.struct(*params.columns).alias("_own"))
    met = pieces.unionByName(whole).repartition(parts, "_row").groupBy("_row").agg(F.first("_own", ignorenulls=True).alias("_own"), F.array_sort(F.collect_list("_piece")).alias("_pieces"))
    record = F.flatten(F.transform("_pieces", lambda s: s["_v"]))
    return met.select("_own.*", record.alias("_made")).withColumn(out, _of_length(theta, F.lit(p), F.col("_made"))).drop("_made")


def log_prior(u: str, theta: str | None = None, mean: list[float] | None = None, variance: list[float] | None = None) -> Column:
    """0 inside the unit box, -inf outside; with a mean -1/2 sum (theta-mean)^2/variance inside."""
    inside = F.forall(F.col(u), lambda v: (v >= 0) & (v <= 1))
    value = F.lit(0.0)
    for a, (m, s) in enumerate(zip(mean or [], variance or [])):
        d = F.col(theta)[a] - F.lit(float(m))
        value = value - d * d / (2 * float(s))
    return F.when(inside, value).otherwise(F.lit(float("-inf")))


def log_likelihood(x: str, obs: str, variance: str) -> Column:
    """-1/2 chi-square of a synthetic against its observation, independent noise."""
    square = F.aggregate(F.zip_with(x, obs, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)
    return -square / F.col(variance) / 2


def fisher_bounds(bounds: DataFrame, theta: list[float], fisher: np.ndarray, sigmas: float, depth_kind: str = "depth") -> DataFrame:
    """New uniform bounds theta -/+ k sqrt(diag F^-1), inside the old ones, depth not below 0.

    Clipped element by element; `bounds` has pos, kind, lo, hi, sampling.
    """
    margin = sigmas * np.sqrt(np.diag(np.linalg.inv(fisher)))
    centre = F.array(*[F.lit(float(t)) for t in theta])
    reach = F.array(*[F.lit(float(m)) for m in margin])
    lo = F.greatest(F.col("lo"), centre[F.col("pos")] - reach[F.col("pos")])
    hi = F.least(F.col("hi"), centre[F.col("pos")] + reach[F.col("pos")])
    return bounds.withColumns({
        "lo": F.when(F.col("kind") == depth_kind, F.greatest(lo, F.lit(0.0))).otherwise(lo), "hi": hi, "sampling": F.lit("uniform")})


def _damp(damping: np.ndarray, misfit: np.ndarray, before: np.ndarray) -> np.ndarray:
    return np.where(misfit > 0.99 * before, damping * 1.2, damping / 1.5)


def solve_linear(scored: DataFrame, fisher: np.ndarray, theta: list[float], n: int, misfit: str, iterations: int = 20,
                 damping: float = 0.001, adaptive: bool = True, score: str = "score") -> DataFrame:
    """Damped Gauss-Newton of many events at once when the forward model is linear.

    `score` and `misfit` (the chi-square per sample at the start) are all that an event
    needs: later scores and misfits follow from them and F.  Adds theta, chi2, iteration
    of the best step and theta_last.
    """
    p = len(theta)

    @F.pandas_udf(f"theta array<double>, chi2 double, iteration int, theta_last array<double>")
    def job(s: pd.Series, q: pd.Series) -> pd.DataFrame:
        base = np.stack([np.asarray(v, float) for v in s])
        start = q.to_numpy(float) * n
        move = np.zeros((len(base), p))
        lam = np.full(len(base), float(damping))
        before = np.full(len(base), np.inf)
        best, best_at, best_move = np.full(len(base), np.inf), np.full(len(base), -1), move.copy()
        for it in range(iterations):
            chi = (start - 2 * (move * base).sum(1) + np.einsum("ea,ab,eb->e", move, fisher, move)) / n
            better = chi < best
            best, best_at = np.where(better, chi, best), np.where(better, it, best_at)
            best_move = np.where(better[:, None], move, best_move)
            if adaptive:
                lam, before = _damp(lam, chi, before), chi
            left = fisher + lam[:, None, None] * np.diag(np.diag(fisher))
            move = move + np.linalg.solve(left, (base - move @ fisher)[:, :, None])[:, :, 0]
        centre = np.asarray(theta, float)
        return pd.DataFrame({"theta": list(centre + best_move), "chi2": best, "iteration": best_at, "theta_last": list(centre + move)})

    return scored.withColumn("_s", job(F.col(score), F.col(misfit))).select(*scored.columns, "_s.*")


def stacked_derivatives(simulated: DataFrame, observations: DataFrame, trace: list[str], deltas: list[float], out: str = "x") -> DataFrame:
    """Per trace the p gradients and the residual end to end: observations joined with (trace, pos, offset, x) of a stencil.

    pos -1 is the simulation at the centre. A trace without an observation or without a simulation is left out.
    """
    p, offsets = len(deltas), sorted(FIRST_WEIGHTS)
    weights = np.zeros((p, 1 + p * len(offsets)))
    for a in range(p):
        for o, offset in enumerate(offsets):
            weights[a, 1 + a * len(offsets) + o] = FIRST_WEIGHTS[offset] / (12 * deltas[a])
    in_order = F.array_sort(F.collect_list(F.struct("pos", "offset", "x")))
    packed = simulated.groupBy(*trace).agg(F.flatten(F.transform(in_order, lambda s: s["x"])).alias("_flat"))

    @F.arrow_udf("array<double>")
    def job(flat: pa.Array, obs: pa.Array) -> pa.Array:
        parts = []
        for rows, block in blocks(obs):
            table = np.stack([np.asarray(v, float) for v in flat.take(pa.array(rows)).to_numpy(zero_copy_only=False)])
            table = _checked(table, weights.shape[1] * block.shape[1]).reshape(len(rows), weights.shape[1], -1)
            parts.append((rows, np.concatenate([np.einsum("pk,rkn->rpn", weights, table).reshape(len(rows), -1), block - table[:, 0]], axis=1)))
        return lists_of(len(obs), parts)

    both = join_same(observations, packed, trace)
    return both.withColumn(out, job(F.col("_flat"), F.col("obs"))).drop("_flat")


def solve_iterative(
    observations: DataFrame, start: DataFrame, simulate: Callable[[DataFrame], DataFrame], deltas: list[float], variance: float | None = None,
    iterations: int = 20, damping: float = 0.001, adaptive: bool = True, single_step: bool = False, trace: list[str] | None = None,
    factors: DataFrame | None = None, factor_keys: list[str] | None = None, prior: tuple | None = None, tolerance: float | None = None, **way,
) -> DataFrame:
    """Damped Gauss-Newton for any forward model, all events of a step in one job.

    observations (event, `trace` columns, obs array), start (event, theta array); `simulate` maps rows
    (event, pos, offset, theta) to rows with the `trace` columns and x array. The noise is `variance` or a
    table of `factors` with the observation columns `factor_keys`, see `factors`. A prior is its mean and
    its variances or its covariance matrix; its precision joins F, and its pull the score.

    Each trace gives the products of its gradients and residual with C^-1, p(p+3)/2+1 numbers, which are
    summed per event by partial aggregates: an event may have any number of traces in any number of tasks.
    An event stops once chi2 changes by no more than `tolerance` of it. The state of p numbers per event is
    written to the shared folder after each step, so lineage stays short. `single_step` is two undamped
    steps. An event of which a trace has no covariance or a null sample, and one without a trace, has null
    results in its first step and no further ones.

    Returns the history (event, iteration, theta, chi2, objective, converged): theta before the step, chi2 per
    sample, and the chi-square plus that of the prior.
    """
    p, trace = len(deltas), list(trace or [])
    if single_step:
        iterations, damping, adaptive = 2, 0.0, False
    mean, precision = np.zeros(p), np.zeros((p, p))
    if prior is not None:
        mean, spread = np.asarray(prior[0], float), np.asarray(prior[1], float)
        precision = np.diag(1 / spread) if spread.ndim == 1 else np.linalg.inv(spread)
    spark = observations.sparkSession
    if factors is None:
        if variance is None:
            raise ValueError("give a variance or a table of factors")
        factors = diagonal_factors(spark.range(1).select(F.lit(float(variance)).alias("variance")), [])
    shifts = [(-1, 0, 0.0)] + [(a, o, o * deltas[a]) for a in range(p) for o in FIRST_WEIGHTS]
    moves = F.array(*[F.struct(F.lit(a).alias("pos"), F.lit(o).alias("offset"), F.lit(float(s)).alias("s")) for a, o, s in shifts])
    upper = np.triu_indices(p + 1)

    @F.pandas_udf("theta array<double>, chi2 double, objective double, next array<double>, damping double, converged boolean")
    def step(sums: pd.Series, samples: pd.Series, centre: pd.Series, lam: pd.Series, before: pd.Series) -> pd.DataFrame:
        theta = np.stack([np.asarray(c, float) for c in centre])
        forms = np.full((len(theta), p + 1, p + 1), np.nan)
        forms[:, upper[0], upper[1]] = np.stack([np.full(len(upper[0]), np.nan) if s is None else np.asarray(s, float) for s in sums])
        forms[:, upper[1], upper[0]] = forms[:, upper[0], upper[1]]
        chi, last = forms[:, p, p] / samples.to_numpy(float), before.to_numpy(float)
        lam = lam.to_numpy(float)
        lam = _damp(lam, chi, last) if adaptive else lam
        fisher = forms[:, :p, :p] + precision
        score = forms[:, :p, p] + (mean - theta) @ precision
        usable = np.isfinite(forms).all(axis=(1, 2))
        left = np.where(usable[:, None, None], fisher + lam[:, None, None] * fisher * np.eye(p), np.eye(p))
        move = np.where(usable[:, None], np.linalg.solve(left, np.where(usable[:, None], score, 0.0)[:, :, None])[:, :, 0], np.nan)
        pull = np.einsum("ea,ab,eb->e", theta - mean, precision, theta - mean)
        done = ~usable | (np.abs(last - chi) <= (-1.0 if tolerance is None else tolerance) * np.abs(chi))
        none = [None if not u else v for u, v in zip(usable, theta + move)]
        return pd.DataFrame({"theta": list(theta), "chi2": pd.Series(chi, dtype="Float64").where(usable), "objective": pd.Series(forms[:, p, p] + pull, dtype="Float64").where(usable),
                             "next": none, "damping": lam, "converged": done})

    state = start.select("event", "theta", F.lit(0).alias("iteration"), F.lit(float(damping)).alias("damping"), F.lit(float("inf")).alias("before"))
    history = None
    for it in range(iterations):
        moved = state.withColumn("_m", F.explode(moves)).select(
            "event", "_m.pos", "_m.offset",
            F.transform("theta", lambda v, k: v + F.when(k == F.col("_m.pos"), F.col("_m.s")).otherwise(0.0)).alias("theta"))
        stacked = stacked_derivatives(simulate(moved).select("event", *trace, "pos", "offset", "x"), observations, ["event", *trace], deltas)
        forms = quadratic_forms(stacked.withColumn("_n", F.size("obs")), factors, list(factor_keys or []), p + 1, forms="_forms", **way)
        whole = F.count("_forms") == F.count(F.lit(1))
        sums = forms.groupBy("event").agg(F.sum("_n").alias("_n"), F.when(whole, F.array(*[F.sum(F.col("_forms")[i]) for i in range(len(upper[0]))])).alias("_sums"))
        named = sums.withColumnRenamed("event", "_event")
        joined = state.join(named, state["event"].eqNullSafe(named["_event"]), "left").drop("_event")
        stepped = joined.withColumn("_s", step("_sums", F.coalesce("_n", F.lit(1)), "theta", "damping", "before"))
        done = materialise(stepped.select("event", "iteration", "_s.*"), f"least-squares-{it}")
        part = done.select("event", "iteration", "theta", "chi2", "objective", "converged")
        history = part if history is None else history.unionByName(part)
        live = done.where(~F.col("converged"))
        state = live.select("event", F.col("next").alias("theta"), F.lit(it + 1).alias("iteration"), "damping", F.col("chi2").alias("before"))
        if live.isEmpty():
            break
    return history


def candidate_log_likelihood(residuals: DataFrame, factors: DataFrame, by: list[str], factor_keys: list[str], x: str = "x", **way) -> DataFrame:
    """Log-likelihood of every candidate `by` from the residual traces of it, each with the covariance of its key.

    chi2 = sum of r C^-1 r over the traces; log_likelihood = -chi2 / 2; normalised adds -(log det C + n log 2 pi) / 2.
    Traces are reduced to two numbers in their tasks and summed by partial aggregates. A candidate of which
    a trace has no covariance (or is null) has nulls.
    """
    forms = quadratic_forms(residuals.select(*by, *[k for k in factor_keys if k not in by], x), factors, factor_keys, x=x, forms="_forms", log_det="_log_det", **way)
    whole = F.count("_forms") == F.count(F.lit(1))
    sums = forms.groupBy(*by).agg(*[F.when(whole, F.sum(c)).alias(n) for n, c in {
        "chi2": F.col("_forms")[0], "log_det": F.col("_log_det"), "_n": F.size(x)}.items()])
    half = -F.col("chi2") / 2
    return sums.select(*by, "chi2", "log_det", half.alias("log_likelihood"),
                       (half - (F.col("log_det") + F.col("_n") * float(np.log(2 * np.pi))) / 2).alias("normalised"))
