"""Choices by name: covariance blocks, noise models and compressors, as DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwave.operators import compression as C
from quietwave.operators import covariance as V
from quietwave.operators import noise as N
from quietwave.operators.pairing import pair_with_noise
from quietwave.operators.priors import gaussian_noise
from quietwave.session import materialise


def _scalar(cov: DataFrame, keys: list[str], n: int, noise_level: float = 1.0, **_) -> DataFrame:
    flat = cov.select(*keys).distinct().withColumn("variance", F.lit(float(noise_level) ** 2))
    return V.diagonal_rows(flat, keys, n)


def _diagonal(cov: DataFrame, keys: list[str], n: int, **_) -> DataFrame:
    return V.diagonal_rows(N.lag_zero(cov, keys), keys, n)


def _empirical(cov: DataFrame, keys: list[str], n: int, fit_length: int | None = 20, **_) -> DataFrame:
    head = cov.where(F.col("k") < n)
    if fit_length:
        head = N.taper_covariance(head, keys, fit_length, ols=False).withColumn("c", F.col("tapered"))
    return V.toeplitz_rows(head.select(*keys, "k", "c"), keys)


def _filtered(cov: DataFrame, keys: list[str], n: int, low: float = 0.02, high: float = 0.05, rate: float = 1.0, **_) -> DataFrame:
    return V.toeplitz_rows(N.band_limited_columns(N.lag_zero(cov, keys), n, low, high, rate).select(*keys, "k", "c"), keys)


def _damped(cov: DataFrame, keys: list[str], n: int, omega: float = 4.4, decay: float = 1 / 20, **_) -> DataFrame:
    return V.toeplitz_rows(N.damped_cosine_columns(N.lag_zero(cov, keys), n, omega, decay).select(*keys, "k", "c"), keys)


def _theory(cov: DataFrame, keys: list[str], n: int, theory: DataFrame | None = None, data: str = "empirical_block",
            diagonal_share: float = 0.0, **options) -> DataFrame:
    return V.add_covariances(theory, COVARIANCES[data](cov, keys, n, **options), keys, diagonal_share)


# name -> (cov (keys, k, c), keys, n, options) -> block rows (keys, t, row)
COVARIANCES: dict[str, Callable[..., DataFrame]] = {
    "noise_level": _scalar,
    "empirical_diagonal": _diagonal,
    "empirical_block": _empirical,
    "filtered_block": _filtered,
    "kolb": _damped,
    "theory_block": _theory,
}


def covariance(name: str, cov: DataFrame, keys: list[str], n: int, **options) -> DataFrame:
    if name not in COVARIANCES:
        raise KeyError(f"unknown covariance {name}")
    return COVARIANCES[name](cov, keys, n, **options)


def _white(records: DataFrame, keys: list[str], n: int, stream: str, noise_level: float = 1.0, **_) -> DataFrame:
    return gaussian_noise(records, keys, n, F.lit(float(noise_level)), stream)


def _coloured(records: DataFrame, keys: list[str], n: int, stream: str, blocks: DataFrame | None = None, trace: list[str] | None = None, **_) -> DataFrame:
    white = gaussian_noise(records, keys, n, F.lit(1.0), stream, out="_z")
    return V.apply_blocks(white, blocks, trace, "colour", x="_z", out="noise").drop("_z")


def _real(records: DataFrame, keys: list[str], n: int, stream: str, catalogue: DataFrame | None = None, order: list[str] | None = None,
          fixed: int | None = None, **_) -> DataFrame:
    return pair_with_noise(records, catalogue, keys[0], order, stream, fixed)


# name -> (records, keys, n, stream, options) -> records with a noise array
NOISE_MODELS: dict[str, Callable[..., DataFrame]] = {
    "gaussian": _white,
    "gaussian_filtered": _coloured,
    "empirical_gaussian": _coloured,
    "real_noise": _real,
}


def _first_order(records: DataFrame, gradients: DataFrame, theta: list[float], damping: float | None = None, **options) -> DataFrame:
    p = len(theta)
    gradients = materialise(gradients, "gradients")  # read by the Fisher matrix and the scores
    prior = options.get("prior_variance")
    fisher = C.fisher_matrix(gradients, p, prior)
    term = None
    if prior is not None:
        term = [(m - t) / v for m, t, v in zip(options["prior_mean"], theta, prior)]
    return C.estimates(C.scores(records, gradients, p, prior_term=term), fisher, theta, damping)


def _many_points(records: DataFrame, points: list[tuple[DataFrame, list[float]]], keys: list[str], damping: float | None = None, **options) -> DataFrame:
    prior = (options["prior_mean"], options["prior_variance"]) if options.get("prior_variance") is not None else None
    return C.estimates_at_points(records, points, damping=damping, prior=prior).select(*keys, "estimate")


def _second_order(records: DataFrame, gradients: DataFrame, p: int, **_) -> DataFrame:
    """`gradients` holds the p first and p*p second derivatives side by side."""
    return C.scores(records, gradients, p + p * p, out="estimate")


# name -> DataFrame function adding the compressed statistics as `estimate`
COMPRESSORS: dict[str, Callable[..., DataFrame]] = {
    "optimal_score": _first_order,
    "theory_optimal_score": _first_order,
    "multi_optimal_score": _many_points,
    "second_order_score": _second_order,
}
