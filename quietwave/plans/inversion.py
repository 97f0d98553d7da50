"""Compress an ensemble of simulations to one estimate per record."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quietwave.operators.compression import estimates, fisher_matrix, scores
from quietwave.operators.pairing import inject_noise
from quietwave.session import materialise


def compress_ensemble(pairs: DataFrame, gradients: DataFrame, theta: list[float]) -> tuple[DataFrame, np.ndarray]:
    """Noise added to each record, then its estimate; keeps the true parameters beside it.

    `pairs` has x, noise and any further columns.  Returns the records with `estimate`
    and the Fisher matrix.
    """
    p = len(theta)
    gradients = materialise(gradients, "gradients")  # read by the Fisher matrix and the scores
    fisher = fisher_matrix(gradients, p)
    noisy = inject_noise(pairs).drop("x", "noise")
    return estimates(scores(noisy, gradients, p, "y"), fisher, theta).drop("y", "score"), fisher
