"""Registered queries: the operators bound to the driver tables, each with its DuckDB check."""

from workbook import (  # noqa: F401
    compression, covariances, inference, intake, live, metrics, posteriors, priors, tensors, traces, windows,
)
from workbook.registry import CHECKS, QUERIES  # noqa: F401
