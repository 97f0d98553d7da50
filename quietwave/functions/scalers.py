"""Parameter scalers as column expressions, with their inverses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_unit(x: Column, lo: Column, hi: Column) -> Column:
    """(x - lo) / (hi - lo); null for a pinned parameter (lo = hi)."""
    return F.try_divide(x - lo, hi - lo)


def from_unit(u: Column, lo: Column, hi: Column) -> Column:
    return u * (hi - lo) + lo


def signed_log(x: Column, lo: Column, hi: Column) -> Column:
    """Sign-preserving log10 scale of |x| in [lo, hi], mapped to [0, 1] around 0.5."""
    size = F.log10(F.greatest(lo, F.least(hi, F.abs(x))))
    return F.try_divide(F.signum(x) * (size - F.log10(lo)), F.log10(hi) - F.log10(lo)) * 0.5 + 0.5


def signed_log_inverse(u: Column, lo: Column, hi: Column) -> Column:
    v = (u - 0.5) / 0.5
    size = F.pow(F.lit(10.0), F.abs(v) * (F.log10(hi) - F.log10(lo)) + F.log10(lo))
    return F.signum(v) * F.greatest(lo, F.least(hi, size))


def linear_log(x: Column, lo: Column, hi: Column, linear: float = 0.05) -> Column:
    """Linear up to `lo`, log10 from `lo` to `hi`; the scale restarts at 0 where the log part begins."""
    size = F.least(hi, F.abs(x))
    log_part = F.try_divide(F.lit(0.5 - linear) * (F.log10(F.greatest(size, lo)) - F.log10(lo)), F.log10(hi) - F.log10(lo))
    return F.signum(x) * F.when(size <= lo, size / lo * F.lit(linear)).otherwise(log_part) + 0.5


def linear_log_inverse(u: Column, lo: Column, hi: Column, linear: float = 0.05) -> Column:
    v = u - 0.5
    size = F.when(F.abs(v) <= linear, F.abs(v) / linear * lo).otherwise(
        F.pow(F.lit(10.0), F.abs(v) / (0.5 - linear) * (F.log10(hi) - F.log10(lo)) + F.log10(lo)))
    return F.signum(v) * F.greatest(F.lit(0.0), F.least(hi, size))


# scaler name -> (forward, inverse); both take (value, lo, hi) columns
SCALERS = {
    "unit": (to_unit, from_unit),
    "signed log": (signed_log, signed_log_inverse),
    "linear log": (linear_log, linear_log_inverse),
}


def scale_by_type(kind: Column, x: Column, lo: Column, hi: Column, choice: dict[str, str], inverse: bool = False) -> Column:
    """Apply the scaler chosen for each parameter type."""
    out = None
    for name, scaler in choice.items():
        value = SCALERS[scaler][1 if inverse else 0](x, lo, hi)
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out


# Kilometres per degree of latitude, and of longitude in the study area.
KM_PER_DEGREE_LATITUDE = 111.1
KM_PER_DEGREE_LONGITUDE = 86


def degrees_to_km(value: Column, minimum: Column, axis: str) -> Column:
    scale = KM_PER_DEGREE_LATITUDE if axis == "latitude" else KM_PER_DEGREE_LONGITUDE
    return (value - minimum) * F.lit(float(scale))


def power_of_ten_below(x: Column) -> Column:
    return F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))))


def tensor_plot_unit(x: Column, bound: Column) -> Column:
    """Ten times x over the power of ten below the bound."""
    return 10 * x / power_of_ten_below(bound)
