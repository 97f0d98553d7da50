"""Array expressions on whole traces; JVM side, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(x: str | Column) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda acc, v: acc + v)


def mean(x: str | Column) -> Column:
    return F.try_divide(total(x), F.size(_c(x)).cast("double"))


def dot(x: str | Column, y: str | Column) -> Column:
    return total(F.zip_with(_c(x), _c(y), lambda a, b: a * b))


def power(x: str | Column) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda acc, v: acc + v * v)


def subtract(x: str | Column, y: str | Column) -> Column:
    return F.zip_with(_c(x), _c(y), lambda a, b: a - b)


def add(x: str | Column, y: str | Column) -> Column:
    return F.zip_with(_c(x), _c(y), lambda a, b: a + b)


def minus_scalar(x: str | Column, value: Column) -> Column:
    """x - value; the scalar is an argument, so it is evaluated once per trace."""
    return F.zip_with(_c(x), F.array_repeat(value, F.size(_c(x))), lambda a, b: a - b)


def over_scalar(x: str | Column, value: Column) -> Column:
    return F.zip_with(_c(x), F.array_repeat(value, F.size(_c(x))), lambda a, b: F.try_divide(a, b))


def centred(x: str | Column) -> Column:
    return minus_scalar(x, mean(x))


def variance(x: str | Column) -> Column:
    """Population variance, one pass (Welford)."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))

    def step(acc: Column, v: Column) -> Column:
        n = acc["n"] + 1
        m = acc["m"] + (v - acc["m"]) / n
        return F.struct(n.alias("n"), m.alias("m"), (acc["s"] + (v - acc["m"]) * (v - m)).alias("s"))

    return F.aggregate(_c(x), start, step, lambda acc: F.try_divide(acc["s"], acc["n"].cast("double")))


def scaled(x: str | Column, factor: Column) -> Column:
    return F.transform(_c(x), lambda v: v * factor)


def zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0.0), n.cast("int"))


def shift(x: str | Column, samples: str | Column) -> Column:
    """Zero-padded shift: right (delay) for positive `samples`, left for negative."""
    x, samples = _c(x), _c(samples).cast("int")
    n = F.size(x)
    by = F.least(n, F.abs(samples))
    return F.when(samples >= 0, F.concat(zeros(by), F.slice(x, F.lit(1), n - by))).otherwise(
        F.concat(F.slice(x, by + 1, n - by), zeros(by))
    )


def cosine_taper(x: str | Column, fraction: float) -> Column:
    """Cosine ramp over int(fraction*n) samples at each end, at most half the trace."""
    x = _c(x)
    n = F.size(x)
    width = F.least(F.floor(F.lit(fraction) * n), F.floor(n / 2))

    def weigh(v: Column, i: Column) -> Column:
        j = F.least(i, n - 1 - i)
        ramp = (1 - F.cos(F.pi() * j / F.greatest(width - 1, F.lit(1)))) / 2
        return F.when(j < width, v * ramp).otherwise(v)

    return F.transform(x, weigh)


def pad(x: str | Column, before: Column, after: Column) -> Column:
    return F.concat(zeros(before), _c(x), zeros(after))


def cut(x: str | Column, start: Column, count: Column) -> Column:
    """`count` samples from 0-based `start`; zeros where the trace has none."""
    x = _c(x)
    n = F.size(x)
    lo = F.least(n, F.greatest(F.lit(0), start))
    hi = F.greatest(lo, F.least(n, start + count))
    left = F.least(count, F.greatest(F.lit(0), -start))
    return F.concat(
        zeros(left), F.slice(x, (lo + 1).cast("int"), (hi - lo).cast("int")),
        zeros(F.greatest(F.lit(0), count - left - (hi - lo))),
    )
