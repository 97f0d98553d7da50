"""Named parameter groups: map<string,array<double>> to vectors and back, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_vector(groups: str | Column, order: list[str]) -> Column:
    """Values of the groups, one after the other in `order`."""
    groups = F.col(groups) if isinstance(groups, str) else groups
    return F.flatten(F.array(*[groups[name] for name in order]))


def to_groups(vector: str | Column, sizes: dict[str, int]) -> Column:
    """Cut a vector into named groups of the given sizes."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    parts, at = [], 1
    for name, size in sizes.items():
        parts += [F.lit(name), F.slice(vector, at, size)]
        at += size
    return F.create_map(*parts)


def with_nuisance(vector: str | Column, sizes: dict[str, int], nested: list[str]) -> Column:
    """As `to_groups`, but each `nested` group takes one entry, itself an array of values."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    parts, at = [], 1
    for name, size in sizes.items():
        if name in nested:
            parts += [F.lit(name), vector[at - 1]]
            at += 1
        else:
            parts += [F.lit(name), F.flatten(F.slice(vector, at, size))]
            at += size
    return F.create_map(*parts)


def change_entry(vector: str | Column, index: int, value: Column) -> Column:
    """The vector with one entry replaced."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(vector, lambda v, i: F.when(i == index, value).otherwise(v))


def fingerprint(groups: str | Column, order: list[str]) -> Column:
    """First 8 hex digits of MD5 over the values in a fixed order."""
    groups = F.col(groups) if isinstance(groups, str) else groups
    text = F.concat_ws(";", *[F.concat(F.lit(f"{name}="), F.concat_ws(",", groups[name].cast("array<string>"))) for name in order])
    return F.substring(F.md5(text.cast("binary")), 1, 8)
