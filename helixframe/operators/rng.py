"""Randomness that depends on keys only: the same for any partitioning and any order of rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def uniform(key: Column, salt: Column | str) -> Column:
    """A number in [0, 1) from the first 32 bits of md5(key|salt)."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit("|"), salt).cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def pick(values: Column, u: Column) -> Column:
    """The value at floor(u * n) of an array; null if it is empty."""
    return F.get(values, F.least(F.floor(u * F.size(values)), F.size(values) - 1).cast("int"))


def normal(key: Column, salt: str, mean: float, sd: float) -> Column:
    """Box-Muller from two uniforms."""
    u, v = uniform(key, salt + ":u"), uniform(key, salt + ":v")
    return F.lit(mean) + F.lit(sd) * F.sqrt(-2.0 * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(F.lit(6.283185307179586) * v)
