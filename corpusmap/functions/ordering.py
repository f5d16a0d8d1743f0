"""Deterministic pseudo-random order: every "random" choice is an order by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_UNIT_DIGITS = 13


def hash_key(id_col: Column, seed: int) -> Column:
    """Hex key that orders rows in a seeded random order, whatever the partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}|"), id_col.cast("string")))


def hash_unit(key: Column) -> Column:
    """Position of a :func:`hash_key` in [0, 1); monotone in the key."""
    prefix = F.conv(F.substring(key, 1, _UNIT_DIGITS), 16, 10)
    return prefix.cast("double") / float(16**_UNIT_DIGITS)


def candidate_share(n: Column | int, rows: Column) -> Column:
    """Share of hash positions that holds the ``n`` first of ``rows`` rows with near certainty.

    The margin is over ten standard deviations; callers still check the count.
    """
    n = F.lit(n).cast("double")
    return (n + F.lit(10.0) * F.sqrt(n) + F.lit(50.0)) / F.greatest(rows, F.lit(1))
