"""Seeded samples that do not depend on the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusmap.functions.ordering import candidate_share, hash_key, hash_unit


def sample_points(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` first rows in seeded hash order of ``id``: a sample without replacement.

    Hash positions are uniform, so the rows below a share slightly above n/N hold the sample,
    and only they are sorted. Should fewer than ``n`` be below it, all rows are taken instead.
    """
    key = hash_key(F.col("id"), seed)
    rows = df.select(F.count(F.lit(1))).scalar()
    share = candidate_share(n, rows)
    found = df.select(F.count_if(hash_unit(key) < share)).scalar()
    enough = found >= F.least(F.lit(n).cast("bigint"), rows)
    return df.where((hash_unit(key) < share) | ~enough).orderBy(key, "id").limit(n)
