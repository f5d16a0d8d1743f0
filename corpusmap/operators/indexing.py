"""Dense numbering of keys without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusmap.functions.ordering import hash_key
from corpusmap.sources.scratch import materialize

_ROW_BITS = 33


def dense_index(keys: DataFrame, out: str = "node", seed: int = 42) -> DataFrame:
    """Number the distinct ``id`` values 0…n-1 in seeded hash order.

    Range partitions are sorted and counted; a row's number is its place in the partition plus
    the sizes of the partitions before it. The numbers do not depend on the partitioning.
    """
    ranged = (
        keys.select("id", hash_key(F.col("id"), seed).alias("key"))
        .repartitionByRange("key", "id")
        .sortWithinPartitions("key", "id")
        .select("id", F.monotonically_increasing_id().alias("at"))
    )
    placed = materialize(
        ranged.select(
            "id",
            F.shiftright("at", _ROW_BITS).cast("int").alias("part"),
            F.col("at").bitwiseAND((1 << _ROW_BITS) - 1).alias("place"),
        ),
        "dense-index",
    )
    total, starts = 0, []
    # One row per shuffle partition.
    for row in placed.groupBy("part").count().orderBy("part").collect():
        starts.append((row["part"], total))
        total += row["count"]
    offsets = keys.sparkSession.createDataFrame(starts, "part int, start bigint")
    return placed.join(F.broadcast(offsets), "part").select(
        "id", (F.col("start") + F.col("place")).alias(out)
    )
