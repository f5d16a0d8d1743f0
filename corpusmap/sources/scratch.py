"""Intermediate tables in the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import gc
import time
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

_FOLDER = "spark.checkpoint.dir"
_paths: dict[int, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """Folder named by the cluster, else one under the warehouse, which executors share too."""
    folder = spark.conf.get(_FOLDER, None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def free_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of finished queries deleted now, not at the driver's next collection.

    For long chains of scratch tables over much data, whose shuffles would pile up on the disks.
    """
    for _ in range(2):  # the first pass frees what holds on to the last query's plan
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a scratch table and read it back.

    Unlike a cached plan the table has a known size, so later joins are planned on facts.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[id(table)] = path
    weakref.finalize(table, _paths.pop, id(table), None)
    return table


def materialize_observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """:func:`materialize`, with aggregates of the written rows for loop conditions.

    They are read back from the table: only the columns they need are scanned, and unlike
    metrics gathered through listeners they cannot get lost on a busy cluster.
    """
    table = materialize(df, name)
    row = table.agg(*[m.alias(n) for n, m in metrics.items()]).first()
    return table, row.asDict()


@contextmanager
def bucketed(df: DataFrame, name: str, key: str) -> Iterator[DataFrame]:
    """``df`` as a scratch table bucketed and sorted by ``key``: joins and groups on the key do not move its rows.

    There are as many buckets as shuffle partitions. The table is dropped at the end.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    label = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{scratch_folder(spark)}/{label}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).format("parquet").saveAsTable(label)
    try:
        yield spark.table(label)
    finally:
        spark.sql(f"DROP TABLE {label}")
        _delete(spark, path)


def discard(table: DataFrame) -> None:
    """Delete a scratch table that a loop has replaced; later plans must not read it."""
    path = _paths.pop(id(table), None)
    if path:
        _delete(table.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
