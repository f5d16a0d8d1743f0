"""Continuous ingest: batches arrive as files, the latest record per id is kept.

Each micro-batch is reduced to one row per id and appended as its own folder of a log, so a
batch that runs twice replaces itself. The view over the log takes the latest row per id.
Nothing is kept in streaming state, whose size would grow with the number of ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpusmap.operators.records import dedupe_latest, flatten_works, split_rejects
from corpusmap.sources.tables import parse_works


def start_upsert(
    stream: DataFrame,
    log: str,
    checkpoint: str,
    key: str = "id",
    order: str = "year",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append the latest row per key of each micro-batch of ``stream`` to ``log``.

    ``trigger`` holds arguments of ``DataStreamWriter.trigger``; by default all that is there is
    taken and the query ends.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        latest = dedupe_latest(batch, key, order)
        latest.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_latest(
    spark: SparkSession, log: str, key: str = "id", order: str = "year"
) -> DataFrame:
    """The latest row per key over all batches of a log."""
    rows = spark.read.option("basePath", log).parquet(f"{log}/batch=*").drop("batch")
    return dedupe_latest(rows, key, order)


def compact(
    spark: SparkSession, log: str, target: str, key: str = "id", order: str = "year"
) -> None:
    """Fold all batches of a log into the first batch of a new log, a row per key.

    Readers move on to ``target`` when this returns; the old log is left as it is.
    """
    read_latest(spark, log, key, order).write.mode("overwrite").parquet(f"{target}/batch=-1")


def stream_records(
    spark: SparkSession,
    source: str,
    log: str,
    checkpoint: str,
    files_per_batch: int = 100,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Flatten arriving works (JSON lines in ``source``) and log the latest record per id.

    Lines that are no works go to ``{log}/broken``, records without an id to ``{log}/rejects``,
    a folder per batch.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source)

    def append(batch: DataFrame, batch_id: int) -> None:
        works, broken = parse_works(batch)
        records, rejects = split_rejects(flatten_works(works))
        for name, df in (("", dedupe_latest(records)), ("broken/", broken), ("rejects/", rejects)):
            df.write.mode("overwrite").parquet(f"{log}/{name}batch={batch_id}")

    return (
        lines.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
