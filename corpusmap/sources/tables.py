"""Readers and writers of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corpusmap.operators.records import dedupe_latest, union_batches
from corpusmap.schemas import EMBEDDING, MAP_POINT, RECORD, WORK_RAW

CORRUPT = "_corrupt_record"
_DATA_SET = T.StructType(
    [T.StructField("inst_id", T.StringType()), T.StructField("mode", T.StringType())]
)


def parse_works(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Works in the JSON lines ``value``, and the lines that are not works.

    Lines are parsed as a column, so that either part may be read for any of its columns, of a
    table or of a stream.
    """
    schema = T.StructType(WORK_RAW.fields + [T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    work = lines.where(F.trim("value") != "").select(F.from_json("value", schema, options).alias("work"))
    good = work.where(F.col(f"work.{CORRUPT}").isNull()).select("work.*").drop(CORRUPT)
    bad = work.where(F.col(f"work.{CORRUPT}").isNotNull()).select(f"work.{CORRUPT}")
    return good, bad


def read_works(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Works of a JSON-lines snapshot, and the lines that are not works."""
    return parse_works(spark.read.text(path))


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    return spark.read.schema(RECORD).parquet(*paths)


def _typed(schema: T.StructType) -> list[Column]:
    return [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]


def write_records(df: DataFrame, path: str) -> None:
    """Write the seven record columns with their fixed types."""
    df.select(*_typed(RECORD)).write.mode("overwrite").parquet(path)


def merge_batches(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Latest record of each id over all batch files; no files give an empty table."""
    if not paths:
        return union_batches([], spark)
    return dedupe_latest(read_records(spark, paths))


def write_embeddings(df: DataFrame, path: str) -> None:
    df.select(*_typed(EMBEDDING)).write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EMBEDDING).parquet(path)


def write_map_points(df: DataFrame, path: str) -> None:
    """Partitioned by data set; ``df`` carries ``inst_id`` and ``mode``. Other data sets stay."""
    rows = df.select(*_typed(MAP_POINT), *_typed(_DATA_SET))
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("inst_id", "mode").parquet(path)


def read_map_points(spark: SparkSession, path: str, inst_id: str, mode: str) -> DataFrame:
    """One data set; the filter prunes partitions. Ids are text, whatever numbers they look like."""
    schema = T.StructType(MAP_POINT.fields + _DATA_SET.fields)
    rows = spark.read.schema(schema).parquet(path)
    return rows.where((F.col("inst_id") == inst_id) & (F.col("mode") == mode))


def write_som(
    assignment: DataFrame, umatrix: DataFrame, density: DataFrame, points: DataFrame, path: str
) -> None:
    """Neuron of each record, U-matrix, and the viewer's tables as JSON."""
    assignment.write.mode("overwrite").parquet(f"{path}/som_map")
    umatrix.write.mode("overwrite").parquet(f"{path}/som_umatrix")
    cells = umatrix.join(density, ["som_x", "som_y"])
    cells.write.mode("overwrite").json(f"{path}/cells")
    points.write.mode("overwrite").json(f"{path}/points")


def write_tiles(tiles: DataFrame, manifest: DataFrame, path: str) -> None:
    """Tiles partitioned by depth and clustered by place, so a view reads few files."""
    placed = tiles.repartitionByRange("z", "tile_x", "tile_y").sortWithinPartitions(
        "z", "tile_x", "tile_y", "priority"
    )
    placed.write.mode("overwrite").partitionBy("z").parquet(f"{path}/tiles")
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")


def write_labels(clusters: DataFrame, labels: DataFrame, path: str) -> None:
    clusters.write.mode("overwrite").json(f"{path}/clusters")
    labels.write.mode("overwrite").json(f"{path}/labels")


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))

