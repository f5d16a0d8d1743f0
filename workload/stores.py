"""Round trips of the stored tables: written to the shared folder, read back, returned whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpusmap.operators import records, som, topics, views
from corpusmap.sources import tables
from corpusmap.sources.scratch import materialize, scratch_folder
from workload.inputs import codebook, documents, table, vector_labels, vector_points, vectors, works
from workload.queries import SOM_X, SOM_Y, _tiles, r6, register

#: Ids that look like numbers, and must not be taken for any.
INSTITUTIONS = ("02e463172", "04e456789", "0123")


def _folder(spark: SparkSession) -> str:
    return f"{scratch_folder(spark)}/store-{uuid.uuid4().hex}"


def _read_works(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Works as JSON lines, with one broken line per region and blank lines among them."""
    folder = _folder(spark)
    lines = works(spark, sf).select(F.to_json(F.struct("*")).alias("value"))
    broken = table(spark, sf, "region").select(
        F.explode(F.array(F.concat(F.lit('{"id": '), "r_regionkey"), F.lit("  "))).alias("value")
    )
    lines.unionByName(broken).write.text(folder)
    return tables.read_works(spark, folder)


@register
def read_works(spark, sf):
    good, bad = _read_works(spark, sf)
    kept = good.select("id", F.col("display_name").alias("text"))
    return kept.unionByName(bad.select(F.lit(None).cast("string").alias("id"), F.col(tables.CORRUPT).alias("text")))


@register
def write_records(spark, sf):
    folder = _folder(spark)
    tables.write_records(records.flatten_works(works(spark, sf)), folder)
    return tables.read_records(spark, folder)


@register
def merge_batches(spark, sf):
    """Two batches, the second with older years for every third order; and no batch at all."""
    folder = _folder(spark)
    flat = records.flatten_works(works(spark, sf))
    older = F.crc32("id") % 3 == 0
    tables.write_records(flat, f"{folder}/1")
    tables.write_records(flat.where(older).withColumn("year", F.col("year") - 1), f"{folder}/2")
    merged = tables.merge_batches(spark, [f"{folder}/1", f"{folder}/2"])
    return merged.unionByName(tables.merge_batches(spark, []))


@register
def embeddings_store(spark, sf):
    folder = _folder(spark)
    tables.write_embeddings(vectors(spark, sf), folder)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return tables.read_embeddings(spark, folder).select("id", F.size("embedding").alias("n"), r6(total).alias("total"))


@register
def map_points_roundtrip(spark, sf):
    """Three institutions written one after the other, one of them twice; all read back."""
    folder = _folder(spark)
    points = documents(spark, sf).drop("source").withColumns(
        {"faculty": F.lit(None).cast("string"), "source": F.lit("src"), "url": F.lit("")}
    )
    out = None
    for i in (0, 1, 2, 0):
        mine = points.where(F.col("id") % 3 == i)
        data_set = {"inst_id": F.lit(INSTITUTIONS[i]), "mode": F.lit("full")}
        tables.write_map_points(mine.withColumns(data_set), folder)
    for name in INSTITUTIONS:
        read = tables.read_map_points(spark, folder, name, "full")
        out = read if out is None else out.unionByName(read)
    return out.select("inst_id", "id", "title", "cluster", r6("x").alias("x"), r6("y").alias("y"))


@register
def som_store(spark, sf):
    folder = _folder(spark)
    book = codebook(spark, sf)
    assigned = materialize(som.som_assign(vectors(spark, sf), book), "som")
    density = som.som_density(assigned, SOM_X, SOM_Y)
    points = som.som_points_with_cluster(
        som.attach_som(vector_points(spark, sf).select("id", F.lit("").alias("title"), F.lit(0).alias("year")), assigned),
        vector_points(spark, sf),
    )
    tables.write_som(assigned, som.som_umatrix(book), density, points, folder)
    cells = spark.read.schema("som_x int, som_y int, distance double, density long").json(f"{folder}/cells")
    return cells.select("som_x", "som_y", som.round4(F.col("distance")).alias("distance"), "density")


@register
def tiles_store(spark, sf):
    folder = _folder(spark)
    found = materialize(_tiles(spark, sf), "tiles")
    tables.write_tiles(found, found.groupBy("z").count(), folder)
    schema = T.StructType([f for f in found.schema.fields])
    return spark.read.schema(schema).parquet(f"{folder}/tiles").select("id", "z", "tile_x", "tile_y")


@register
def labels_store(spark, sf):
    folder = _folder(spark)
    labels = vector_labels(spark, sf).select("cluster", "text", "x", "y", "level")
    summary = topics.cluster_summary(views.drop_noise(vector_points(spark, sf)))
    tables.write_labels(summary, labels, folder)
    read = spark.read.schema(labels.schema).json(f"{folder}/labels")
    return read.select("cluster", "text", r6("x").alias("x"), r6("y").alias("y"), "level")


@register
def has_rows(spark, sf):
    """Whether each order status has orders above a price."""
    orders = table(spark, sf, "orders")
    rows = [(s, tables.has_rows(orders.where((F.col("o_orderstatus") == s) & (F.col("o_totalprice") > 0)))) for s in ("F", "O", "?")]
    return spark.createDataFrame(rows, "status string, some boolean")
