"""Test tables in the shape the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmap.operators.vectors import mean_pool


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The small test files shared out to all cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as map points: first line as title, language as cluster, made-up coordinates."""
    title = F.substring_index("text", "\n", 1)
    return spread(table(spark, sf, "documents")).select(
        F.col("doc_id").alias("id"),
        title.alias("title"),
        F.col("text").substr(F.length(title) + 2, F.length("text")).alias("abstract"),
        (F.array_position(F.array(*map(F.lit, ["de", "en", "es", "fr"])), F.col("lang")) - 1)
        .cast("int")
        .alias("cluster"),
        ((F.col("n_chars") % 1000) / 10.0).alias("x"),
        ((F.col("doc_id") * 7919 % 1000) / 10.0).alias("y"),
        (F.lit(2000) + F.col("doc_id") % 25).alias("year"),
        F.element_at(
            F.array(*map(F.lit, ["openalex", "unam_repository", "scielo_mexico", "src"])),
            (F.col("doc_id") % 4 + 1).cast("int"),
        ).alias("source"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.col("label").alias("cluster")
    )


def vector_points(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as map points: the first two dimensions as coordinates, label 0 as noise."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.get("embedding", F.lit(0)).cast("double").alias("x"),
        F.get("embedding", F.lit(1)).cast("double").alias("y"),
        F.when(F.col("label") == 0, F.lit(-1)).otherwise(F.col("label")).alias("cluster"),
    )


def vector_records(spark: SparkSession, sf: str) -> DataFrame:
    """A record for every vector."""
    number = F.col("vec_id").cast("string")
    year = (F.lit(2000) + F.col("vec_id") % 25).cast("int")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.concat(F.lit("Vector "), number).alias("title"), year.alias("year")
    )


def vector_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Map labels on two levels placed at the vectors."""
    points = vector_points(spark, sf)
    return points.select(
        "cluster",
        F.concat(F.lit("L"), F.col("id").cast("string")).alias("text"),
        "x",
        "y",
        (F.col("id") % 2 + 1).cast("int").alias("level"),
        (F.col("id") * 37 % 101).alias("count"),
    )


def works(spark: SparkSession, sf: str) -> DataFrame:
    """Raw works: an order is a work, its lines are the authors, their suppliers institutions.

    Small lines have no institution; landing pages are null, empty or set in turn.
    """
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    supplier = table(spark, sf, "supplier")
    key = F.col("l_suppkey").cast("string")
    institution = F.struct(
        F.concat(F.lit("https://inst.example/I"), key).alias("id"),
        F.concat(F.lit("https://ror.org/R"), key).alias("ror"),
        F.col("s_name").alias("display_name"),
    )
    none = F.array().cast("array<struct<id:string,ror:string,display_name:string>>")
    author = F.struct(
        F.when(F.col("l_quantity") < 10, none).otherwise(F.array(institution)).alias("institutions")
    )
    authors = (
        lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("l_orderkey")
        .agg(F.sort_array(F.collect_list(F.struct("l_linenumber", author.alias("a")))).alias("listed"))
        .select("l_orderkey", F.transform("listed", lambda e: e["a"]).alias("authorships"))
    )
    order_key = F.col("o_orderkey").cast("string")
    landing = (
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(None))
        .when(F.col("o_orderkey") % 3 == 1, F.lit(""))
        .otherwise(F.concat(F.lit("https://landing.example/"), order_key))
    )
    return orders.join(authors, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.concat(F.lit("https://work.example/W"), order_key).alias("id"),
        F.concat(F.lit("Order "), order_key).alias("display_name"),
        F.year("o_orderdate").cast("bigint").alias("publication_year"),
        "authorships",
        F.create_map(
            F.col("o_orderpriority"),
            F.array(F.lit(1), F.lit(4)),
            F.col("o_orderstatus"),
            F.array(F.lit(0), F.lit(4)),
        ).alias("abstract_inverted_index"),
        F.struct(landing.cast("string").alias("landing_page_url")).alias("primary_location"),
    )


def order_records(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches of records with shared ids: by order and by customer."""
    orders = table(spark, sf, "orders")
    year = F.year("o_orderdate").cast("bigint").alias("year")
    rest = [year, F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")]
    return orders.select(F.col("o_orderkey").alias("id"), *rest).unionByName(
        orders.select(F.col("o_custkey").alias("id"), *rest)
    )


def codebook(spark: SparkSession, sf: str) -> DataFrame:
    """A 10×4 codebook: mean vector of each label and each of four classes of id."""
    rows = table(spark, sf, "embeddings").select(
        F.struct(F.col("label").alias("som_x"), (F.col("vec_id") % 4).cast("int").alias("som_y")).alias("cell"),
        "embedding",
        F.lit(1).alias("mask"),
    )
    return mean_pool(rows, "cell", "embedding", "mask").select(
        "cell.som_x", "cell.som_y", F.col("embedding").alias("weights")
    )
