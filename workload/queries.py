"""One query per operator, over the whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusmap.functions import text as text_fn, works as works_fn
from corpusmap.operators import (
    components,
    density,
    kmeans,
    layout,
    neighbours,
    records,
    sampling,
    som,
    tiles,
    topics,
    vectors as vector_ops,
    views,
)
from corpusmap.plans import steps
from corpusmap.sources.scratch import materialize, scratch_folder
from corpusmap.sources.tables import row_count as count_rows
from corpusmap.streaming.records import read_latest, start_upsert
from workload.inputs import (
    codebook,
    documents,
    order_records,
    spread,
    table,
    vector_labels,
    vector_points,
    vector_records,
    vectors,
    works,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TILE_CAPACITY = 50
TILE_DEPTH = 8
SOM_X, SOM_Y = 10, 4
DBSCAN_EPS = 0.02
VIEW_BOX = (-0.1, -0.1, 0.15, 0.15)
PIXELS = 2000.0


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def digest(c: Column) -> list[Column]:
    """A long text as its length and hash."""
    return [F.length(c).alias("n"), F.md5(c).alias("hash")]


def rounded_rows(df: DataFrame) -> DataFrame:
    """Vectors as rows."""
    return df.select("id", F.posexplode("embedding").alias("pos", "value")).select(
        "id", "pos", r6(F.col("value").cast("double")).alias("value")
    )


# Text and scalar functions


@register
def strip_markup(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", *digest(text_fn.strip_markup(F.col("html"))))


@register
def strip_jats(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", *digest(text_fn.strip_jats(F.col("html"))))


@register
def truncate_text(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", text_fn.truncate(F.col("text"), 500, "…").alias("short"))


@register
def embedding_text(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    # Documents without a label row have no title.
    title = F.when(F.col("quality").isNotNull(), F.col("lang"))
    return docs.select("doc_id", *digest(text_fn.embedding_text(title, F.col("text"))))


@register
def normalize_text(spark, sf):
    docs = spread(table(spark, sf, "documents"))
    return docs.select("doc_id", *digest(text_fn.normalize_text(F.col("text"))))


@register
def tokenize(spark, sf):
    words = text_fn.tokenize(text_fn.normalize_text(F.col("text")))
    docs = spread(table(spark, sf, "documents"))
    return docs.select(
        "doc_id", F.size(words).alias("n"), F.md5(F.array_join(words, " ")).alias("hash")
    )


@register
def label_words(spark, sf):
    words = text_fn.label_words(F.lit(""), F.col("html"))
    pages = spread(table(spark, sf, "pages"))
    return pages.select(
        "page_id", F.size(words).alias("n"), F.md5(F.array_join(words, " ")).alias("hash")
    )


@register
def abstract_rebuild(spark, sf):
    docs = table(spark, sf, "documents").where("text IS NOT NULL")
    indexed = docs.select("doc_id", works_fn.inverted_index(F.split("text", "[ \\n\\t]+")).alias("index"))
    return works_fn.merge_indexes(indexed, "doc_id").select(
        "doc_id", *digest(works_fn.abstract_from_inverted_index(F.col("index")))
    )


@register
def short_id(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", works_fn.short_id(F.col("url")).alias("short")
    )


@register
def nan_to_null(spark, sf):
    events = table(spark, sf, "events")
    value = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    return works_fn.nan_to_null(events.select("event_id", value.alias("value")))


@register
def downcast(spark, sf):
    lines = table(spark, sf, "lineitem")
    return works_fn.downcast(lines.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity"))


@register
def minmax_scale(spark, sf):
    scaled = works_fn.minmax_scale(table(spark, sf, "customer"), "c_acctbal")
    return scaled.select("c_custkey", r6("scaled").alias("scaled"))


@register
def json_rows(spark, sf):
    customer = table(spark, sf, "customer")
    written = works_fn.to_json_rows(customer)
    return works_fn.parse_json_rows(written, "json", customer.schema)


# Records


@register
def flatten_works(spark, sf):
    return records.flatten_works(works(spark, sf))


@register
def filter_institution(spark, sf):
    at = records.filter_institution(works(spark, sf), "ror", "R3")
    return records.select_fields(at).select("id", "display_name")


@register
def dedupe_latest(spark, sf):
    return records.dedupe_latest(order_records(spark, sf))


@register
def cap_recent(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.year("o_orderdate").cast("bigint").alias("year"),
        "o_orderpriority",
    )
    return records.cap_records(orders, 500)


@register
def union_batches(spark, sf):
    batches = [
        table(spark, sf, "orders").select(F.col("o_custkey").alias("id")),
        table(spark, sf, "customer").select(F.col("c_custkey").alias("id")),
    ]
    return records.union_batches(batches).groupBy("id").agg(F.count("*").alias("n"))


@register
def row_count(spark, sf):
    return count_rows(table(spark, sf, "lineitem"))


@register
def ingest_summary(spark, sf):
    raw = order_records(spark, sf)
    return records.ingest_summary(raw, records.dedupe_latest(raw), 5000)


@register
def institution_directory(spark, sf):
    return records.institution_directory(works(spark, sf))


@register
def search_institutions(spark, sf):
    return records.search_institutions(
        records.institution_directory(works(spark, sf)), "supplier#00000000", 5
    )


def _entities(spark, sf) -> dict[str, DataFrame]:
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    supplier, part = table(spark, sf, "supplier"), table(spark, sf, "part")
    customer = table(spark, sf, "customer")

    def entity(names, key, name, facts, fact_key):
        counts = facts.groupBy(F.col(fact_key).alias(key)).agg(F.count("*").alias("works_count"))
        return names.join(counts, key).select(
            F.col(key).alias("id"), F.col(name).alias("display_name"), "works_count"
        )

    return {
        "institution": entity(supplier, "s_suppkey", "s_name", lines, "l_suppkey"),
        "source": entity(customer, "c_custkey", "c_name", orders, "o_custkey"),
        "work": entity(part, "p_partkey", "p_name", lines, "l_partkey"),
    }


@register
def search_entities(spark, sf):
    return records.search_entities(_entities(spark, sf), "ri", 20)


@register
def search_index(spark, sf):
    path = f"{scratch_folder(spark)}/search-{uuid.uuid4().hex}"
    records.write_search_index(_entities(spark, sf), path)
    return records.search_index(spark.read.parquet(path), "ri", 20)


@register
def sample_points(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    return sampling.sample_points(orders, 1000)


@register
def stream_records(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
        .select(
            F.col("user_id").alias("id"),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("seen_at"),
            "event_type",
            "value",
        )
    )
    folder = f"{scratch_folder(spark)}/stream-{uuid.uuid4().hex}"
    start_upsert(stream, f"{folder}/log", f"{folder}/state", "id", "seen_at").awaitTermination()
    return read_latest(spark, f"{folder}/log", "id", "seen_at")


@register
def build_records(spark, sf):
    raw = works(spark, sf)
    records, _ = steps.build_records(raw.unionByName(raw), "ror", "R3", 100)
    return records


# Topics


@register
def cluster_topics(spark, sf):
    points = documents(spark, sf)
    docs = materialize(topics.document_terms(points), "terms")
    keywords = topics.top_keywords(topics.tfidf_by_group(docs), 5, "cluster")
    return topics.with_topic(topics.cluster_summary(points), keywords).select(
        "cluster",
        "label",
        F.array_join("keywords", " ").alias("keywords"),
        r6("x").alias("x"),
        r6("y").alias("y"),
        "count",
    )


@register
def term_stats(spark, sf):
    return topics.term_stats(topics.document_terms(documents(spark, sf)))


@register
def tfidf_by_group(spark, sf):
    docs = materialize(topics.document_terms(documents(spark, sf)), "terms")
    scores = topics.term_scores(topics.tfidf_by_group(docs), "cluster")
    return scores.select("cluster", "term", r6("score").alias("score"))


@register
def sublabels(spark, sf):
    points = documents(spark, sf)
    docs = materialize(topics.document_terms(points), "terms")
    weights = materialize(topics.tfidf_by_group(docs), "weights")
    top = topics.with_topic(
        topics.cluster_summary(points), topics.top_keywords(weights, 5, "cluster")
    )
    third = points.select("id", (F.col("id") % 3).cast("int").alias("sub"), "x", "y", "cluster")
    words = topics.top_keywords(weights.join(third.select("id", "sub"), "id"), 3, "cluster", "sub")
    middles = third.groupBy("cluster", "sub").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    picked = topics.sublabel_pick(middles.join(words, ["cluster", "sub"]), top)
    return topics.map_labels(top, picked).select(
        "cluster", "text", r6("x").alias("x"), r6("y").alias("y"), "level"
    )


@register
def order_clusters(spark, sf):
    points = vector_points(spark, sf)
    summary = topics.cluster_summary(views.drop_noise(points))
    ranked = topics.order_clusters(summary)
    return ranked.select("cluster", "count")


@register
def build_labels(spark, sf):
    _, labels = steps.build_labels(documents(spark, sf))
    return labels.select("cluster", "text", r6("x").alias("x"), r6("y").alias("y"), "level")


@register
def build_topics(spark, sf):
    clusters, _ = steps.build_labels(documents(spark, sf))
    return clusters.select(
        "cluster", "label", F.array_join("keywords", " ").alias("keywords"), "count"
    )


# Vectors


@register
def mean_pool(spark, sf):
    tokens = vectors(spark, sf).withColumn("mask", (F.col("id") % 2).cast("int"))
    tokens = tokens.select(F.col("cluster").alias("id"), "embedding", "mask")
    return rounded_rows(vector_ops.mean_pool(tokens, "id", "embedding", "mask"))


@register
def l2_normalize(spark, sf):
    tokens = vectors(spark, sf)
    scaled = tokens.select("id", F.transform("embedding", lambda v: v.cast("double") * 3).alias("embedding"))
    return rounded_rows(vector_ops.l2_normalize(scaled))


@register
def embed_text(spark, sf):
    docs = spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), "text")
    return rounded_rows(vector_ops.embed_text(docs))


def _knn(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", "rank", r6("distance").alias("distance"))


@register
def knn_exact(spark, sf):
    return _knn(neighbours.knn_graph(vectors(spark, sf), 5, method="exact", cell_rows=256))


@register
def knn_ivf(spark, sf):
    return _knn(
        neighbours.knn_graph(vectors(spark, sf), 5, method="ivf", cell_rows=64, probes=4)
    )


@register
def knn_tree(spark, sf):
    """The default method over many cells; recall is tested against brute force."""
    return _knn(neighbours.knn_graph(vectors(spark, sf), 5, cell_rows=64))


@register
def fuzzy_graph(spark, sf):
    knn = materialize(neighbours.knn_graph(vectors(spark, sf), 14, method="exact"), "knn")
    edges = neighbours.fuzzy_graph(knn, 15)
    return edges.select("src", "dst", r6("weight").alias("weight"))


@register
def layout_2d(spark, sf):
    rows = vectors(spark, sf)
    knn = materialize(neighbours.knn_graph(rows, 14), "knn")
    return layout.layout_2d(neighbours.fuzzy_graph(knn, 15), layout.pca_start(rows))


@register
def core_distance(spark, sf):
    cores = density.core_distance(vector_points(spark, sf), 10)
    return cores.select("id", r6("core").alias("core"))


@register
def connected_components(spark, sf):
    orders = table(spark, sf, "orders")
    edges = orders.select(
        F.col("o_orderkey").alias("src"),
        (F.col("o_orderkey") - F.least(F.col("o_orderkey") % 50, F.lit(1))).alias("dst"),
    )
    return components.connected_components(edges)


@register
def dbscan_level(spark, sf):
    points = vector_points(spark, sf)
    cored = materialize(points.join(density.core_distance(points, 5), "id"), "cored")
    return density.dbscan_levels(cored, [DBSCAN_EPS, DBSCAN_EPS / 2], 3)


@register
def density_clusters(spark, sf):
    return density.density_clusters(vector_points(spark, sf), 10)


@register
def grouped_kmeans_step(spark, sf):
    points = vector_points(spark, sf)
    start = kmeans.start_centres(points, "cluster", 3)
    assigned = kmeans.assign_centres(points, start, "cluster")
    centres = kmeans.update_centres(assigned, "cluster")
    return centres.select("cluster", F.posexplode("centres").alias("sub", "at")).select(
        "cluster", "sub", r6("at.x").alias("x"), r6("at.y").alias("y")
    )


@register
def grouped_kmeans(spark, sf):
    assigned, _ = kmeans.grouped_kmeans(vector_points(spark, sf))
    return assigned.select("id", "cluster", "sub")


# Self-organizing map


@register
def som_assign(spark, sf):
    found = som.som_assign(vectors(spark, sf), codebook(spark, sf))
    return found.select("id", "som_x", "som_y", r6("error").alias("error"))


@register
def som_umatrix(spark, sf):
    cells = som.som_umatrix(codebook(spark, sf))
    return cells.select("som_x", "som_y", som.round4(F.col("distance")).alias("distance"))


@register
def som_density(spark, sf):
    return som.som_density(som.som_assign(vectors(spark, sf), codebook(spark, sf)), SOM_X, SOM_Y)


def _som_points(spark, sf, assigned: DataFrame) -> DataFrame:
    sample = som.attach_som(sampling.sample_points(vector_records(spark, sf), 5000), assigned)
    return som.som_points_with_cluster(sample, views.drop_noise(vector_points(spark, sf)))


@register
def som_points_with_cluster(spark, sf):
    return _som_points(spark, sf, som.som_assign(vectors(spark, sf), codebook(spark, sf)))


@register
def som_cell_details(spark, sf):
    book = codebook(spark, sf)
    assigned = materialize(som.som_assign(vectors(spark, sf), book), "som")
    return som.som_cell_details(
        som.som_umatrix(book),
        som.som_density(assigned, SOM_X, SOM_Y),
        _som_points(spark, sf, assigned),
    )


@register
def som_train(spark, sf):
    book = som.som_train(vectors(spark, sf), 6, 5, epochs=5)
    return book.select("som_x", "som_y", F.posexplode("weights").alias("pos", "weight")).withColumn(
        "weight", r6("weight")
    )


@register
def build_som(spark, sf):
    points = vector_records(spark, sf).join(vector_points(spark, sf), "id")
    return steps.build_som(vectors(spark, sf), points, 6, 5, epochs=5).points


# Tiles and views


def _tiles(spark, sf) -> DataFrame:
    return tiles.quadtree_tiles(vector_points(spark, sf), TILE_CAPACITY, TILE_DEPTH)


@register
def quadtree_tiles(spark, sf):
    return _tiles(spark, sf).select("id", "z", "tile_x", "tile_y")


@register
def tile_manifest(spark, sf):
    manifest = tiles.tile_children(tiles.tile_manifest(materialize(_tiles(spark, sf), "tiles")))
    return manifest.select(
        "key",
        "n_points",
        r6("extent.x_min").alias("x_min"),
        r6("extent.x_max").alias("x_max"),
        r6("extent.y_min").alias("y_min"),
        r6("extent.y_max").alias("y_max"),
        F.array_join("children", " ").alias("children"),
    )


@register
def points_in_view(spark, sf):
    seen = tiles.points_in_view(materialize(_tiles(spark, sf), "tiles"), VIEW_BOX, 1, 60)
    return seen.select("id", "z", "tile_x", "tile_y")


@register
def build_tiles(spark, sf):
    points = vector_points(spark, sf)
    tiled, _ = steps.build_tiles(points, TILE_CAPACITY, TILE_DEPTH)
    return tiled.select("id", "cluster", "key", F.size("children").alias("n_children"))


@register
def labels_in_view(spark, sf):
    seen = views.labels_in_view(vector_labels(spark, sf), 2.0, VIEW_BOX, (0.01, 0.02))
    return seen.select("cluster", "text", "level")


@register
def declutter_labels(spark, sf):
    kept = views.declutter_labels(vector_labels(spark, sf), PIXELS)
    return kept.select("cluster", "text", "level")


@register
def cluster_census(spark, sf):
    return views.cluster_census(vector_points(spark, sf))


@register
def cluster_summary(spark, sf):
    summary = topics.cluster_summary(views.drop_noise(vector_points(spark, sf)))
    return summary.select("cluster", r6("x").alias("x"), r6("y").alias("y"), "count")


@register
def filter_cluster(spark, sf):
    return views.filter_cluster(vector_points(spark, sf), 3).select("id", "cluster")


@register
def dataset_stats(spark, sf):
    points = vector_points(spark, sf)
    return views.dataset_stats(points, topics.cluster_summary(views.drop_noise(points)))


@register
def check_aligned(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return views.check_aligned(docs, table(spark, sf, "labels").select((F.col("doc_id") * 2).alias("id")))


@register
def attach_layout(spark, sf):
    """Documents lie where their vector lies, those without one at coordinates of their own."""
    docs, points = documents(spark, sf), vector_points(spark, sf)
    own = docs.select(*points.columns).join(points, "id", "left_anti")
    placed = points.unionByName(own)
    joined = views.attach_layout(docs.select("id", "title"), placed, placed)
    return joined.select("id", "title", r6("x").alias("x"), r6("y").alias("y"), "cluster")


def _topics_of_vectors(spark, sf) -> DataFrame:
    """Labels for the clusters in the right half only."""
    summary = topics.cluster_summary(views.drop_noise(vector_points(spark, sf)))
    return summary.where("x > 0").select(
        "cluster", F.concat(F.lit("Topic "), F.col("cluster").cast("string")).alias("label")
    )


@register
def attach_topic(spark, sf):
    points = vector_points(spark, sf).select("id", "cluster")
    return views.attach_topic(points, _topics_of_vectors(spark, sf))


@register
def point_details(spark, sf):
    docs = documents(spark, sf).drop("cluster", "x", "y")
    points = docs.join(vector_points(spark, sf).select("id", "cluster"), "id", "left")
    points = points.withColumns(
        {
            "title": F.when(F.col("id") % 5 != 0, F.col("title")),
            "faculty": F.when(F.col("id") % 2 == 0, F.col("source")),
            "url": F.lit(None).cast("string"),
        }
    )
    return views.point_details(points, _topics_of_vectors(spark, sf))


@register
def available_datasets(spark, sf):
    orders = table(spark, sf, "orders")
    inst = F.col("o_custkey").alias("inst_id")
    mode = F.when(F.col("o_orderstatus") == "F", F.lit("full")).otherwise(F.lit("limited"))
    # The digit of the priority is the depth, counted from 1.
    built = orders.select(
        inst,
        mode.alias("mode"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("depth"),
        F.lit(0).alias("tile_x"),
        F.lit(0).alias("tile_y"),
    )
    built = built.withColumn("z", F.col("depth") - 1)
    labelled = orders.where("o_totalprice > 400000").select(inst, mode.alias("mode"))
    found = views.available_datasets(built, labelled)
    return found.select("inst_id", F.array_join("modes", " ").alias("modes"))


# Whole steps without a SQL form


@register
def build_embeddings(spark, sf):
    return rounded_rows(steps.build_embeddings(documents(spark, sf)))


@register
def build_map(spark, sf):
    """All documents from text to map, with the library's defaults."""
    docs = documents(spark, sf)
    embedded = materialize(steps.build_embeddings(docs), "embedded")
    return steps.build_map(embedded, docs.select("id", "title", "year"))
