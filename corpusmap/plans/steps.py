"""The six steps from raw works to a browsable map."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from corpusmap.functions.text import embedding_text
from corpusmap.functions.works import downcast
from corpusmap.operators.density import density_clusters
from corpusmap.operators.kmeans import grouped_kmeans
from corpusmap.operators.layout import layout_2d, pca_start
from corpusmap.operators.neighbours import fuzzy_graph, knn_graph
from corpusmap.operators.records import (
    cap_records,
    dedupe_latest,
    filter_institution,
    flatten_works,
    split_rejects,
)
from corpusmap.operators.sampling import sample_points
from corpusmap.operators.som import (
    attach_som,
    som_assign,
    som_density,
    som_points_with_cluster,
    som_train,
    som_umatrix,
)
from corpusmap.operators.tiles import quadtree_tiles, tile_children, tile_manifest, tile_metadata
from corpusmap.operators.topics import (
    cluster_summary,
    document_terms,
    map_labels,
    order_clusters,
    sublabel_pick,
    tfidf_by_group,
    top_keywords,
    with_topic,
)
from corpusmap.operators.vectors import Encoder, embed_text
from corpusmap.operators.views import attach_layout, drop_noise, require_aligned
from corpusmap.sources.scratch import materialize

# A cluster gets sub-topics above this size, and this many of them.
SUBTOPIC_MIN_ROWS = 50
SUBTOPICS = 3
TOPIC_WORDS = 5
SUBTOPIC_WORDS = 3


def build_records(
    works: DataFrame, key: str, value: str, n: int = 0
) -> tuple[DataFrame, DataFrame]:
    """Records of one institution: filtered, flattened, latest per id, capped to the ``n`` newest;
    and its records without an id, which cannot be told apart, as they are."""
    records, rejects = split_rejects(flatten_works(filter_institution(works, key, value)))
    return cap_records(dedupe_latest(records), n), rejects


def build_embeddings(
    records: DataFrame, make_encoder: Callable[[], Encoder] | None = None, dims: int = 64
) -> DataFrame:
    """Unit vector of the title and abstract of each record."""
    texts = records.select("id", embedding_text(F.col("title"), F.col("abstract")).alias("text"))
    return embed_text(texts, make_encoder, dims=dims)


def build_map(
    embeddings: DataFrame,
    records: DataFrame,
    n_neighbors: int = 30,
    min_dist: float = 0.05,
    min_cluster_size: int = 30,
    epochs: int = 50,
    seed: int = 42,
) -> DataFrame:
    """Records with map coordinates and density cluster."""
    require_aligned(embeddings, records)
    # The row itself counts as one of the neighbours.
    knn = materialize(knn_graph(embeddings, n_neighbors - 1, seed=seed), "knn")
    graph = fuzzy_graph(knn, n_neighbors)
    places = materialize(
        layout_2d(graph, pca_start(embeddings), epochs, min_dist, seed=seed), "places"
    )
    return attach_layout(records, places, density_clusters(places, min_cluster_size))


@dataclass(frozen=True)
class SomTables:
    codebook: DataFrame
    assignment: DataFrame
    umatrix: DataFrame
    density: DataFrame
    points: DataFrame


def build_som(
    embeddings: DataFrame,
    points: DataFrame,
    gx: int = 30,
    gy: int = 20,
    sigma: float = 1.5,
    epochs: int = 10,
    shown: int = 5000,
    seed: int = 42,
) -> SomTables:
    """Self-organizing map of the vectors, with the map point of each shown record."""
    codebook = som_train(embeddings, gx, gy, sigma, epochs, seed)
    assignment = materialize(som_assign(embeddings, codebook), "som")
    sample = attach_som(sample_points(points.select("id", "title", "year"), shown, seed), assignment)
    return SomTables(
        codebook,
        assignment,
        som_umatrix(codebook),
        som_density(assignment, gx, gy),
        som_points_with_cluster(sample, points),
    )


def build_tiles(
    points: DataFrame, capacity: int = 65536, max_depth: int = 24, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Map points with their tile and its metadata, and the manifest.

    Only coordinates go through the depth loop; the other columns join at the end.
    """
    narrow = downcast(points)
    tiles = materialize(quadtree_tiles(points, capacity, max_depth, seed), "tiles")
    manifest = tile_children(tile_manifest(tiles))
    with_meta = tile_metadata(tiles.select("id", "z", "tile_x", "tile_y", "priority"), manifest)
    if dict(points.dtypes)["id"] != dict(narrow.dtypes)["id"]:
        with_meta = with_meta.withColumn("id", F.col("id").cast(dict(narrow.dtypes)["id"]))
    return narrow.join(with_meta, "id"), manifest


def build_labels(
    points: DataFrame, kmeans_iters: int | None = None, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Topic of each cluster, largest first, and the topic and sub-topic labels of the map."""
    clustered = drop_noise(points)
    docs = materialize(document_terms(clustered), "terms")
    weights = materialize(tfidf_by_group(docs), "weights")
    topics = materialize(
        with_topic(cluster_summary(clustered), top_keywords(weights, TOPIC_WORDS, "cluster")),
        "topics",
    )
    large = topics.where((F.col("count") > SUBTOPIC_MIN_ROWS) & (F.size("keywords") > 1))
    members = materialize(
        clustered.select("id", "cluster", "x", "y").join(large.select("cluster"), "cluster", "left_semi"),
        "members",
    )
    assigned, centres = grouped_kmeans(members, "cluster", SUBTOPICS, kmeans_iters, seed)
    sub_words = top_keywords(
        weights.join(assigned.select("id", "sub"), "id"), SUBTOPIC_WORDS, "cluster", "sub"
    )
    middles = centres.select("cluster", F.posexplode("centres").alias("sub", "at")).select(
        "cluster", "sub", "at.x", "at.y"
    )
    picked = sublabel_pick(middles.join(sub_words, ["cluster", "sub"]), topics)
    return order_clusters(topics), map_labels(topics, picked)
