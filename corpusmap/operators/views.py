"""Queries of a map viewer: points, topics, labels, statistics, data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusmap.functions.text import source_name, strip_jats, truncate
from corpusmap.sources.scratch import materialize, materialize_observed

# Zoom factors at which a label level appears.
LEVEL_ZOOMS = [(1.5, 0), (4.0, 1)]
DEEPEST_LEVEL = 2
# Labels nearer than this many pixels hide each other.
LABEL_GAP_X = 60.0
LABEL_GAP_Y = 36.0


def drop_noise(points: DataFrame) -> DataFrame:
    """Rows that belong to a cluster."""
    return points.where("cluster != -1")


def filter_cluster(points: DataFrame, cluster: int) -> DataFrame:
    """Rows of one cluster."""
    return points.where(F.col("cluster") == cluster)


def cluster_census(points: DataFrame) -> DataFrame:
    """Number of clusters, of noise rows and of all rows."""
    return points.agg(
        F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("clusters"),
        F.count_if(F.col("cluster") == -1).alias("noise"),
        F.count(F.lit(1)).alias("total"),
    )


def dataset_stats(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """Clustered, noise and total rows, and the number of topics."""
    topics = clusters.select(F.count(F.lit(1))).scalar()
    clustered = clusters.select(F.coalesce(F.sum("count"), F.lit(0))).scalar()
    return points.agg(F.count(F.lit(1)).alias("total")).select(
        clustered.alias("documents"),
        (F.col("total") - clustered).alias("noise"),
        "total",
        topics.alias("topics"),
    )


def check_aligned(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Keys that only one side has, with the ``side``; empty when the tables match."""
    only_a = a.select(key).join(b.select(key), key, "left_anti")
    only_b = b.select(key).join(a.select(key), key, "left_anti")
    return only_a.withColumn("side", F.lit("left")).unionByName(
        only_b.withColumn("side", F.lit("right"))
    )


def require_aligned(a: DataFrame, b: DataFrame, key: str = "id") -> None:
    """Raise unless both tables have the same keys."""
    odd = check_aligned(a, b, key).take(3)
    if odd:
        raise ValueError(f"keys without a partner, for example {[tuple(r) for r in odd]}")


def attach_layout(records: DataFrame, xy: DataFrame, clusters: DataFrame) -> DataFrame:
    """Records with coordinates and cluster."""
    return records.join(xy.select("id", "x", "y"), "id").join(clusters.select("id", "cluster"), "id")


def topic_name(label: Column, cluster: Column) -> Column:
    """Label of a cluster, or ``Cluster N``."""
    return F.coalesce(label, F.concat(F.lit("Cluster "), cluster.cast("string")))


def attach_topic(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """Points with the topic name of their cluster."""
    return (
        points.join(clusters.select("cluster", "label"), "cluster", "left")
        .withColumn("topic", topic_name(F.col("label"), F.col("cluster")))
        .drop("label")
    )


def point_details(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """What a viewer shows of a point: defaults filled in, abstract cut, names looked up."""
    empty = F.lit("")
    filled = points.withColumn("cluster", F.coalesce("cluster", F.lit(0)))
    return attach_topic(filled, clusters).select(
        "id",
        strip_jats(F.coalesce(F.nullif("title", empty), F.lit("Untitled"))).alias("title"),
        F.coalesce(F.nullif(F.col("year").cast("string"), F.lit("0")), empty).alias("year"),
        F.coalesce("faculty", empty).alias("faculty"),
        strip_jats(truncate(F.coalesce("abstract", empty), 500, "…")).alias("abstract"),
        F.coalesce("url", empty).alias("url"),
        source_name(F.coalesce("source", empty)).alias("source"),
        "topic",
    )


def visible_level(zoom: float) -> int:
    """Deepest label level shown at a zoom factor."""
    return next((level for limit, level in LEVEL_ZOOMS if zoom < limit), DEEPEST_LEVEL)


def labels_in_view(
    labels: DataFrame,
    zoom: float,
    bbox: tuple[float, float, float, float],
    margin: tuple[float, float] = (0.0, 0.0),
) -> DataFrame:
    """Labels shown at ``zoom`` inside (x_min, y_min, x_max, y_max) widened by ``margin``."""
    x_min, y_min, x_max, y_max = bbox
    mx, my = margin
    x, y = F.col("x"), F.col("y")
    return labels.where(
        (F.col("level") <= visible_level(zoom))
        & (x > x_min - mx)
        & (x < x_max + mx)
        & (y > y_min - my)
        & (y < y_max + my)
    )


def declutter_labels(labels: DataFrame, pixels_per_unit: float) -> DataFrame:
    """Labels kept when each, in turn, is dropped if it lies within 60 pixels in x and 36 in y
    of one kept before it. The turn is by level, then count descending, cluster and text.

    A 60×36 cell holds at most one kept label. Each round keeps the first label of every cell
    that comes before all undecided labels of the surrounding cells, then drops what these hide;
    the result is that of the one-by-one rule, and no pairs within a cell are formed.
    """
    turn = F.struct("level", -F.col("count"), "cluster", "text", "x", "y")
    columns = labels.columns
    open_labels, seen = materialize_observed(
        labels.withColumns(
            {
                "px": F.col("x") * pixels_per_unit,
                "py": F.col("y") * pixels_per_unit,
                "cx": F.floor(F.col("x") * pixels_per_unit / LABEL_GAP_X),
                "cy": F.floor(F.col("y") * pixels_per_unit / LABEL_GAP_Y),
                "turn": turn,
            }
        ),
        "labels-open",
        n=F.count(F.lit(1)),
    )
    around = F.array(
        *[
            F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
            for dx in (-1, 0, 1)
            for dy in (-1, 0, 1)
        ]
    )
    kept = []
    while seen["n"]:
        firsts = open_labels.groupBy("cx", "cy").agg(F.min("turn").alias("turn"))
        near = (
            firsts.select("turn", "cx", "cy", F.inline(around))
            .select(
                (F.col("cx") + F.col("dx")).alias("cx"),
                (F.col("cy") + F.col("dy")).alias("cy"),
                "turn",
            )
            .groupBy("cx", "cy")
            .agg(F.min("turn").alias("turn"))
        )
        chosen = materialize(open_labels.join(near, ["cx", "cy", "turn"], "left_semi"), "labels-kept")
        kept.append(chosen)
        reach = chosen.select(
            F.col("px").alias("kx"), F.col("py").alias("ky"), "cx", "cy", F.inline(around)
        ).select(
            "kx",
            "ky",
            (F.col("cx") + F.col("dx")).alias("cx"),
            (F.col("cy") + F.col("dy")).alias("cy"),
        )
        hidden = (F.abs(F.col("px") - F.col("kx")) < LABEL_GAP_X) & (
            F.abs(F.col("py") - F.col("ky")) < LABEL_GAP_Y
        )
        left = open_labels.alias("o").join(
            reach.alias("r"),
            (F.col("o.cx") == F.col("r.cx")) & (F.col("o.cy") == F.col("r.cy")) & hidden,
            "left_anti",
        )
        open_labels, seen = materialize_observed(left, "labels-open", n=F.count(F.lit(1)))
    if not kept:
        return labels
    result = kept[0]
    for part in kept[1:]:
        result = result.unionByName(part)
    return result.select(*columns)


def available_datasets(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """Modes of each institution that have both a root tile and labels.

    Both inputs carry ``inst_id`` and ``mode``.
    """
    rooted = tiles.where("z = 0 and tile_x = 0 and tile_y = 0").select("inst_id", "mode").distinct()
    ready = rooted.join(labels.select("inst_id", "mode"), ["inst_id", "mode"], "left_semi")
    return ready.groupBy("inst_id").agg(F.sort_array(F.collect_set("mode")).alias("modes"))
