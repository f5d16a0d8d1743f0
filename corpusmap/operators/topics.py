"""Topic words: TF-IDF fitted per cluster, keywords and sub-topic labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from corpusmap.functions.text import capitalize, label_words, term_counts
from corpusmap.sources.scratch import materialize

# Scores are compared at this many decimals, so equal scores tie whatever the summing order.
SCORE_DECIMALS = 9


def document_terms(points: DataFrame, id_col: str = "id", group: str = "cluster") -> DataFrame:
    """One row per document: its group and its distinct label words with counts."""
    words = label_words(F.col("title"), F.col("abstract"))
    return points.select(
        F.col(group).alias("cluster"), F.col(id_col).alias("id"), term_counts(words).alias("terms")
    )


def term_stats(docs: DataFrame) -> DataFrame:
    """Per cluster and term: document frequency, total count, documents in the cluster."""
    sizes = docs.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_docs"))
    terms = docs.select("cluster", F.inline("terms"))
    stats = terms.groupBy("cluster", "term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf")
    )
    return stats.join(sizes, "cluster")


def vocabulary(
    stats: DataFrame, max_df: float = 0.8, min_df: int = 1, max_features: int = 1000
) -> DataFrame:
    """Terms kept for each cluster, with their smoothed idf."""
    kept = stats.where((F.col("df") <= F.lit(max_df) * F.col("n_docs")) & (F.col("df") >= min_df))
    frequent_first = W.partitionBy("cluster").orderBy(F.desc("total_tf"), "term")
    return (
        kept.withColumn("_rank", F.row_number().over(frequent_first))
        .where(F.col("_rank") <= max_features)
        .select(
            "cluster",
            "term",
            (F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + 1.0).alias("idf"),
        )
    )


def tfidf_by_group(
    docs: DataFrame, max_df: float = 0.8, min_df: int = 1, max_features: int = 1000
) -> DataFrame:
    """Weight of each kept term in each document, every document scaled to unit length.

    The document is collected before it is scaled: its terms are at most ``max_features``.
    The vocabulary is written first, so the join knows its size.
    """
    vocab = materialize(
        vocabulary(term_stats(docs), max_df, min_df, max_features), "vocabulary"
    )
    weighted = docs.select("cluster", "id", F.inline("terms")).join(vocab, ["cluster", "term"])
    per_doc = (
        weighted.withColumn("w", F.col("tf") * F.col("idf"))
        .groupBy("cluster", "id")
        .agg(
            F.collect_list(F.struct("term", "w")).alias("terms"),
            F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
        )
    )
    return per_doc.select("cluster", "id", "norm", F.inline("terms")).select(
        "cluster", "id", "term", (F.col("w") / F.col("norm")).alias("weight")
    )


def term_scores(weights: DataFrame, *group: str) -> DataFrame:
    """Summed weight of each term in each group."""
    return weights.groupBy(*group, "term").agg(
        F.round(F.sum("weight"), SCORE_DECIMALS).alias("score")
    )


def top_n_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group, numbered from 1 in ``rank``."""
    window = W.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def top_keywords(weights: DataFrame, n: int, *group: str) -> DataFrame:
    """The ``n`` best words of each group as one capitalised array, best first."""
    best = top_n_per_group(
        term_scores(weights, *group).where("score > 0"), list(group), [F.desc("score"), "term"], n
    )
    return best.groupBy(*group).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda r: capitalize(r["term"])
        ).alias("keywords")
    )


def cluster_summary(points: DataFrame, group: str = "cluster") -> DataFrame:
    """Centre and size of each cluster."""
    return points.groupBy(group).agg(
        F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("count")
    )


def with_topic(summary: DataFrame, keywords: DataFrame) -> DataFrame:
    """Cluster summaries with keywords and label; a cluster without words is ``Unknown``."""
    words = F.coalesce("keywords", F.array(F.lit("Unknown")))
    return summary.join(keywords, "cluster", "left").select(
        "cluster", F.get(words, F.lit(0)).alias("label"), words.alias("keywords"), "x", "y", "count"
    )


def sublabel_pick(sub_keywords: DataFrame, topics: DataFrame) -> DataFrame:
    """One new word per sub-cluster: its best word that the cluster has not used yet.

    ``sub_keywords`` has cluster, sub, x, y, keywords. Sub-clusters choose in order of their
    number, each seeing the earlier choices and the topic label. A cluster has a handful of
    sub-clusters, so its choices fit one row.
    """
    per_cluster = sub_keywords.groupBy("cluster").agg(
        F.sort_array(F.collect_list(F.struct("sub", "x", "y", "keywords"))).alias("subs")
    )

    def choose(acc, s):
        word = F.get(
            F.filter(
                s["keywords"],
                lambda w: ~F.exists(acc, lambda used: used["text"] == w),
            ),
            F.lit(0),
        )
        return F.when(word.isNull(), acc).otherwise(
            F.concat(
                acc,
                F.array(
                    F.struct(
                        s["sub"].cast("int").alias("sub"),
                        word.alias("text"),
                        s["x"].alias("x"),
                        s["y"].alias("y"),
                    )
                ),
            )
        )

    start = F.array(
        F.struct(
            F.lit(-1).alias("sub"),
            F.col("label").alias("text"),
            F.lit(None).cast("double").alias("x"),
            F.lit(None).cast("double").alias("y"),
        )
    ).cast("array<struct<sub:int,text:string,x:double,y:double>>")
    return (
        per_cluster.join(topics.select("cluster", "label"), "cluster")
        .select("cluster", F.inline(F.aggregate("subs", start, choose)))
        .where("sub >= 0")
    )


def map_labels(topics: DataFrame, sublabels: DataFrame) -> DataFrame:
    """Topic labels (level 1) and sub-topic labels (level 2)."""
    top = topics.select("cluster", F.col("label").alias("text"), "x", "y", F.lit(1).alias("level"))
    sub = sublabels.select("cluster", "text", "x", "y", F.lit(2).alias("level"))
    return top.unionByName(sub)


def order_clusters(topics: DataFrame) -> DataFrame:
    """Largest cluster first."""
    return topics.orderBy(F.desc("count"), "cluster")
