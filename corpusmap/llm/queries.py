"""One query per operator of this subpackage, over whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmap.llm import (
    calibrate,
    conversations,
    decontaminate,
    embeddings,
    licenses,
    lm,
    minhash,
    packing,
    quality,
    spelling,
    suffix_index,
    token_files,
    toxicity,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Ids and whole texts."""
    return table(spark, sf, "documents").select("doc_id", "text")


def _scored(scored: DataFrame, threshold: float, *more: str) -> DataFrame:
    return scored.select(
        "doc_id",
        calibrate.held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        *more,
    )


@register
def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    model = toxicity.fit(calibrate.labelled(docs, table(spark, sf, "labels"), "toxic"))
    return _scored(toxicity.score(docs, model), 0.5, "n_words")


@register
def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    model = quality.fit(calibrate.labelled(docs, table(spark, sf, "labels"), "quality"))
    return _scored(quality.score(docs, model), 0.3)


@register
def op4_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Each document and benchmark item that overlap, with the overlap."""
    found = decontaminate.overlaps(documents(spark, sf), table(spark, sf, "benchmark"))
    return found.withColumn("equal_share", F.col("n_equal") / F.col("n_words"))


@register
def op5_warc(spark: SparkSession, sf: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    warc.write_archives(table(spark, sf, "pages"), folder)
    return warc.read_archives(spark, folder, payload=False).drop("url")


ORACLE_SQL["op5_warc"] = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
    h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex FROM p),
    d AS (
        SELECT *, list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            ((('0x' || substr(hex, 1 + 5 * (k // 4)::INT, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31) + 1, 1)),
            'string_agg', '') AS digest, min(page_id) OVER (PARTITION BY hex) AS lowest
        FROM h
    )
    SELECT page_id, n AS payload_bytes, digest AS payload_digest,
        CASE WHEN page_id = lowest THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> lowest THEN lowest END AS refers_to
    FROM d
"""


@register
def op3_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(documents(spark, sf)).drop("blocks")


ORACLE_SQL["op3_licenses"] = licenses.duckdb_sql()


@register
def op7_minhash(spark: SparkSession, sf: str) -> DataFrame:
    """The class of near duplicates of each document; kept: the first of its class."""
    found = minhash.near_duplicates(documents(spark, sf))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


@register
def op8_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_index.remove_repeats(documents(spark, sf)).drop("spans")


@register
def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(documents(spark, sf), packing.tokenizer_path())


@register
def op6_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf, "embeddings").select("vec_id", "embedding"))


@register
def op2_lm(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).withColumn("train", ~calibrate.held_out(F.col("doc_id"), 7, 2))
    return lm.score(docs).select(
        "doc_id",
        calibrate.held_out(F.col("doc_id"), 7, 2).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


@register
def op11_token_files(spark: SparkSession, sf: str) -> DataFrame:
    manifest = token_files.write_sequences(documents(spark, sf), token_files.tokenizer_path())
    return token_files.read_documents(manifest)


@register
def op12_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(documents(spark, sf))


@register
def op13_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.repaired(conversations.damaged(table(spark, sf, "conversations")))


@register
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)
