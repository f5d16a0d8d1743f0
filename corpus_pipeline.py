"""The whole pipeline over documents: quality, near duplicates, repeated passages, benchmarks, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last
return the columns of documents. Stages with an index or a model of their own have no SQL form; each
is tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmap.llm import calibrate, decontaminate, minhash, packing, quality, suffix_index
from corpusmap.sources.scratch import materialize

QUALITY_THRESHOLD = 0.3


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the quality classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(calibrate.labelled(docs, labels, "quality"))
    return quality.keep(docs, model, QUALITY_THRESHOLD)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return minhash.representatives(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes that an earlier document has; n_chars follows.

    Characters that lose some of their bytes go; so do documents that lose their whole text.
    """
    found = suffix_index.remove_repeats(docs, kept_text=True).where("n_removed < n_bytes or n_bytes = 0")
    text = F.when(F.col("n_removed") == 0, F.col("kept").cast("string")).otherwise(
        F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    )
    rows = found.withColumn("text", text)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*(columns.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that overlap a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("repeated_passages", without_repeats),
    ("decontamination", uncontaminated),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
