"""Record operators: filter, flatten, deduplicate, cap, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from corpusmap.functions.fixed import WORKS_SOURCE
from corpusmap.functions.works import (
    abstract_from_inverted_index,
    best_url,
    first_institution,
    short_id,
)
from corpusmap.schemas import RECORD, WORK_RAW


def select_fields(works: DataFrame) -> DataFrame:
    """Only the fields the map needs."""
    return works.select(*WORK_RAW.fieldNames())


def filter_institution(works: DataFrame, key: str, value: str) -> DataFrame:
    """Works with an author at the institution; ``key`` is ``ror``, anything else means ``id``."""
    field = "ror" if key == "ror" else "id"
    return works.where(
        F.exists(
            "authorships",
            lambda a: F.exists(a["institutions"], lambda i: short_id(i[field]) == value),
        )
    )


def flatten_works(works: DataFrame) -> DataFrame:
    """Raw nested works as flat records."""
    return works.select(
        F.coalesce("id", F.lit("")).alias("id"),
        F.coalesce("display_name", F.lit("")).alias("title"),
        F.col("publication_year").cast("bigint").alias("year"),
        first_institution(F.col("authorships")).alias("faculty"),
        abstract_from_inverted_index(F.col("abstract_inverted_index")).alias("abstract"),
        F.lit(WORKS_SOURCE).alias("source"),
        best_url(F.col("primary_location.landing_page_url"), F.coalesce("id", F.lit(""))).alias(
            "url"
        ),
    )


def split_rejects(records: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Records with a usable key, and those without one."""
    usable = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    return records.where(usable), records.where(~usable)


def union_batches(batches: list[DataFrame], spark: SparkSession | None = None) -> DataFrame:
    """All rows of all batches by column name; no batches give an empty record table."""
    if not batches:
        return (spark or SparkSession.active()).createDataFrame([], RECORD)
    return reduce(DataFrame.unionByName, batches)


def dedupe_latest(df: DataFrame, key: str = "id", order: str = "year") -> DataFrame:
    """One row per key: the latest, nulls last; ties fall to the remaining columns.

    The rank filter is pushed below the shuffle, so a hot key leaves each task as one row.
    """
    rest = [F.col(c).asc_nulls_last() for c in df.columns if c not in (key, order)]
    window = W.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), *rest)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def cap_records(df: DataFrame, n: int, order: str = "year", key: str = "id") -> DataFrame:
    """The ``n`` most recent rows, key ascending within a year; 0 keeps all.

    Only the two ordering columns are sorted. The last kept pair is a scalar subquery, so the
    wide rows pass through a filter and are never gathered.
    """
    if not n:
        return df
    newest_first = [F.col(order).desc_nulls_last(), F.col(key).asc()]
    last = (
        df.select(order, key)
        .orderBy(*newest_first)
        .limit(n)
        .orderBy(F.col(order).asc_nulls_first(), F.col(key).desc())
        .limit(1)
        .select(F.struct(order, key).alias("last"))
        .scalar()
    )
    last_order, last_key = last[order], last[key]
    # An empty table has no last pair; the comparison is then null and keeps nothing.
    return df.where(
        F.when(
            last_order.isNull(), F.col(order).isNotNull() | (F.col(key) <= last_key)
        ).otherwise(
            (F.col(order) > last_order)
            | ((F.col(order) == last_order) & (F.col(key) <= last_key))
        )
    )


def ingest_summary(raw: DataFrame, kept: DataFrame, batch_size: int = 5000) -> DataFrame:
    """Reported, collected and rejected counts, and the number of batches of ``batch_size``."""
    reported = raw.select(F.count(F.lit(1))).scalar()
    return kept.agg(F.count(F.lit(1)).alias("collected")).select(
        reported.alias("reported"),
        "collected",
        (reported - F.col("collected")).alias("dropped"),
        F.ceil(F.col("collected") / batch_size).cast("bigint").alias("batches"),
    )


def institution_directory(works: DataFrame) -> DataFrame:
    """Institutions with the number of distinct works at each."""
    return (
        works.select(
            F.col("id").alias("work"),
            F.explode(
                F.array_distinct(
                    F.flatten(
                        F.filter(
                            F.transform("authorships", lambda a: a["institutions"]),
                            lambda i: i.isNotNull(),
                        )
                    )
                )
            ).alias("inst"),
        )
        .groupBy(F.col("inst.id").alias("id"))
        .agg(
            F.min("inst.display_name").alias("display_name"),
            F.min("inst.ror").alias("external_id"),
            F.count_distinct("work").alias("works_count"),
        )
    )


#: Letters of a word start that the search index keeps.
INDEX_LETTERS = 32


def _starts_a_word(name: Column, q: str) -> Column:
    low = F.lower(name)
    return low.startswith(q.lower()) | low.contains(" " + q.lower())


def search_institutions(directory: DataFrame, q: str, n: int = 10, min_len: int = 2) -> DataFrame:
    """The ``n`` largest institutions with a word starting with ``q``; too short a ``q`` finds none."""
    if len(q) < min_len:
        return directory.limit(0)
    hits = directory.where(_starts_a_word(F.col("display_name"), q))
    return hits.orderBy(F.desc("works_count"), "id").limit(n)


def _tagged(entities: dict[str, DataFrame]) -> DataFrame:
    tagged = [
        df.select(F.lit(kind).alias("kind"), "id", "display_name", "works_count")
        for kind, df in entities.items()
    ]
    return reduce(DataFrame.unionByName, tagged)


def search_entities(
    entities: dict[str, DataFrame], q: str, n: int = 10, min_len: int = 2
) -> DataFrame:
    """:func:`search_institutions` over several kinds of entity (id, display_name, works_count)."""
    everything = _tagged(entities)
    if len(q) < min_len:
        return everything.limit(0)
    hits = everything.where(_starts_a_word(F.col("display_name"), q))
    return hits.orderBy(F.desc("works_count"), "kind", "id").limit(n)


def write_search_index(entities: dict[str, DataFrame], path: str) -> None:
    """Entities by the starts of their words, for :func:`search_index`.

    A row per word: the lower-cased rest of the name from it on, at most ``INDEX_LETTERS`` letters. Rows are
    sorted over all files, so the statistics of a file or row group tell whether it can hold a start.
    """
    low = F.lower("display_name")
    rests = F.transform(
        F.filter(F.sequence(F.lit(1), F.length(low)), lambda i: (i == 1) | (F.substring(low, i - 1, F.lit(1)) == " ")),
        lambda i: F.substring(low, i, F.lit(INDEX_LETTERS)),
    )
    # A name of no letters starts with the empty text only.
    starts = F.when(F.length(low) > 0, F.array_distinct(rests)).otherwise(F.array(F.lit("")))
    rows = _tagged(entities).where("display_name is not null").select(F.explode(starts).alias("start"), "*")
    rows.repartitionByRange("start", "kind", "id").sortWithinPartitions("start", "kind", "id").write.mode("overwrite").parquet(path)


def search_index(index: DataFrame, q: str, n: int = 10, min_len: int = 2) -> DataFrame:
    """:func:`search_entities` over a written index: only files and row groups that can hold the start of ``q`` are read."""
    found = index.where(F.col("start").startswith(q.lower()[:INDEX_LETTERS]) & _starts_a_word(F.col("display_name"), q))
    hits = found.drop("start").dropDuplicates(["kind", "id", "display_name"])
    if len(q) < min_len:
        return hits.limit(0)
    return hits.orderBy(F.desc("works_count"), "kind", "id").limit(n)
