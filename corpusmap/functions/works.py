"""Column functions over raw bibliographic works and flat records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from corpusmap.sources.scratch import materialize


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def inverted_index(words: Column) -> Column:
    """Word → positions map of an array of words, positions from 0; words meet inside the row, without a shuffle."""

    def entries(placed: Column) -> Column:
        word = lambda i: F.get(placed, i)["word"]
        heads = F.filter(
            F.sequence(F.lit(0), F.size(placed)), lambda i: (i == 0) | ~word(i).eqNullSafe(word(i - 1))
        )
        return let(
            heads,
            lambda at: F.transform(
                F.slice(at, F.lit(1), F.size(at) - 1),
                lambda p, j: F.struct(
                    word(p).alias("word"),
                    F.transform(F.slice(placed, p + 1, F.get(at, j + 1) - p), lambda e: e["at"]).alias("at"),
                ),
            ),
        )

    placed = F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at")))
    return F.map_from_entries(let(F.sort_array(placed), entries))


def merge_indexes(indexes: DataFrame, key: str) -> DataFrame:
    """One ``index`` for each ``key``: rows of one key list their positions together.

    Only keys that come twice move their indexes; of the others no more than the keys are exchanged.
    """
    found = indexes.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    repeated = materialize(found.select(F.col(key).alias("_key")), "repeated")
    same = F.col(key).eqNullSafe(F.col("_key"))
    merged = (
        indexes.join(repeated, same, "left_semi")
        .select(key, F.explode("index").alias("word", "at"))
        .groupBy(key, "word")
        .agg(F.flatten(F.collect_list("at")).alias("at"))
        .groupBy(key)
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("index"))
    )
    return indexes.join(repeated, same, "left_anti").select(key, "index").unionByName(merged)


def abstract_from_inverted_index(index: Column) -> Column:
    """Text of a word → positions map, words in position order.

    On a shared position the later map entry wins; empty words and gaps vanish.
    """
    per_entry = F.transform(
        F.filter(F.map_entries(index), lambda e: e["value"].isNotNull()),
        lambda e, i: F.transform(
            e["value"], lambda p: F.struct(p.alias("at"), i.alias("entry"), e["key"].alias("word"))
        ),
    )

    def last_word_per_position(placed: Column) -> Column:
        return F.filter(
            placed,
            lambda p, i: (p["word"] != "")
            & ~F.get(placed, i + 1)["at"].eqNullSafe(p["at"]),
        )

    kept = let(F.sort_array(F.flatten(per_entry)), last_word_per_position)
    words = F.transform(kept, lambda p: p["word"])
    return F.coalesce(F.array_join(words, " "), F.lit(""))


def first_institution(authorships: Column) -> Column:
    """Name of the first institution of the first author that has any, else ``''``."""
    having = F.filter(authorships, lambda a: F.size(a["institutions"]) > 0)
    name = F.get(F.get(having, F.lit(0))["institutions"], F.lit(0))["display_name"]
    return F.coalesce(name, F.lit(""))


def best_url(landing: Column, work_id: Column) -> Column:
    """Landing page, or the id when the page is null or empty."""
    return F.coalesce(F.nullif(landing, F.lit("")), work_id)


def short_id(url: Column) -> Column:
    """Last part of a path."""
    return F.element_at(F.split(url, "/"), -1)


def institution_key(external_id: Column, native_id: Column) -> Column:
    """Short id of an institution: its registry id when it has one, else its native id."""
    return short_id(
        F.when(external_id.contains("ror.org"), external_id).otherwise(native_id)
    )


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by null in every float and double column."""
    floats = [
        f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    ]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def downcast(df: DataFrame) -> DataFrame:
    """Narrow 64-bit integers to 32 bits; a value out of range raises (ANSI mode)."""
    longs = [f.name for f in df.schema if isinstance(f.dataType, T.LongType)]
    return df.withColumns({c: F.col(c).cast("int") for c in longs})


def minmax_scale(df: DataFrame, column: str, out: str = "scaled") -> DataFrame:
    """Scale ``column`` to [0, 1]; a constant column gives 0. The range is a scalar subquery."""
    span = df.select(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    width = span["hi"] - span["lo"]
    return df.withColumn(
        out, (F.col(column) - span["lo"]) / F.when(width == 0, F.lit(1.0)).otherwise(width)
    )


def to_json_rows(df: DataFrame, out: str = "json") -> DataFrame:
    """One JSON text per row; null fields are kept."""
    row = F.struct(*df.columns)
    return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias(out))


def parse_json_rows(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` parsed from a JSON text column."""
    return df.select(F.from_json(column, schema).alias("row")).select("row.*")
