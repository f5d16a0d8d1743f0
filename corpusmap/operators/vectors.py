"""Vector operators: pooling, normalising, embedding text."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import md5
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from corpusmap.functions.works import let
from corpusmap.sources.scratch import materialize

Encoder = Callable[[list[str]], np.ndarray]

# Lower limits of a mask sum and of a norm.
MIN_MASK_SUM = 1e-9
MIN_NORM = 1e-12
# Texts whose words are counted together.
BLOCK_TEXTS = 4096


def mean_pool(df: DataFrame, id_col: str, vec: str, mask: str) -> DataFrame:
    """Masked mean of the token vectors of each id; an all-zero mask gives a zero vector."""
    masked = F.transform(vec, lambda v: v.cast("double") * F.col(mask).cast("double"))
    return (
        df.select(id_col, array_to_vector(masked).alias("v"), F.col(mask).alias("m"))
        .groupBy(id_col)
        .agg(Summarizer.sum(F.col("v")).alias("total"), F.sum("m").alias("mass"))
        .select(
            id_col,
            F.transform(
                vector_to_array("total"), lambda t: t / F.greatest("mass", F.lit(MIN_MASK_SUM))
            ).alias("embedding"),
        )
    )


def l2_normalized(vec: Column) -> Column:
    """Vector divided by its length; a zero vector stays zero."""
    values = F.transform(vec, lambda v: v.cast("double"))
    return let(
        values,
        lambda a: let(
            F.greatest(
                F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)), F.lit(MIN_NORM)
            ),
            lambda norm: F.transform(a, lambda v: v / norm),
        ),
    )


def l2_normalize(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Replace ``vec`` by :func:`l2_normalized`."""
    return df.withColumn(vec, l2_normalized(F.col(vec)))


def _unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), MIN_NORM)


def _encode_with(df: DataFrame, make_encoder: Callable[[], Encoder], batch: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            parts = [
                _unit_rows(np.asarray(encode(texts[i : i + batch]), dtype=np.float64))
                for i in range(0, len(texts), batch)
            ]
            vectors = [v.astype(np.float32) for part in parts for v in part]
            yield pd.DataFrame({"id": frame["id"], "embedding": vectors})

    id_type = df.schema["id"].dataType.simpleString()
    return df.select("id", "text").mapInPandas(run, f"id {id_type}, embedding array<float>")


def _sign_bits(words: list[bytes], dims: int, seed: int) -> np.ndarray:
    """Bits of a digest of each word, one for each of ``dims`` dimensions, in whole groups of 32."""
    digests = -(-dims // 128)
    raw = b"".join(md5(b"%d|%d|" % (seed, part) + w).digest() for w in words for part in range(digests))
    return np.frombuffer(raw, ">u4").reshape(len(words), 4 * digests)[:, : -(-dims // 32)].astype("<u4")


_WORDS = "block long, bucket int, words binary, counts binary, ends binary"


def _counted(texts: DataFrame, buckets: int) -> DataFrame:
    """Blocks of texts (id, words) with their words, and by bucket the words of a block with the number of texts that have them.

    Bucket -1 holds a block: ``ids``, the end of each text in ``words`` and ``counts``, and words as places in the lists of
    all buckets. A word that many texts of a block have is sent once.
    """
    id_type = texts.schema["id"].dataType.simpleString()
    kept = ["id", "words"]

    def packed(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, spaced = (pa.concat_arrays([b.column(c) for b in held]) for c in kept)
        lists = pc.split_pattern(pc.fill_null(spaced, "").cast(pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        words, code = coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy())
        bucket = np.array([crc32(w) % buckets if w else -1 for w in words], np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(words), np.int64)
        none = np.count_nonzero(bucket < 0)  # the empty word comes first
        place[order] = np.arange(-none, len(words) - none)
        key, counts = np.unique((row * len(words) + place[code])[place[code] >= 0], return_counts=True)
        row, word = np.divmod(key, max(1, len(words)))
        texts = np.bincount(word, minlength=len(words) - none).astype("<i4")
        order, begin = order[none:], np.searchsorted(bucket[order], np.arange(buckets + 1))
        packs = [(word.astype("<i4").tobytes(), counts.astype("<i4").tobytes(), np.searchsorted(row, np.arange(len(ids)), "right").astype("<i4").tobytes())]
        some = np.flatnonzero(np.diff(begin))
        for k in some:
            mine = slice(begin[k] - none, begin[k + 1] - none)
            packs.append((b" ".join(words[i] for i in order[mine]), texts[mine].tobytes(), None))
        lists = pa.ListArray.from_arrays(pa.array([0] + [len(ids)] * len(packs), pa.int32()), ids)
        columns = [pa.array(c, pa.binary()) for c in zip(*packs, strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array([block] * len(packs), pa.int64()), pa.array([-1, *some.tolist()], pa.int32()), *columns, lists],
            ["block", "bucket", "words", "counts", "ends", "ids"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_TEXTS):
                part = whole.slice(at, BLOCK_TEXTS)
                if held and size + part.num_rows > BLOCK_TEXTS:
                    yield packed(block, held)
                    block, held, size = block + 1, [], 0
                held.append(part)
                size += part.num_rows
        if held:
            yield packed(block, held)

    return materialize(texts.select(*kept).mapInArrow(count, f"{_WORDS}, ids array<{id_type}>"), "counted")


def _encode_by_signs(df: DataFrame, dims: int, seed: int) -> DataFrame:
    rows = df.count()
    # Blocks times buckets grow slower than the square of the texts.
    buckets = max(1, int(16 * math.sqrt(rows / BLOCK_TEXTS)))
    spaced = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")
    counted = _counted(df.select("id", spaced.alias("words")), buckets)
    id_type = df.schema["id"].dataType.simpleString()

    def weigh(table: pa.Table) -> pa.Table:
        """For each word of each block, in order: its idf and its sign bits."""
        lists = [raw.split(b" ") for raw in table.column("words").to_pylist()]
        coded = pa.array([w for words in lists for w in words], pa.large_binary()).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        texts = np.bincount(code, np.frombuffer(b"".join(table.column("counts").to_pylist()), "<i4"))
        # A word of all texts weighs nothing.
        idf = np.log((rows + 1) / (texts + 1))[code].astype("<f8")
        bits = _sign_bits(coded.dictionary.to_pylist(), dims, seed)[code]
        ends = np.cumsum([len(words) for words in lists])[:-1]
        packs = [pa.array([v.tobytes() for v in np.split(a, ends)], pa.binary()) for a in (idf, bits)]
        return pa.table([table.column("block"), table.column("bucket"), *packs], ["block", "bucket", "idf", "bits"])

    def total(held: pa.Table, own: pa.Table) -> pa.Table:
        held, own = held.combine_chunks(), own.sort_by("bucket")
        ids = pa.concat_arrays(held.column("ids").chunks).flatten()
        word, count, ends = (np.frombuffer(held.column(c)[0].as_py(), "<i4") for c in ("words", "counts", "ends"))
        idf, bits = (b"".join(own.column(c).to_pylist()) for c in ("idf", "bits"))
        idf = np.frombuffer(idf, "<f8")
        bits = np.frombuffer(bits, np.uint8).reshape(len(idf), -(-dims // 32) * 4)
        signs = np.unpackbits(bits, axis=1, bitorder="little")[:, :dims] * 2.0 - 1.0
        weight = count * idf[word]
        sums, begin = np.zeros((len(ids), dims)), 0
        for i, end in enumerate(ends.tolist()):
            sums[i] = weight[begin:end] @ signs[word[begin:end]]
            begin = end
        offsets = pa.array(np.arange(0, sums.size + 1, dims, dtype=np.int32))
        return pa.table({"id": ids, "total": pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))})

    weighed = (
        counted.where("bucket >= 0").groupBy("bucket").applyInArrow(weigh, "block long, bucket int, idf binary, bits binary")
    )
    blocks = counted.where("bucket < 0").select(F.col("block").alias("block"), "words", "counts", "ends", "ids")
    summed = blocks.groupBy("block").cogroup(weighed.groupBy("block")).applyInArrow(total, f"id {id_type}, total array<double>")
    # Texts of one id share their sum; a text without id has none.
    by_id = summed.groupBy("id").agg(
        F.count(F.lit(1)).cast("int").alias("n"), *[F.sum(F.get("total", F.lit(d))).alias(f"d{d}") for d in range(dims)]
    )
    sums = F.when(F.col("id").isNotNull(), F.array(*[f"d{d}" for d in range(dims)])).otherwise(F.array_repeat(F.lit(0.0), dims))
    return by_id.select("id", l2_normalized(sums).cast("array<float>").alias("embedding"), F.explode(F.array_repeat("id", "n"))).select(
        "id", "embedding"
    )


def embed_text(
    df: DataFrame,
    make_encoder: Callable[[], Encoder] | None = None,
    batch: int = 64,
    dims: int = 64,
    seed: int = 42,
) -> DataFrame:
    """Unit vectors (id, embedding) of the texts (id, text).

    ``make_encoder`` is called once per task and returns a function from a list of texts to a
    matrix, so a model is loaded where it runs; a limit on text length is the encoder's own.
    Without one, TF-IDF weights of words are projected on ``dims`` signs, bits of a digest of
    the word. Words are cut by Spark and counted in blocks of texts; a block asks for a word's weight and signs once.
    """
    if make_encoder is not None:
        return _encode_with(df, make_encoder, batch)
    return _encode_by_signs(df, dims, seed)
