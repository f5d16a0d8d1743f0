"""Near duplicates among embeddings with binary codes of randomly rotated vectors.

A rotated unit vector o is stored as the signs of its coordinates, s / sqrt(d), and the correction factor
f = <o, s / sqrt(d)>. For another unit vector q, <q, s / sqrt(d)> / f is an unbiased estimate of <q, o> whose error stays
below EPSILON * sqrt((1 - f^2) / f^2 / (d - 1)) but for a chance of about exp(-EPSILON^2 / 2) (Gao and Long, RaBitQ,
SIGMOD 2024). Pairs whose upper bound is below the threshold are dropped; the others are recomputed exactly, in double
precision, and only that decides on a link.

Which pairs are estimated: the sign bits of further rotations are split into tables of k bits; pairs that
agree in all bits of some table are. k grows with the logarithm of the number of vectors, so buckets stay small,
and the number of tables follows from k such that a pair right at the threshold is met with probability ``RECALL``,
closer ones more surely.

Equal vectors are one class with a multiplicity. A bucket over ``BLOCK`` classes is cut into blocks, and its pairs of blocks
are tasks of their own. A pair counts in the first table where it meets, so links are summed without
listing pairs; each task reports per vector a sum and one edge of a spanning forest of the links it found.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without vec_id,
link with nothing and are components of their own; vectors of different lengths never link; rows that repeat an id count as other
vectors; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmap.llm.blocks import bucket_units
from corpusmap.llm.words import U64, mix
from corpusmap.operators.components import connected_components
from corpusmap.sources.scratch import materialize

SIMILARITY = 0.9
RECALL = 0.995
EPSILON = 4.0
#: Classes of a bucket that one task compares; also the bucket size that k aims at, times 16.
BLOCK = 1024


def tables(n: int, similarity: float, recall: float) -> tuple[int, int]:
    """(bits of a table, number of tables) for ``n`` vectors."""
    bits = max(2, min(48, round(math.log2(max(n, 1) / (BLOCK / 16) + 1))))
    same = (1 - math.acos(similarity) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


@lru_cache(maxsize=4)
def rotations(dim: int, count: int) -> np.ndarray:
    """``count`` rows of random rotations of a space, stacked; the first ``dim`` rows are one rotation."""
    rows = []
    for i in range(-(-count // dim)):
        q, r = np.linalg.qr(np.random.default_rng(1000 * dim + i).standard_normal((dim, dim)))
        rows.append((q * np.sign(np.diag(r))).T)
    return np.concatenate(rows)


def bucket_keys(unit: np.ndarray, bits: int, count: int) -> np.ndarray:
    """Bucket of each vector in each table; the code for the estimates uses none of these rotations."""
    dim = unit.shape[1]
    signs = unit @ rotations(dim, dim + bits * count)[dim : dim + bits * count].T >= 0
    weights = U64(1) << np.arange(bits, dtype=U64)
    codes = (signs.reshape(len(unit), count, bits).astype(U64) * weights).sum(axis=2, dtype=U64)
    return mix(mix(codes + U64(dim)) ^ (np.arange(count, dtype=U64) + U64(1))).view(np.int64)


def _unit(raw: list[bytes], kind) -> np.ndarray:
    rows = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    # Scaled by the largest component first: tiny and huge vectors keep their direction.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _spread(classes: DataFrame, kind, bits: int, count: int) -> DataFrame:
    """A row per class and table: (bucket, tab, key, n, vector)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(v) if v else 0 for v in batch.column("embedding").to_pylist()]
            for dim in sorted(set(sizes)):
                rows = [i for i, s in enumerate(sizes) if s == dim]
                for a in range(0, len(rows), 256):
                    part = batch.take(pa.array(rows[a : a + 256]))
                    raw = [np.array(v, kind).tobytes() for v in part.column("embedding").to_pylist()]
                    keys = bucket_keys(_unit(raw, kind), bits, count)
                    every = pa.array(np.repeat(np.arange(len(raw)), count))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys.reshape(-1)),
                            pa.array(np.tile(np.arange(count, dtype=np.int32), len(raw))),
                            part.column("key").take(every),
                            part.column("n").take(every),
                            pa.array(raw, pa.binary()).take(every),
                        ],
                        ["bucket", "tab", "key", "n", "vector"],
                    )

    return classes.select("key", "n", "embedding").mapInArrow(
        place, "bucket long, tab int, key string, n long, vector binary"
    )


def links(unit: np.ndarray, similarity: float, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of rows, j of columns) of vectors whose cosine reaches the threshold."""
    dim = unit.shape[1]
    turned = (unit @ rotations(dim, dim)[:dim].T).astype(np.float32)
    signs = np.where(turned >= 0, np.float32(1), np.float32(-1)) / np.float32(math.sqrt(dim))
    factor = np.minimum((turned * signs).sum(axis=1, dtype=np.float64), 1.0)
    error = EPSILON * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / max(dim - 1, 1)) + 1e-5
    upper = turned[rows] @ signs[columns].T / factor[columns] + error[columns]
    likely = upper >= similarity
    upper = (signs[rows] @ turned[columns].T) / factor[rows][:, None] + error[rows][:, None]
    i, j = np.nonzero(likely & (upper >= similarity))
    i, j = rows[i], columns[j]
    keep = np.zeros(len(i), bool)
    for a in range(0, len(i), 1 << 16):
        s = slice(a, a + (1 << 16))
        keep[s] = np.einsum("ij,ij->i", unit[i[s]], unit[j[s]]) >= similarity
    return i[keep], j[keep]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lowest row reachable from each row by the pairs."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _compare(spread: DataFrame, kind, similarity: float, bits: int, count: int) -> DataFrame:
    """(key, links, root): sums and spanning edges of the links of every bucket."""
    units = bucket_units(spread, ["bucket"], "key", BLOCK)

    def compare(table: pa.Table) -> pa.Table:
        out = {"key": [], "links": [], "root": []}
        if len(table) > 1:
            unit = _unit(table.column("vector").to_pylist(), kind)
            tab = table.column("tab")[0].as_py()
            second = np.array(table.column("second").to_pylist())
            cross = table.column("low")[0].as_py() != table.column("high")[0].as_py()
            keys = np.array(table.column("key").to_pylist())
            n = table.column("n").to_numpy()
            every = np.arange(len(unit))
            i, j = links(unit, similarity, every[~second] if cross else every, every[second] if cross else every)
            if not cross:
                i, j = i[keys[i] < keys[j]], j[keys[i] < keys[j]]
            bucket = bucket_keys(unit, bits, count)
            first = np.ones(len(i), bool)
            for a in range(0, len(i), 1 << 16):
                s = slice(a, a + (1 << 16))
                first[s] = (bucket[i[s], :tab] != bucket[j[s], :tab]).all(axis=1)
            i, j = i[first], j[first]
            total = np.bincount(i, n[j], len(unit)) + np.bincount(j, n[i], len(unit))
            root = _roots(len(unit), i, j)
            some = np.flatnonzero(total)
            out = {"key": keys[some].tolist(), "links": total[some].astype(np.int64).tolist(), "root": keys[root[some]].tolist()}
        return pa.table(
            {"key": pa.array(out["key"], pa.string()), "links": pa.array(out["links"], pa.int64()), "root": pa.array(out["root"], pa.string())}
        )

    return units.groupBy("bucket", "low", "high").applyInArrow(compare, "key string, links long, root string")


def near_duplicates(
    vectors: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL
) -> DataFrame:
    """Per row of (vec_id, embedding): n_links, component_id and kept."""
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = np.float32 if element == "float" else np.float64
    value = F.col("embedding")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = F.col("vec_id").isNotNull() & value.isNotNull() & finite & F.exists(value, lambda x: x != 0)
    key = F.concat_ws("-", F.hex(F.xxhash64(value)), F.hex(F.xxhash64(F.reverse(value), F.lit(1))))
    rows = vectors.select("vec_id", F.when(F.coalesce(valid, F.lit(False)), key).alias("key"), "embedding")
    classes = materialize(
        rows.where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.min("vec_id").alias("lowest"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")),
        "vector-classes",
    )
    bits, count = tables(classes.count(), similarity, recall)
    spread = _spread(classes.repartition("key"), kind, bits, count)
    found = materialize(_compare(spread, kind, similarity, bits, count), "links")
    parts = connected_components(found.select(F.col("key").alias("src"), F.col("root").alias("dst")))
    named = (
        classes.select("key", "lowest", "n")
        .join(parts.withColumnRenamed("node", "key"), "key", "left")
        .withColumn("component", F.coalesce("component", "key"))
    )
    lowest = materialize(named.groupBy("component").agg(F.min("lowest").alias("component_id")), "lowest")
    total = found.groupBy("key").agg(F.sum("links").alias("links"))
    members = materialize(
        named.join(lowest.hint("merge"), "component")
        .join(total, "key", "left")
        .select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")),
        "vector-members",
    )
    own = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", "key").join(members.hint("merge"), "key", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        own.cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"),
    )
