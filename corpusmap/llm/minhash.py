"""Near duplicates by consistent weighted sampling of TF-IDF shingles.

1. Texts that are equal byte for byte form one row; idf counts such distinct texts.
2. Shingles are runs of five words (letters and digits, A-Z lower-cased); a text of fewer words is one
   shingle. Their document frequencies come from all texts through :mod:`corpusmap.llm.blocks`;
   idf runs from 1 to 1.25, so that a link depends little on how many copies a group has.
3. A shingle of one text only has the largest idf of all, so a text of which such shingles hold more
   than 1 - ``SIMILARITY`` of the weight cannot reach the threshold with any other: an exact filter. The other texts
   keep the shingles of two or more texts, and the total weight of all.
4. Improved consistent weighted sampling (Ioffe, ICDM 2010) draws ``BANDS x ROWS`` samples whose chance to be
   equal is the weighted Jaccard similarity; ``ROWS`` samples make a band. A pair of similarity 0.8
   shares a band with probability 0.9992.
5. Pairs in a band's bucket are verified by exact weighted Jaccard similarity. A bucket first compares its
   members with one leader, so a group of n near copies costs n comparisons; rounds with other
   leaders follow as long as they join components, then every pair of the bucket that is still in different
   components is verified. Comparisons that could not change a component are never made, nor are all pairs of a group.

Result: every row gets class_id, the smallest doc_id of its class: equal texts and all linked directly or through
others.

Defined cases: null is the empty text; texts without words are alone in their class but for equal texts; repeated rows share
a class; a class of null ids only has a null class_id, and repeated ids with other texts may give two classes one class_id; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusmap.llm.blocks import (
    Layout,
    bucket_units,
    first_in_task,
    in_blocks,
    joined_reply,
    layout,
    questions,
    replies,
    tidily,
)
from corpusmap.llm.words import U64, Words, alnum_mask, buffer_of, mix, windows
from corpusmap.operators.components import connected_components
from corpusmap.sources.scratch import discard, materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 3
IDF_RANGE = 0.25
_SLICE = 4096
#: Members of a bucket that one task compares with as many others.
_BLOCK = 256
_VECTOR = "key string, total double, shingles binary, weights binary, bands array<long>"


def idf(df: np.ndarray, n_texts: int) -> np.ndarray:
    """1 for a shingle of all texts, rising with the logarithm to 1 + ``IDF_RANGE`` for a shingle of one text only.

    The range is small since the frequencies hold the near copies themselves: with a wide one, the words that
    copies share would count the less, the more copies there are, and large groups would fall apart.
    """
    return 1.0 + IDF_RANGE * np.log((1.0 + n_texts) / (1.0 + df)) / np.log(max((1.0 + n_texts) / 2.0, 2.0))


def _distinct(table: pa.Table) -> pa.Table:
    """Rows of a block, one per key, ordered by it."""
    keys = table.column("key").to_pylist()
    order = {k: i for i, k in enumerate(keys)}
    return table.take(pa.array([order[k] for k in sorted(order)], pa.int64()))


def _shingles(table: pa.Table, plan: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, row, times) of a block, ordered by shingle, then row."""
    data, offsets = buffer_of(table.column("text"))
    words = Words(data, offsets, alnum_mask())
    found, row = windows(words.hash, words.first, SHINGLE)
    found = plan.trim(found)
    order = np.lexsort((row, found))
    found, row = found[order], row[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return found[at], row[at], np.diff(np.append(at, len(found)))


def _runs(values: np.ndarray) -> np.ndarray:
    """Begin of each run of equal values, and the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def samples(shingles: np.ndarray, weights: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """``k`` consistent weighted samples, as hashes, of each non-empty range of ``first``."""
    out = np.zeros((len(first) - 1, k), U64)
    begin = 0
    while begin < len(first) - 1:
        end = max(begin + 1, int(np.searchsorted(first, first[begin] + _SLICE, "right")) - 1)
        a, b = first[begin], first[end]
        s, logw = shingles[a:b], np.log(weights[a:b])
        heads = first[begin:end] - a
        sizes = np.diff(np.append(heads, b - a))
        for j in range(k):
            u = [_uniform(s, 5 * j + n) for n in range(5)]
            r = -np.log(u[0] * u[1])
            c = -np.log(u[2] * u[3])
            t = np.floor(logw / r + u[4])
            rank = np.log(c) - r * (t - u[4] + 1.0)
            low = np.minimum.reduceat(rank, heads)
            hits = np.flatnonzero(rank == np.repeat(low, sizes))
            where = hits[np.searchsorted(hits, heads)]
            out[begin:end, j] = mix(s[where] ^ mix(t[where].astype(np.int64).view(U64) + U64(j)))
        begin = end
    return out


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = mix(keys + U64((salt + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    return ((x >> U64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _band_keys(drawn: np.ndarray) -> np.ndarray:
    out = np.zeros((len(drawn), BANDS), U64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            h = np.full(len(drawn), b + 1, U64)
            for j in range(ROWS):
                h = mix(h * U64(31) + drawn[:, b * ROWS + j])
            out[:, b] = h
    return out.view(np.int64)


def vectors(texts: DataFrame, n_texts: int, total_bytes: int, similarity: float) -> DataFrame:
    """Weighted shingles, total weight and bands of the distinct (key, text) that can have a near copy."""
    plan = layout(total_bytes)
    dealt = in_blocks(first_in_task(texts, "key"), ["key"], plan)

    def ask(table: pa.Table):
        found, _, _ = _shingles(_distinct(table), plan)
        at = _runs(found)
        return found[at[:-1]], [np.diff(at).astype(np.uint32)]

    def answer(keys: np.ndarray, extra: list[np.ndarray]) -> list[np.ndarray]:
        order = np.argsort(keys, kind="stable")
        at = _runs(keys[order])
        total = np.add.reduceat(extra[0][order].astype(np.int64), at[:-1])
        out = np.empty(len(keys), np.uint32)
        out[order] = np.repeat(np.minimum(total, 2**32 - 1), np.diff(at))
        return [out]

    def finish(table: pa.Table, got: pa.Table) -> pa.Table:
        table = _distinct(table)
        found, row, times = _shingles(table, plan)
        (df,) = joined_reply(got, [np.uint32])
        df = np.repeat(df, np.diff(_runs(found)))
        order = np.argsort(row, kind="stable")
        found, row, df = found[order], row[order], df[order]
        # Rounded as they are kept, so that totals and sums of kept weights agree.
        weight = (times[order] * idf(df, n_texts)).astype(np.float32).astype(np.float64)
        n = len(table)
        total = np.bincount(row, weight, n)
        shared = np.bincount(row, weight * (df > 1), n)
        able = (shared >= similarity * total - 1e-9) & (total > 0)
        keep = (df > 1) & able[row]
        found, row, weight = found[keep], row[keep], weight[keep]
        rows = np.flatnonzero(able)
        first = np.searchsorted(row, np.append(rows, n))
        bands = _band_keys(samples(found, weight, first, BANDS * ROWS)) if len(rows) else np.zeros((0, BANDS), np.int64)
        pieces = list(zip(first[:-1], first[1:], strict=True))
        return pa.table(
            {
                "key": table.column("key").take(pa.array(rows, pa.int64())),
                "total": pa.array(total[rows], pa.float64()),
                "shingles": pa.array([found[a:b].tobytes() for a, b in pieces], pa.binary()),
                "weights": pa.array([weight[a:b].astype(np.float32).tobytes() for a, b in pieces], pa.binary()),
                "bands": pa.array(list(bands), pa.list_(pa.int64())),
            }
        )

    answers = replies(questions(dealt, plan, ask), plan, answer, [np.uint32])
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lambda a, b: tidily(finish, a, b), _VECTOR
    )


def jaccard(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two (total, shingles, weights), shingles being ordered."""
    at = np.searchsorted(b[1], a[1])
    at[at == len(b[1])] = 0
    same = b[1][at] == a[1] if len(b[1]) else np.zeros(len(a[1]), bool)
    common = np.minimum(a[2][same], b[2][at[same]]).sum(dtype=np.float64)
    return float(common / (a[0] + b[0] - common))


def _verified(pairs: DataFrame, vector: DataFrame, similarity: float) -> DataFrame:
    """The pairs (src, dst) of at least the similarity."""
    side = lambda s: vector.select(*(F.col(c).alias(f"{c}_{s}") for c in ("key", "total", "shingles", "weights")))
    both = pairs.join(side("a"), F.col("src") == F.col("key_a")).join(side("b"), F.col("dst") == F.col("key_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row in zip(*(c for c in batch.columns[2:]), strict=True):
                a, b = (
                    (
                        row[i].as_py(),
                        np.frombuffer(row[i + 1].as_py(), U64),
                        np.frombuffer(row[i + 2].as_py(), np.float32),
                    )
                    for i in (0, 3)
                )
                keep.append(jaccard(a, b) >= similarity - 1e-9)
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return both.select(
        "src", "dst", "total_a", "shingles_a", "weights_a", "total_b", "shingles_b", "weights_b"
    ).mapInArrow(check, "src string, dst string")


def components(vector: DataFrame, similarity: float) -> DataFrame:
    """(key, component) of the vectors that have a near copy."""
    spark = vector.sparkSession
    buckets = materialize(
        vector.select("key", F.posexplode("bands").alias("band", "value")),
        "buckets",
    )
    edges = spark.createDataFrame([], "src string, dst string")
    parts = None
    open_rows = buckets.withColumn("component", F.col("key"))
    before, turn = None, 0
    while True:
        # Buckets whose members are in more than one component, with a leader drawn by a hash.
        split = materialize(
            open_rows.groupBy("band", "value")
            .agg(
                F.min("component").alias("low"),
                F.max("component").alias("high"),
                F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("h"), "key", "component")).alias("leader"),
            )
            .where("low != high")
            .select(
                "band",
                "value",
                F.col("leader.key").alias("leader"),
                F.col("leader.component").alias("leader_component"),
            ),
            "split",
        )
        rows = materialize(open_rows.join(split.hint("merge"), ["band", "value"]), "open")
        left = rows.count()
        settled = before is not None and left > 0.5 * before
        if not left or settled:
            break
        before = left
        pairs = (
            rows.where("component != leader_component")
            .select(F.least("leader", "key").alias("src"), F.greatest("leader", "key").alias("dst"))
            .distinct()
        )
        edges = materialize(edges.unionByName(_verified(pairs, vector, similarity)), "edges")
        parts = materialize(connected_components(edges).withColumnRenamed("node", "key"), "parts")
        open_rows = (
            rows.select("band", "value", "key")
            .join(parts.hint("merge"), "key", "left")
            .withColumn("component", F.coalesce("component", "key"))
        )
        turn += 1
    if left:  # leaders join little more: the pairs still in different components are compared in their buckets
        wide = rows.select("band", "value", "key", "component").join(vector, "key")
        edges = materialize(edges.unionByName(_settled(wide, similarity)), "edges")
        parts = materialize(connected_components(edges).withColumnRenamed("node", "key"), "parts")
    discard(buckets)
    return spark.createDataFrame([], "key string, component string") if parts is None else parts


def _settled(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (src, dst) that join different components of a bucket; a pair of several buckets is looked at in
    the first. Per member of a unit one pass over the unit's shingles compares it with all others."""

    def compare(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_pylist()
        component = table.column("component").to_pylist()
        names = {c: i for i, c in enumerate(dict.fromkeys(component))}
        group = np.array([names[c] for c in component])
        src, dst = [], []
        if len(names) > 1:
            band = table.column("band")[0].as_py()
            bands = np.array(table.column("bands").to_pylist(), np.int64).reshape(len(keys), -1)
            second = np.array(table.column("second").to_pylist(), bool)
            cross = table.column("low")[0].as_py() != table.column("high")[0].as_py()
            total = table.column("total").to_numpy()
            own = [np.frombuffer(x.as_py(), U64) for x in table.column("shingles")]
            weight = np.concatenate([np.frombuffer(x.as_py(), np.float32) for x in table.column("weights")])
            known, place = np.unique(np.concatenate(own), return_inverse=True)
            first = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            dense = np.zeros(len(known), np.float32)
            filled = np.flatnonzero(np.diff(first))
            for i in range(len(keys)):
                rest = (group != group[i]) & (np.arange(len(keys)) > i)
                if cross:
                    rest = (group != group[i]) & second & ~second[i]
                rest &= (bands[:, :band] != bands[i, :band]).all(axis=1)
                rest &= np.minimum(total, total[i]) >= (similarity - 1e-9) * np.maximum(total, total[i])
                if not rest.any():
                    continue
                mine = slice(first[i], first[i + 1])
                dense[place[mine]] = weight[mine]
                common = np.zeros(len(keys))
                common[filled] = np.add.reduceat(
                    np.minimum(weight, dense[place]), first[filled], dtype=np.float64
                )
                dense[place[mine]] = 0
                for j in np.flatnonzero(rest & (common >= (similarity - 1e-9) * (total + total[i] - common))):
                    if group[j] != group[i]:
                        src.append(keys[i])
                        dst.append(keys[j])
                        group[group == group[j]] = group[i]
        return pa.table({"src": pa.array(src, pa.string()), "dst": pa.array(dst, pa.string())})

    units = bucket_units(rows, ["band", "value"], "key", _BLOCK)
    return units.groupBy("band", "value", "low", "high").applyInArrow(
        lambda table: tidily(compare, table), "src string, dst string"
    )


def _classes(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, key of every row), (key, component) and (component, first), the lowest (no_id, doc_id, key) of it."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = texts.select("doc_id", F.md5("text").alias("key"), F.octet_length("text").alias("size"))
    classes = materialize(
        ids.groupBy("key").agg(F.min("doc_id").alias("lowest"), F.first("size").alias("size")), "classes"
    )
    known = classes.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    vector = materialize(
        vectors(texts.select(F.md5("text").alias("key"), "text"), known["n"], known["bytes"] or 0, similarity),
        "vectors",
    )
    parts = components(vector, similarity)
    named = classes.select("key", "lowest").join(parts, "key", "left").withColumn("component", F.coalesce("component", "key"))
    order = F.struct(F.col("lowest").isNull().alias("no_id"), F.col("lowest").alias("doc_id"), "key")
    lowest = materialize(named.groupBy("component").agg(F.min(order).alias("first")), "lowest")
    return ids.select("doc_id", "key"), named.select("key", "component"), lowest


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """class_id of every row of (doc_id, text): (doc_id, key, class_id); key is the md5 of the text."""
    ids, named, lowest = _classes(docs, similarity)
    class_id = F.col("first.doc_id").alias("class_id")
    members = materialize(named.join(lowest.hint("merge"), "component").select("key", class_id), "members")
    return ids.join(members.hint("merge"), "key").select("doc_id", "key", "class_id")


def representatives(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class one row of the smallest doc_id stays.

    Classes are told apart by their texts: null and repeated ids belong to several.
    """
    _, _, lowest = _classes(docs, similarity)
    chosen = lowest.select(F.col("first.doc_id").alias("_id"), F.col("first.key").alias("_key"))
    rows = docs.select(
        F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.md5(F.coalesce("text", F.lit(""))).alias("_key")
    )
    same = rows["_id"].eqNullSafe(chosen["_id"]) & (rows["_key"] == chosen["_key"])
    kept = rows.join(chosen, same, "left_semi")
    # Rows that repeat both id and text: one of them, without moving them again.
    return kept.dropDuplicates(["_id", "_key"]).select("_row.*")
