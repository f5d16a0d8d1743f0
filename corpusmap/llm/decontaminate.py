"""Benchmark decontamination with spaced seeds.

A mask names the word positions of a window that count; the others may differ. The hashes of all
windows of the benchmark under all masks are the test side of a hash join, those of every window
of every document the other; it runs as a lookup in a table that each task holds. Each hit fixes an
alignment of a document with an item; it counts if any range of it, however it is surrounded, is long and
equal enough, and the best such range is kept.

The table holds at most ``MAX_WORDS`` benchmark words: a larger benchmark is split by item into parts of
that size, each a pass over the documents, so its size bounds time, never memory.

Words: runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased. An overlap counts if
it spans ``MIN_SPAN`` words, or the whole item where that is shorter, of which the share ``MIN_EQUAL`` is equal.

Defined cases: null or empty texts and items shorter than the shortest mask match nothing; items with
equal texts are each reported; repeated documents give repeated rows; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmap.llm.words import U64, Words, alnum_mask, buffer_of, mix, row_slices

#: 1 counts, 0 may differ.
MASKS = ("11011011", "1110010111", "110100110011", "101110111", "111111")
MIN_SPAN = 13
MIN_EQUAL = 0.8
#: Benchmark words looked for in one pass.
MAX_WORDS = 1_000_000
MISMATCH = -2
_SHARE = Fraction(str(MIN_EQUAL))
_BITS = 22


@dataclass
class SeedTable:
    """Words of the items and the hashes of their windows, ordered."""

    ids: list
    words: np.ndarray
    first: np.ndarray
    seed: np.ndarray
    at: np.ndarray
    filter: np.ndarray


def _masked(words: np.ndarray, first: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every window of a mask that stays inside its row."""
    mask = MASKS[which]
    if len(words) < len(mask):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    n = len(words) - len(mask) + 1
    inside = np.zeros(len(words) + 1, np.int64)
    edges = first[1:-1]
    np.add.at(inside, edges[edges < len(words)], 1)
    row = np.cumsum(inside)
    at = np.flatnonzero(row[:n] == row[len(mask) - 1 : len(mask) - 1 + n])
    out = np.full(len(at), which + 1, U64)
    with np.errstate(over="ignore"):
        for j, bit in enumerate(mask):
            if bit == "1":
                out = (out ^ words[at + j]) * U64(0x9E3779B97F4A7C15)
                out ^= out >> U64(29)
    return mix(out), at


def seed_table(ids: list, texts: list[str | None]) -> SeedTable:
    data, offsets = buffer_of(pa.array(texts, pa.string()))
    found = Words(data, offsets, alnum_mask())
    seeds = [_masked(found.hash, found.first, m) for m in range(len(MASKS))]
    seed = np.concatenate([s for s, _ in seeds])
    at = np.concatenate([a for _, a in seeds])
    order = np.argsort(seed, kind="stable")
    seed, at = seed[order], at[order]
    known = np.zeros(1 << _BITS, bool)
    known[(seed >> U64(64 - _BITS)).astype(np.int64)] = True
    return SeedTable(ids, found.hash, found.first, seed, at, known)


def _largest(step: np.ndarray, least: int) -> tuple[int, int, int]:
    """(sum, begin, end) of the range of at least ``least`` words with the largest sum."""
    total = np.concatenate([[0], np.cumsum(step)])
    lowest = np.minimum.accumulate(total[: len(total) - least])
    gain = total[least:] - lowest
    at = int(np.argmax(gain))
    return int(gain[at]), int(np.flatnonzero(total[: at + 1] == lowest[at])[-1]), at + least


def best_overlap(equal: np.ndarray, least: int) -> tuple[int, int] | None:
    """[begin, end) of a range of at least ``least`` words of which the share ``MIN_EQUAL`` is equal, None if there is none.

    That is the range with the largest sum of 1 per equal and ``MISMATCH`` per other word if it will do, else
    the one whose equal words exceed the share by most, in whole numbers, so that a range right at it counts.
    """
    if len(equal) < least:
        return None
    over = np.where(equal, _SHARE.denominator, 0) - _SHARE.numerator
    _, begin, end = _largest(np.where(equal, 1, MISMATCH), 0)
    if end - begin >= least and over[begin:end].sum() >= 0:
        return begin, end
    gain, begin, end = _largest(over, least)
    return (begin, end) if gain >= 0 else None


def _overlaps(found: Words, table: SeedTable) -> Iterator[tuple]:
    """(row, item, first word in the document, first in the item, length, equal words)."""
    keys = []
    for m in range(len(MASKS)):
        seed, at = _masked(found.hash, found.first, m)
        likely = np.flatnonzero(table.filter[(seed >> U64(64 - _BITS)).astype(np.int64)])
        seed, at = seed[likely], at[likely]
        low = np.searchsorted(table.seed, seed, "left")
        many = np.searchsorted(table.seed, seed, "right") - low
        if many.sum() == 0:
            continue
        where = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        word = np.repeat(at, many)
        item = np.searchsorted(table.first, table.at[where], "right") - 1
        keys.append(np.stack([found.doc[word], item, word - table.at[where]], 1))
    if not keys:
        return
    best: dict[tuple[int, int], tuple] = {}
    for row, item, shift in np.unique(np.concatenate(keys), axis=0):
        lo = max(found.first[row], table.first[item] + shift)
        hi = min(found.first[row + 1], table.first[item + 1] + shift)
        equal = found.hash[lo:hi] == table.words[lo - shift : hi - shift]
        span = best_overlap(equal, min(MIN_SPAN, int(table.first[item + 1] - table.first[item])))
        if span is None:
            continue
        begin, end = span
        size, same = end - begin, int(equal[begin:end].sum())
        new = (same, size, -int(lo + begin - found.first[row]), -int(lo + begin - shift - table.first[item]))
        if new > best.get((row, item), ()):
            best[row, item] = new
    for (row, item), (same, size, doc_start, item_start) in sorted(best.items()):
        yield int(row), int(item), -doc_start, -item_start, size, same


def _parts(benchmark: DataFrame) -> list[DataFrame]:
    words = benchmark.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    parts = -(-words // MAX_WORDS)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(parts, 1)))
    return [benchmark.where(part == i) for i in range(parts)]


def _shared_tables(spark: SparkSession, benchmark: DataFrame) -> list:
    """Seed tables of the benchmark, each of bounded size, for the tasks."""
    out = []
    for part in _parts(benchmark.select("item_id", "text")):
        items = part.collect()
        out.append(
            spark.sparkContext.broadcast(seed_table([r["item_id"] for r in items], [r["text"] for r in items]))
        )
    return out


def _found(texts: pa.Array, table: SeedTable) -> Iterator[tuple]:
    """Overlaps of a batch of texts, by row."""
    data, offsets = buffer_of(texts)
    for a, b in row_slices(offsets):
        part = offsets[a : b + 1]
        words = Words(data[part[0] : part[-1]], part - part[0], alnum_mask())
        for row, *rest in _overlaps(words, table):
            yield row + a, *rest


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Best overlap of each (doc_id, item_id) that has one: doc_start, item_start, n_words, n_equal."""
    docs = docs.select("doc_id", "text")
    names = ["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_equal"]
    schema = (
        f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, "
        "doc_start long, item_start long, n_words long, n_equal long"
    )
    out = None
    for shared in _shared_tables(docs.sparkSession, benchmark):

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table = shared.value
            for batch in batches:
                rows = list(_found(batch.column("text"), table))
                if rows:
                    row, item, *rest = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
                    ids = batch.column("doc_id").take(row), pa.array(table.ids).take(item)
                    yield pa.RecordBatch.from_arrays([*ids, *rest], names)

        found = docs.mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text overlaps no item; all columns stay, nothing is shuffled."""
    at = docs.columns.index("text")
    for shared in _shared_tables(docs.sparkSession, benchmark):

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, *_ in _found(batch.column(at), shared.value)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
