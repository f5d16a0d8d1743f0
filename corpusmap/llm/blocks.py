"""Questions about many keys per text, answered by all texts, in packed form.

Texts are dealt into blocks of a few MB by a hash. For each block ``ask`` computes a sorted array of
64-bit keys (shingles, fingerprints, word pairs). The key space is cut into equal parts; a block sends each
part its slice, as bytes, so a key that every text has costs one entry per block, never one per text. ``answer``
sees all entries of a part and replies to each block in the order of its question, so replies need no keys.
``finish`` meets the texts of the block again with the replies. The exchange of the texts is planned once
and read twice.

Blocks and parts hold the same amount at any input size; their number grows.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from corpusmap.llm.words import U64
from corpusmap.sources.scratch import materialize

BLOCK_BYTES = 2 << 20
#: Key bytes that travel unless a layout says otherwise; the part's number holds further leading bits, so
#: that the chance of two keys of a part being taken for one does not grow with the input.
KEY_BYTES = 5


Arrays = list[np.ndarray]
#: Keys that a part takes from all blocks together, about.
PART_KEYS = 1 << 18


@dataclass(frozen=True)
class Layout:
    blocks: int
    part_bits: int
    key_bytes: int = KEY_BYTES

    def trim(self, keys: np.ndarray) -> np.ndarray:
        """Keys cut to the bits that travel."""
        return keys & ~U64((1 << max(0, 64 - self.part_bits - 8 * self.key_bytes)) - 1)

    def runs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(part, begin, end) of the slices of sorted keys, of the parts that have any."""
        if not len(keys):
            return (np.zeros(0, np.int64),) * 3
        part = (keys >> U64(64 - self.part_bits)).astype(np.int64) if self.part_bits else np.zeros(len(keys), np.int64)
        begin = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1])
        return part[begin], begin, np.append(begin[1:], len(keys))

    def pack(self, keys: np.ndarray) -> bytes:
        with np.errstate(over="ignore"):
            rest = (keys << U64(self.part_bits)) if self.part_bits else keys
        return np.ascontiguousarray(rest.astype(">u8").view(np.uint8).reshape(-1, 8)[:, : self.key_bytes]).tobytes()

    def unpack(self, raw: bytes) -> np.ndarray:
        """Keys of a part without the part's bits, left-aligned: equal keys are equal, order is kept."""
        full = np.zeros((len(raw) // self.key_bytes, 8), np.uint8)
        full[:, : self.key_bytes] = np.frombuffer(raw, np.uint8).reshape(-1, self.key_bytes)
        return full.view(">u8").reshape(-1).astype(U64)


def layout(total_bytes: int, keys_per_byte: float = 0.16, key_bytes: int = KEY_BYTES) -> Layout:
    """Blocks of ``BLOCK_BYTES`` of text, parts of at most ``PART_KEYS`` keys."""
    blocks = max(1, -(-int(total_bytes) // BLOCK_BYTES))
    return Layout(blocks, int(total_bytes * keys_per_byte / PART_KEYS).bit_length(), key_bytes)


def _narrow(values: np.ndarray) -> str:
    """The narrowest type that holds the integers."""
    if len(values) and values.min() < 0:
        return "<i8"
    top = int(values.max()) if len(values) else 0
    return next(k for k in ("<u1", "<u2", "<u4", "<u8") if top <= np.iinfo(k).max)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Integer arrays of one length, each in its narrowest type, compressed together."""
    kinds = [_narrow(a) for a in arrays]
    body = b"".join(a.astype(k).tobytes() for a, k in zip(arrays, kinds, strict=True))
    return "".join(k[1:] for k in kinds).encode() + b";" + zlib.compress(body, 1)


def expand_all(raw: bytes, kinds: list) -> Arrays:
    """The arrays that :func:`squeeze` was given, in the given types."""
    head, _, body = raw.partition(b";")
    stored = [np.dtype("<" + head[i : i + 2].decode()) for i in range(0, len(head), 2)]
    body = zlib.decompress(body)
    n = len(body) // sum(k.itemsize for k in stored)
    out, at = [], 0
    for have, want in zip(stored, kinds, strict=True):
        out.append(np.frombuffer(body, have, n, at).astype(want, copy=False))
        at += n * have.itemsize
    return out


def expand(raw: bytes, kind) -> np.ndarray:
    return expand_all(raw, [kind])[0]


def tidily(function: Callable, *tables: pa.Table) -> pa.Table:
    """``function(*tables)``; afterwards the worker hands its free memory back, since idle workers of
    other stages share the executor with the next ones."""
    out = function(*tables)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
    return out


def in_blocks(texts: DataFrame, key: list[str], plan: Layout) -> DataFrame:
    """Texts dealt by a hash of the columns ``key``."""
    return texts.withColumn("block", F.pmod(F.xxhash64(*key), F.lit(plan.blocks)).cast("int"))


def questions(
    texts: DataFrame, plan: Layout, ask: Callable[..., tuple[np.ndarray, Arrays]], known: DataFrame | None = None
) -> DataFrame:
    """(part, block, keys, extra): each block's keys and the arrays that go with them, by part.

    With ``known``, earlier replies to the blocks (:func:`tagged`), ``ask`` gets their table as well.
    """

    def send(table: pa.Table, got: pa.Table | None = None) -> pa.Table:
        if not len(table):
            return pa.table({"part": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "extra": pa.array([], pa.binary())})
        keys, extra = ask(table) if got is None else ask(table, got)
        rows = list(zip(*plan.runs(keys), strict=True))
        block = table.column("block")[0].as_py()
        return pa.table(
            {
                "part": pa.array([p for p, _, _ in rows], pa.int32()),
                "block": pa.array([block] * len(rows), pa.int32()),
                "keys": pa.array([plan.pack(keys[a:b]) for _, a, b in rows], pa.binary()),
                "extra": pa.array([squeeze(*(e[a:b] for e in extra)) for _, a, b in rows], pa.binary()),
            }
        )

    schema = "part int, block int, keys binary, extra binary"
    if known is None:
        return texts.groupBy("block").applyInArrow(lambda table: tidily(send, table), schema)
    return texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(lambda a, b: tidily(send, a, b), schema)


def tagged(**tables: DataFrame) -> DataFrame:
    """Replies of several rounds in one table, with their names."""
    out = None
    for name, df in tables.items():
        df = df.select("block", "part", "reply", F.lit(name).alias("tag"))
        out = df if out is None else out.unionByName(df)
    return out


def reply_of(got: pa.Table, tag: str, kinds: list) -> Arrays:
    """The replies of one round among tagged ones."""
    return joined_reply(got.filter(pa.compute.equal(got.column("tag"), tag)), kinds)


def replies(
    asked: DataFrame, plan: Layout, answer: Callable[[np.ndarray, list[Arrays]], Arrays], kinds: list
) -> DataFrame:
    """(block, part, reply): ``answer`` gets the keys of a part over all blocks, one after the other, and
    the same of each extra array (of the given kinds), and returns arrays of that length."""

    def work(table: pa.Table) -> pa.Table:
        part = [plan.unpack(k.as_py()) for k in table.column("keys")]
        extra = [
            np.concatenate(arrays)
            for arrays in zip(*(expand_all(e.as_py(), kinds) for e in table.column("extra")), strict=True)
        ]
        found = answer(np.concatenate(part), extra)
        cuts = np.cumsum([len(k) for k in part])[:-1]
        pieces = [np.split(f, cuts) for f in found]
        return pa.table(
            {
                "block": table.column("block"),
                "part": table.column("part"),
                "reply": pa.array([squeeze(*(p[i] for p in pieces)) for i in range(len(part))], pa.binary()),
            }
        )

    return asked.groupBy("part").applyInArrow(
        lambda table: tidily(work, table), "block int, part int, reply binary"
    )


def joined_reply(table: pa.Table, kinds: list) -> Arrays:
    """Arrays of all replies to a block, in the order of its keys."""
    rows = sorted(zip(table.column("part").to_pylist(), table.column("reply").to_pylist(), strict=True))
    if not rows:
        return [np.zeros(0, kind) for kind in kinds]
    return [np.concatenate(a) for a in zip(*(expand_all(raw, kinds) for _, raw in rows), strict=True)]


def first_in_task(rows: DataFrame, key: str) -> DataFrame:
    """Without rows whose key an earlier row of the task has; a cheap step before a shuffle of wide rows.

    The set of seen keys is cleared when it is large, so some repeats pass.
    """
    at = rows.columns.index(key)

    def pick(batches):
        seen: set = set()
        for batch in batches:
            keep = []
            for k in batch.column(at).to_pylist():
                keep.append(k not in seen)
                seen.add(k)
            if len(seen) > 200_000:
                seen.clear()
            yield batch if all(keep) else batch.filter(pa.array(keep))

    return rows.mapInArrow(pick, rows.schema)


def bucket_units(rows: DataFrame, bucket: list[str], member: str, block: int) -> DataFrame:
    """Rows dealt so that every two members of a bucket meet in a unit of at most about two blocks.

    Adds low, high and second: a bucket of more than ``block`` rows is cut by a hash of the member, and a unit
    (bucket, low, high) holds two of its cuts, ``second`` marking the rows of the higher one. Smaller buckets are one
    unit with low = high = 0. Members of one cut meet where low = high.
    """
    sizes = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_size"))
    large = materialize(sizes.where(F.col("_size") > block), "large")
    cut = F.coalesce(F.ceil(F.col("_size") / block), F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64(member), F.col("_cut")).cast("int")
    return (
        rows.join(large, bucket, "left")
        .withColumn("_cut", cut)
        .withColumn("_mine", mine)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_cut") - 1)))
        .withColumn("low", F.least("_mine", "_other"))
        .withColumn("high", F.greatest("_mine", "_other"))
        .withColumn("second", F.col("_mine") > F.col("_other"))
        .drop("_size", "_cut", "_mine", "_other")
    )
