"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids; one longer than a sequence is cut into full pieces from its end, so only its first
piece may be shorter. Full pieces are sequences of their own. The other pieces are dealt by a hash into
shards of ``SHARD`` pieces, whose number grows with the input; each shard is packed by itself, which costs less than a sequence
per shard against packing all together.

A shard is evolved on ``ISLANDS`` islands, rows of a table that Spark spreads. An individual is a packing. Crossover
(Falkenauer) injects the best-filled sequences of one parent into the other, removes the sequences that now hold
a piece twice, and puts the displaced pieces back by best fit, longest first; mutation does the same with the worst-filled
sequences. Fitness is the mean squared fill. After each epoch the elite of every island migrates to the next
island of its shard. The best elite of all islands is the result.

Defined cases: null is the empty text, a piece of the end token alone; repeated rows are packed each; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import json
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from corpusmap.sources.scratch import materialize

LIMIT = 1024
END_ID = 2
SHARD = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 6
GENERATIONS = 40
# How byte-level vocabularies split text, and which bytes they write as themselves.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN_BYTES = (*range(33, 127), *range(161, 173), *range(174, 256))
_tokenizers: dict = {}


class Tokens:
    """Ids of whole texts by a tokenizer file.

    A faster coder with the vocabulary of the file gives the same ids; texts that may hold a special
    token go through the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        other = (b for b in range(256) if b not in _PLAIN_BYTES)
        byte_of = {chr(b): b for b in _PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(other)}
        ranks = {bytes(map(byte_of.get, t)): i for t, i in vocabulary.items() if set(t) <= byte_of.keys()}
        self.coder = Tokenizer.from_file(path)
        self.special = [t.content for t in self.coder.get_added_tokens_decoder().values()]
        for t in self.special:
            ranks.pop(t.encode(), None)
        self.fast = tiktoken.Encoding("vocabulary", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, followed by the end token."""
        end = END_ID.to_bytes(4, "little")
        out = []
        for text in texts:
            if any(t in text for t in self.special):
                found = np.array(self.coder.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                found = self.fast.encode_to_numpy(text, disallowed_special=())
            out.append(found.astype("<u4").tobytes() + end)
        return out


def tokenizer_path() -> str:
    """Vocabulary file of the public tokenizer that the queries count with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokens(path: str) -> Tokens:
    if path not in _tokenizers:
        _tokenizers[path] = Tokens(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                rows, out = [], ([], [], [], [])
                for i, raw in enumerate(coder.ids(texts)):
                    n = len(raw) // 4
                    bounds = [0, *range(n % limit or limit, n + 1, limit)]
                    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                        rows.append(i)
                        for col, v in zip(out, (k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(rows, pa.int64())),
                        pa.array(out[0], pa.int32()),
                        *(pa.array(c, pa.int64()) for c in out[1:]),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long"
    )


class Packing:
    """Pieces in sequences: ``where`` (sequence of each piece) and ``fill`` (tokens of each sequence)."""

    def __init__(self, where: np.ndarray, fill: np.ndarray):
        self.where, self.fill = where, fill

    def fitness(self, limit: int) -> float:
        full = self.fill[self.fill > 0] / limit
        return float((full**2).sum() / max(len(full), 1))

    def count(self) -> int:
        return int((self.fill > 0).sum())


def best_fit(sizes: np.ndarray, base: Packing, todo: np.ndarray, limit: int) -> Packing:
    """``base`` with the pieces ``todo`` put, in that order, where the least room is left."""
    where, fill = base.where.copy(), base.fill.tolist()
    room: list[list[int]] = [[] for _ in range(limit + 1)]
    some = 0
    for b, f in enumerate(fill):
        if 0 < f < limit:
            room[limit - f].append(b)
            some |= 1 << (limit - f)
    spare = [b for b, f in enumerate(fill) if f == 0]
    for i in todo.tolist():
        size = int(sizes[i])
        high = some >> size
        if high:
            left = size + (high & -high).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                some ^= 1 << left
        else:
            left = limit
            b = spare.pop() if spare else len(fill)
            if b == len(fill):
                fill.append(0)
        where[i] = b
        fill[b] += size
        left -= size
        if left:
            room[left].append(b)
            some |= 1 << left
    return Packing(where, np.array(fill, np.int64))


def _without(sizes: np.ndarray, one: Packing, gone: np.ndarray) -> tuple[Packing, np.ndarray]:
    """The packing without the marked sequences, and the pieces they held, longest first."""
    loose = np.flatnonzero(gone[one.where])
    fill = np.where(gone, 0, one.fill)
    return Packing(one.where.copy(), fill), loose[np.argsort(-sizes[loose], kind="stable")]


def crossover(sizes: np.ndarray, one: Packing, other: Packing, share: float, rng, limit: int) -> Packing:
    """``one`` with a part of the best-filled sequences of ``other`` in it."""
    order = np.argsort(-other.fill, kind="stable")
    order = order[other.fill[order] >= 0.97 * limit]
    if not len(order):
        return one
    take = order[rng.random(len(order)) < share]
    inject = np.zeros(len(other.fill), bool)
    inject[take] = True
    moved = inject[other.where]
    gone = np.zeros(len(one.fill), bool)
    gone[one.where[moved]] = True  # they would hold a piece twice
    base, loose = _without(sizes, one, gone)
    loose = loose[~moved[loose]]
    number = np.cumsum(inject) - 1 + len(base.fill)
    base.where[moved] = number[other.where[moved]]
    base.fill = np.concatenate([base.fill, other.fill[take[np.argsort(take)]]])
    return _compact(best_fit(sizes, base, loose, limit))


def mutate(sizes: np.ndarray, one: Packing, rng, limit: int) -> Packing:
    """The worst-filled sequences and a few others dissolved and packed anew."""
    used = np.flatnonzero(one.fill)
    gone = np.zeros(len(one.fill), bool)
    gone[used[np.argsort(one.fill[used])[: max(2, len(used) // 50)]]] = True
    gone[rng.choice(used, max(1, len(used) // 50))] = True
    base, loose = _without(sizes, one, gone)
    return _compact(best_fit(sizes, base, loose, limit))


def _compact(one: Packing) -> Packing:
    used = one.fill > 0
    return Packing((np.cumsum(used) - 1)[one.where], one.fill[used])


def evolve(sizes: np.ndarray, elites: list[np.ndarray], seed: int, limit: int = LIMIT) -> np.ndarray:
    """The best packing after ``GENERATIONS``: the sequence of each piece. Stops at the lower bound."""
    rng = np.random.default_rng(seed)
    empty = Packing(np.zeros(len(sizes), np.int64), np.zeros(0, np.int64))
    crowd = [Packing(e, np.bincount(e, sizes).astype(np.int64)) for e in elites]
    if not crowd:
        crowd.append(best_fit(sizes, empty, np.argsort(-sizes, kind="stable"), limit))
    bound = -(-int(sizes.sum()) // limit)
    while len(crowd) < POPULATION:
        noise = sizes * (1 + 0.1 * rng.standard_normal(len(sizes)))
        crowd.append(best_fit(sizes, empty, np.argsort(-noise, kind="stable"), limit))
    score = lambda p: (-p.count(), p.fitness(limit))
    crowd.sort(key=score, reverse=True)
    pick = random.Random(seed)
    for _ in range(GENERATIONS):
        if crowd[0].count() <= bound:
            break
        a, b = pick.sample(crowd, 2)
        child = crossover(sizes, a, b, pick.uniform(0.2, 0.8), rng, limit)
        child = mutate(sizes, child, rng, limit)
        if score(child) > score(crowd[-1]):
            crowd[-1] = child
            crowd.sort(key=score, reverse=True)
    return crowd[0].where


def _epoch(islands: DataFrame, epoch: int, limit: int) -> DataFrame:
    """(shard, island, sizes, elites) -> (shard, island, elite, used) after one epoch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, used = [], []
            for shard, island, sizes, elites in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = evolve(
                    np.array(sizes, np.int64),
                    [np.array(e, np.int64) for e in elites or []],
                    (shard * 31 + island) * 31 + epoch,
                    limit,
                )
                best.append(found)
                used.append(len(np.unique(found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(best, pa.list_(pa.int64())), pa.array(used, pa.int64())],
                ["shard", "island", "elite", "used"],
            )

    return islands.select("shard", "island", "sizes", "elites").mapInArrow(
        run, "shard long, island int, elite array<long>, used long"
    )


def pack(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Pieces of (doc_id, text) with their sequence_id and offset."""
    cut = materialize(
        pieces(docs, path, limit).withColumn(
            "shard_key", F.xxhash64("doc_id", "piece", "ids_crc32", "length")
        ),
        "pieces",
    )
    short = cut.where(F.col("length") < limit)
    shards = max(1, -(-short.count() // SHARD))
    item = F.struct("length", "doc_id", "piece", "start", "ids_crc32")
    # Rows that repeat a document share a key; a third of all rows may, so a second hash deals them.
    place = F.pmod(F.xxhash64("shard_key", F.monotonically_increasing_id()), F.lit(shards))
    grouped = materialize(
        short.withColumn("shard", place)
        .groupBy("shard")
        .agg(F.sort_array(F.collect_list(item), asc=False).alias("items")),
        "shards",
    )
    sizes = grouped.select("shard", F.col("items.length").alias("sizes"))
    elites = None
    for epoch in range(EPOCHS):
        rows = sizes if elites is None else sizes.join(elites, "shard")
        came = F.array().cast("array<array<bigint>>")
        if elites is not None:  # its own elite and that of the island before
            came = F.transform(
                F.array(F.col("island"), (F.col("island") + 1) % ISLANDS),
                lambda i: F.get(F.col("all"), i)["elite"],
            )
        islands = (
            rows.withColumn("island", F.explode(F.array(*map(F.lit, range(ISLANDS)))))
            .withColumn("elites", came)
            .repartition(shards * ISLANDS, "shard", "island")
        )
        evolved = materialize(_epoch(islands, epoch, limit), "elites")
        elites = evolved.groupBy("shard").agg(
            F.sort_array(F.collect_list(F.struct("island", "elite", "used"))).alias("all")
        )
    best = elites.select(
        "shard",
        F.array_min(F.transform("all", lambda e: F.struct(e["used"].alias("used"), e["island"].alias("island"), e["elite"].alias("elite"))))[
            "elite"
        ].alias("elite"),
    )
    placed = (
        grouped.join(best, "shard")
        .select("shard", F.explode(F.arrays_zip("items", "elite")).alias("e"))
        .select("shard", "e.items.*", F.col("e.elite").alias("bin"))
    )
    order = Window.partitionBy("shard", "bin").orderBy(F.desc("length"), "doc_id", "piece", "start", "ids_crc32")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    packed = placed.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long")).withColumn(
        "sequence_id", (F.col("shard") * (2 * SHARD) + F.col("bin")).cast("long")
    )
    # Full pieces: negative numbers, one each.
    full = cut.where(F.col("length") == limit).withColumn("offset", F.lit(0).cast("long")).withColumn(
        "sequence_id", -1 - F.monotonically_increasing_id()
    )
    return packed.select(columns).unionByName(full.select(columns))
