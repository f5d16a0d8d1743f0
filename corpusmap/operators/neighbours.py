"""Nearest neighbours through pivot cells, and the fuzzy neighbour graph.

Every row belongs to the cell of its nearest pivot. A query first meets its own cell, which
bounds its k-th distance; the exact method then visits every cell that the triangle inequality
and the bisecting plane cannot rule out (Lu et al., "Efficient processing of k nearest neighbor
joins using MapReduce", VLDB 2012). Cells are cut into blocks of bounded size on both sides, so
no task ever holds a whole cell. The exact method may have to compare all rows with all: blocks of rows meet where they
are read, so rows are exchanged a fixed number of times, however many cells a query visits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from corpusmap.functions.ordering import hash_key, hash_unit
from corpusmap.sources.scratch import materialize

# Distances are compared at this many decimals, so copies tie and the id decides.
DISTANCE_DECIMALS = 12
# Of the methods whose pivots the driver holds.
MAX_PIVOTS = 16_384
# Sources compared in one matrix product.
CHUNK_ROWS = 2048
# Rows compared with all pivots at once; bounds a task's matrices.
SLICE_ROWS = 256
# Rows of a block of the exact method.
BLOCK_ROWS = 4096


def _space(vectors: pd.Series | np.ndarray | pa.Array | pa.ChunkedArray, metric: str) -> np.ndarray:
    """Rows as points of a Euclidean space whose distances order like the metric.

    For cosine these are unit vectors, half their squared distance being the cosine distance.
    A zero vector gets a direction of its own, at distance 1 from all others.
    """
    if isinstance(vectors, pa.Array | pa.ChunkedArray):
        m = pc.list_flatten(vectors).to_numpy().astype(np.float64).reshape(len(vectors), -1)
    elif isinstance(vectors, np.ndarray) and vectors.ndim == 2:
        m = vectors.astype(np.float64)
    else:
        m = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
    if metric == "euclidean":
        return m
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    zero = norm < 1e-12
    return np.hstack([m / np.where(zero, 1.0, norm), zero.astype(np.float64)])


def _pairwise(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        d = a @ b.T
        np.subtract(1.0, d, out=d)
        return np.maximum(d, 0.0, out=d)
    if a.shape[1] <= 4:
        # Few dimensions: differences keep full precision for near points.
        gaps = [(a[:, i, None] - b[None, :, i]) ** 2 for i in range(a.shape[1])]
        return np.sqrt(sum(gaps))
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squared, 0.0))


def _euclid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _pairwise(a, b, "euclidean")


def _to_cells(df: DataFrame, pivots: np.ndarray, metric: str) -> DataFrame:
    """Add the cell of the nearest pivot and the distance to it."""
    id_type = df.schema["id"].dataType.simpleString()
    vec_type = df.schema["vec"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            for at in range(0, len(frame), SLICE_ROWS):
                part = frame.iloc[at : at + SLICE_ROWS]
                d = _euclid(_space(part["vec"], metric), pivots)
                cell = d.argmin(axis=1)
                yield part.assign(cell=cell, to_pivot=d[np.arange(len(d)), cell])

    return df.mapInPandas(run, f"id {id_type}, vec {vec_type}, cell int, to_pivot double")


def _may_hold(
    d: np.ndarray, home: np.ndarray, own: np.ndarray, cells: np.ndarray, pivots: np.ndarray, radius: np.ndarray, bound: np.ndarray, metric: str
) -> np.ndarray:
    """Which of ``cells``, at distances ``d``, may hold a row within ``bound`` of each query; not the ``own`` one, at ``home``."""
    reach = np.sqrt(2.0 * bound) if metric == "cosine" else bound
    homes, at = np.unique(own, return_inverse=True)
    gaps = _euclid(pivots[homes], pivots[cells])
    ball = d - radius[cells][None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (d**2 - (home**2)[:, None]) / (2.0 * gaps[at])
    # Coinciding pivots have no bisecting plane.
    plane[~np.isfinite(plane)] = -np.inf
    visit = np.maximum(ball, plane) <= (reach * (1 + 1e-9) + 1e-7)[:, None]
    visit[own[:, None] == cells[None, :]] = False
    return visit & np.isfinite(radius[cells])[None, :]


def _unpruned_cells(
    df: DataFrame, pivots: np.ndarray, radius: np.ndarray, metric: str, probes: int | None
) -> DataFrame:
    """Cells other than the own one that may hold a row within ``bound`` of the query.

    ``probes`` limits them to the cells of the nearest pivots.
    """
    id_type = df.schema["id"].dataType.simpleString()
    vec_type = df.schema["vec"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slices = (f.iloc[a : a + SLICE_ROWS] for f in frames for a in range(0, len(f), SLICE_ROWS))
        for frame in slices:
            d = _euclid(_space(frame["vec"], metric), pivots)
            own = frame["cell"].to_numpy()
            cells = np.arange(len(pivots))
            visit = _may_hold(d, d[np.arange(len(d)), own], own, cells, pivots, radius, frame["bound"].to_numpy(), metric)
            if probes is not None and probes < len(pivots):
                last = np.partition(d, probes - 1, axis=1)[:, probes - 1]
                visit &= d <= last[:, None]
            some = visit.any(axis=1)
            if not some.any():
                continue
            out = frame.loc[some, ["id", "vec", "bound"]]
            yield out.assign(targets=[np.flatnonzero(v).astype(np.int32) for v in visit[some]])

    return df.mapInPandas(
        run, f"id {id_type}, vec {vec_type}, bound double, targets array<int>"
    )


def _block_join(
    queries: DataFrame,
    sources: DataFrame,
    k: int,
    metric: str,
    query_rows: int,
    source_rows: int,
) -> DataFrame:
    """The k nearest sources of each query within each block of each target cell.

    Both sides of a cell are cut by a hash of the id into blocks of about ``query_rows`` and
    ``source_rows``; each pair of blocks is one bounded group.
    """
    id_type = queries.schema["id"].dataType.simpleString()

    def sized(df: DataFrame, rows: int, name: str) -> DataFrame:
        # A row per pivot: the planner broadcasts it where that is cheap.
        return df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))

    asked = queries.select("id", "vec", "bound", F.explode("targets").alias("cell"))
    asked_cells = queries.select(F.explode("targets").alias("cell"))
    blocks = sized(sources, source_rows, "s_blocks").join(
        sized(asked_cells, query_rows, "q_blocks"), "cell"
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = (
        asked.join(blocks, "cell")
        .withColumn("q", mine("q_blocks"))
        .withColumn("s", every("s_blocks"))
        .select("cell", "q", "s", "id", "vec", "bound")
    )
    right = (
        sources.join(blocks, "cell")
        .withColumn("s", mine("s_blocks"))
        .withColumn("q", every("q_blocks"))
        .select(*[F.col(c).alias(c) for c in ("cell", "q", "s", "id", "vec")])
    )

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return _found(a.column("id"), b.column("id"), *(np.zeros(0, np.int64) for _ in range(2)), np.zeros(0))
        b = b.sort_by("id")
        src, dst = a.column("id").to_numpy(), b.column("id").to_numpy()
        asked, offered = _space(a.column("vec"), metric), _space(b.column("vec"), metric)
        limit, slack = np.array(a.column("bound").to_numpy()), 10.0**-DISTANCE_DECIMALS
        parts = []
        # Slices that stay in a processor's cache.
        for lo, at in product(range(0, len(src), SLICE_ROWS), range(0, len(dst), CHUNK_ROWS)):
            mine, theirs, bound = src[lo : lo + SLICE_ROWS], dst[at : at + CHUNK_ROWS], limit[lo : lo + SLICE_ROWS]
            d = _pairwise(asked[lo : lo + SLICE_ROWS], offered[at : at + CHUNK_ROWS], metric)
            near = d <= bound[:, None] + slack
            many = np.flatnonzero(np.count_nonzero(near, axis=1) > k)
            if len(many):
                some = d[many]
                others = np.where(mine[many][:, None] == theirs[None, :], np.inf, some)
                kth = np.round(np.partition(others, k - 1, axis=1)[:, k - 1], DISTANCE_DECIMALS)
                bound[many] = np.minimum(bound[many], kth)
                near[many] = some <= bound[many][:, None] + slack
            r, c = np.nonzero(near)
            gap = np.round(d[r, c], DISTANCE_DECIMALS)
            keep = (gap <= bound[r]) & (mine[r] != theirs[c]) & np.isfinite(gap)
            parts.append((r[keep] + lo, c[keep] + at, gap[keep]))
        rows, cols, found = (np.concatenate(column) for column in zip(*parts))
        # Columns are in id order, so they break ties.
        order = np.lexsort((cols, found, rows))
        rows, cols, found = rows[order], cols[order], found[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        return _found(a.column("id"), b.column("id"), rows[best], cols[best], found[best])

    keys = ["cell", "q", "s"]
    return (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInArrow(nearest, f"src {id_type}, dst {id_type}, distance double")
    )


def _found(src: pa.ChunkedArray, dst: pa.ChunkedArray, rows: np.ndarray, cols: np.ndarray, distance: np.ndarray) -> pa.Table:
    return pa.table([src.take(pa.array(rows)), dst.take(pa.array(cols)), pa.array(distance)], ["src", "dst", "distance"])


def _blocks(df: DataFrame, name: str) -> DataFrame:
    """Rows (id, vec, cell, to_pivot, bound) in blocks of ``BLOCK_ROWS`` of near cells, one row of arrays each."""
    id_type = df.schema["id"].dataType.simpleString()
    wide = df.schema["vec"].dataType.simpleString() == "array<double>"

    def one(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        listed = []
        for column in ("id", "cell", "to_pivot", "bound"):
            values = pa.concat_arrays(rows.column(column).chunks)
            listed.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
        flat = np.concatenate([np.asarray(v.as_py()) for v in rows.column("vec")]).astype(np.float64 if wide else np.float32)
        return pa.RecordBatch.from_arrays([*listed, pa.array([flat.tobytes()], pa.binary())], ["ids", "cells", "gaps", "bounds", "vecs"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            while len(held) >= BLOCK_ROWS:
                yield one(held.slice(0, BLOCK_ROWS))
                held = held.slice(BLOCK_ROWS)
        if held is not None and len(held):
            yield one(held)

    rows = df.select("id", "vec", "cell", "to_pivot", "bound")
    dealt = rows.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell")
    packed = dealt.mapInArrow(
        pack, f"ids array<{id_type}>, cells array<int>, gaps array<double>, bounds array<double>, vecs binary"
    )
    return materialize(packed.withColumn("block", F.monotonically_increasing_id()), name)


def _ranked(ids: np.ndarray) -> np.ndarray:
    return np.unique(ids, return_inverse=True)[1]


class _Query:
    """A block of queries and the nearest rows of other cells met so far."""

    def __init__(self, ids: np.ndarray, cells, gaps, bounds, vecs, wide: bool, metric: str):
        self.ids, self.cells, self.gaps = ids, np.array(cells), np.array(gaps)
        self.limit = np.array(bounds, np.float64)
        self.places = _unpacked_space(vecs, len(ids), wide, metric)
        self.rows, self.found, self.distance = np.zeros(0, np.int64), ids[:0], np.zeros(0)

    def meet(self, ids: np.ndarray, cells: np.ndarray, places: np.ndarray, pivots, radius, k: int, metric: str) -> None:
        near, number = np.unique(cells, return_inverse=True)
        visit = _may_hold(
            _euclid(self.places, pivots[near]), self.gaps, self.cells, near, pivots, radius, self.limit, metric
        )
        columns = np.flatnonzero(visit.any(axis=0)[number])
        asking = np.flatnonzero(visit.any(axis=1))
        for at in range(0, len(asking), CHUNK_ROWS // 2) if len(columns) else ():
            mine = asking[at : at + CHUNK_ROWS // 2]
            d = _pairwise(self.places[mine], places[columns], metric)
            d[self.cells[mine][:, None] == cells[columns][None, :]] = np.inf
            slack = 10.0**-DISTANCE_DECIMALS
            many = np.flatnonzero((d <= self.limit[mine][:, None] + slack).sum(axis=1) > k)
            if len(many):
                other = np.where(self.ids[mine[many]][:, None] == ids[columns][None, :], np.inf, d[many])
                kth = np.round(np.partition(other, k - 1, axis=1)[:, k - 1], DISTANCE_DECIMALS)
                self.limit[mine[many]] = np.minimum(self.limit[mine[many]], kth)
            r, c = np.nonzero((d <= self.limit[mine][:, None] + slack) & np.isfinite(d))
            distance, row, found = np.round(d[r, c], DISTANCE_DECIMALS), mine[r], ids[columns[c]]
            keep = (distance <= self.limit[row]) & (found != self.ids[row])
            self._add(row[keep], found[keep], distance[keep], k)

    def _add(self, rows: np.ndarray, found: np.ndarray, distance: np.ndarray, k: int) -> None:
        if not len(rows):
            return
        rows = np.concatenate([self.rows, rows])
        found, distance = np.concatenate([self.found, found]), np.concatenate([self.distance, distance])
        order = np.lexsort((_ranked(found), distance, rows))
        rows, found, distance = rows[order], found[order], distance[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        full = place == k - 1
        self.limit[rows[full]] = np.minimum(self.limit[rows[full]], distance[full])
        self.rows, self.found, self.distance = (a[place < k] for a in (rows, found, distance))


def _unpacked_space(vecs: bytes, n: int, wide: bool, metric: str) -> np.ndarray:
    rows = np.frombuffer(vecs, np.float64 if wide else np.float32).reshape(n, -1)
    return _space(rows, metric)


def _block_pairs(queries: DataFrame, sources: DataFrame, pivots: np.ndarray, radius: np.ndarray, k: int, metric: str) -> DataFrame:
    """(src, dst, distance): of each query at least its k nearest rows of other cells, within its bound.

    Every block of queries meets every block of sources: a plain product of two tables, without an exchange. Cells of a block that
    no query of the other can need are skipped; the nearest rows are merged before they leave a task.
    """
    id_type = sources.schema["id"].dataType.simpleString()
    wide = sources.schema["vec"].dataType.simpleString() == "array<double>"
    asked = _blocks(queries, "knn-asked").select(*[F.col(c).alias(f"q_{c}") for c in ("block", "ids", "cells", "gaps", "bounds", "vecs")])
    offered = _blocks(sources.withColumn("bound", F.lit(0.0)), "knn-offered").select("ids", "cells", "vecs")

    def out(query: _Query) -> pa.RecordBatch:
        columns = [query.ids[query.rows], query.found, query.distance]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["src", "dst", "distance"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, query = None, None
        for batch in batches:
            for i in range(len(batch)):
                get = lambda name: batch.column(name)[i]  # noqa: B023, E731
                if query is None or get("q_block").as_py() != block:
                    if query is not None:
                        yield out(query)
                    block = get("q_block").as_py()
                    query = _Query(
                        np.array(get("q_ids").as_py()), *(get(f"q_{c}").as_py() for c in ("cells", "gaps", "bounds", "vecs")), wide, metric
                    )
                ids = np.array(get("ids").as_py())
                places = _unpacked_space(get("vecs").as_py(), len(ids), wide, metric)
                query.meet(ids, np.array(get("cells").as_py()), places, pivots, radius, k, metric)
        if query is not None:
            yield out(query)

    return asked.crossJoin(offered).mapInArrow(meet, f"src {id_type}, dst {id_type}, distance double")


def _k_best(candidates: DataFrame, k: int) -> DataFrame:
    window = W.partitionBy("src").orderBy("distance", "dst")
    return candidates.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


# Groups of pivots that a query visits after its own, and the cells it visits in each.
NEXT_GROUPS, NEXT_PROBES = 3, 4
# Rounds in which rows meet the neighbours of their neighbours, neighbours that take part, and rows that meet at one.
ROUNDS = 2
LISTED, ASKERS = 32, 512
# Rows of a cell whose meetings share a task's group, and pairs that it holds before it drops those found before.
MIDS, PAIRS = 1024, 1 << 22


def _drawn(sources: DataFrame, wanted: int, n: int, seed: int) -> Column:
    """Whether a row is among about ``wanted`` of ``n`` by its hash; a smaller draw is part of a larger one."""
    first = sources.select(F.min(hash_key(F.col("id"), seed)).alias("first")).first()["first"]
    key = hash_key(F.col("id"), seed)
    return (hash_unit(key) < wanted / max(n, 1)) | (key == F.lit(first))


def _nearest_tops(df: DataFrame, tops: np.ndarray, metric: str, count: int) -> DataFrame:
    """Add ``tops``: numbers of the nearest pivots of pivots, nearest first."""

    names = [*df.columns, "tops"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (b.slice(a, CHUNK_ROWS) for b in batches for a in range(0, b.num_rows, CHUNK_ROWS))
        for batch in slices:
            d = _euclid(_space(batch.column("vec"), metric), tops)
            nearest = np.argsort(d, axis=1, kind="stable")[:, :count].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(nearest.ravel(), np.full(len(d), nearest.shape[1]))], names)

    return df.mapInArrow(run, StructType([*df.schema, StructField("tops", ArrayType(IntegerType()))]))


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))


def _pivot_cells(routed: DataFrame, pivots: DataFrame, metric: str, probes: int, rows_at_once: int) -> DataFrame:
    """(id, vec, source, step, cells): for every visited group the nearest of its pivots, nearest first.

    A group's rows are cut into blocks by a hash of the id, and its pivots sent to each block.
    """
    id_type = routed.schema["id"].dataType.simpleString()
    vec_type = routed.schema["vec"].dataType.simpleString()
    asked = routed.select("id", "vec", "source", F.posexplode("tops").alias("step", "top"))
    # A row per group of pivots.
    sizes = materialize(asked.groupBy("top").agg(F.ceil(F.count(F.lit(1)) / rows_at_once).cast("int").alias("blocks")), "blocks")
    left = asked.join(sizes, "top").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    right = pivots.join(sizes, "top").select("top", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "cell", F.col("vec").alias("at"))
    right = right.select(*[F.col(c).alias(c) for c in ("top", "block", "cell", "at")])

    kept = ["id", "vec", "source", "step"]

    def choose(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return a.select(kept).slice(0, 0).append_column("cells", pa.array([], pa.list_(pa.int64())))
        b = b.sort_by("cell")
        cell, places = b.column("cell").to_numpy(), _space(b.column("at"), metric)
        out = []
        for at in range(0, len(a), CHUNK_ROWS):
            part = a.select(kept).slice(at, CHUNK_ROWS)
            d = _euclid(_space(part.column("vec"), metric), places)
            order = np.argsort(d, axis=1, kind="stable")
            wanted = np.minimum(np.where(part.column("step").to_numpy() == 0, probes, NEXT_PROBES), len(cell))
            chosen = order[np.arange(len(cell))[None, :] < wanted[:, None]]
            out.append(part.append_column("cells", _lists(cell[chosen], wanted)))
        return pa.concat_tables(out)

    keys = ["top", "block"]
    return (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInArrow(choose, f"id {id_type}, vec {vec_type}, source boolean, step int, cells array<long>")
    )


def _reach(found: DataFrame, k: int) -> DataFrame:
    """(id, reach): the k-th distance of a row, null if it has fewer neighbours."""
    return found.groupBy(F.col("src").alias("id")).agg(F.when(F.count(F.lit(1)) == k, F.max("distance")).alias("reach"))


def _tree_graph(
    rows: DataFrame, k: int, metric: str, probes: int, cell_rows: int, query_rows: int, source_rows: int, seed: int
) -> DataFrame:
    sources = rows.where("source").select("id", "vec")
    n = sources.count()
    if not n:
        return sources.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
    wanted = max(1, -(-n // cell_rows))
    pivots = materialize(
        sources.where(_drawn(sources, wanted, n, seed)).withColumn("cell", F.monotonically_increasing_id()), "pivots"
    )
    tops = pivots.where(_drawn(sources, int(np.ceil(np.sqrt(wanted))), n, seed)).orderBy("id")
    matrix = _space(tops.select("vec").toPandas()["vec"], metric)  # about the root of the number of pivots
    grouped = _nearest_tops(pivots, matrix, metric, 1).select("cell", "vec", F.get("tops", F.lit(0)).alias("top"))
    routed = materialize(_nearest_tops(rows, matrix, metric, 1 + NEXT_GROUPS), "routed")
    visits = materialize(_pivot_cells(routed, grouped, metric, probes, 4 * query_rows), "visits")
    home = visits.where("step = 0")
    placed = home.where("source").select("id", "vec", F.get("cells", F.lit(0)).alias("cell"))
    at_home = home.select("id", "vec", F.lit(float("inf")).alias("bound"), F.slice("cells", 1, 1).alias("targets"))
    first = materialize(_k_best(_block_join(at_home, placed, k, metric, query_rows, source_rows), k), "knn-first")
    others = F.when(F.col("step") == 0, F.slice("cells", 2, probes)).otherwise(F.col("cells"))
    beyond = (
        visits.join(_reach(first, k), "id", "left")
        .select("id", "vec", F.coalesce("reach", F.lit(float("inf"))).alias("bound"), others.alias("targets"))
        .where(F.size("targets") > 0)
    )
    second = _block_join(materialize(beyond, "beyond"), placed, k, metric, query_rows, source_rows)
    found = materialize(_k_best(first.drop("rank").unionByName(second), k), "knn-second")
    if wanted == 1:
        return found
    seats = home.groupBy(F.col("id").alias("mid")).agg(F.min(F.get("cells", F.lit(0))).alias("cell"))
    parts = F.ceil(F.count(F.lit(1)).over(W.partitionBy("cell")) / MIDS).cast("int")
    seats = materialize(
        seats.withColumn("part", F.pmod(F.xxhash64("mid"), parts).cast("int")).withColumn("cuts", F.lit(1)), "seats"
    )
    found = found.withColumn("fresh", F.lit(True))
    for _ in range(ROUNDS):
        met, seats = _neighbours_of_neighbours(found, rows, seats, k, metric)
        listed = found.select("src", "dst", "distance", F.lit(False).alias("fresh"))
        best = listed.unionByName(met.withColumn("fresh", F.lit(True))).repartition("src")
        best = best.groupBy("src", "dst").agg(F.min("distance").alias("distance"), F.bool_and("fresh").alias("fresh"))
        found = materialize(_k_best(best, k), "knn-met")
    return found


def _neighbours_of_neighbours(found: DataFrame, rows: DataFrame, seats: DataFrame, k: int, metric: str) -> tuple[DataFrame, DataFrame]:
    """(src, dst, distance) of rows that list a common row, or that one row lists, within the k-th distance of ``src``;
    and the seats (mid, cell, part, cuts) for the next round.

    Lists hold the ``LISTED`` nearest. The row between is the key; those of a cell, whose lists have much in common, meet in one
    group, to which a row is sent once. Those that list a row are cut by a hash into parts of about ``ASKERS``, and what the row
    itself lists is sent to every part, so a hub makes no large group. Pairs of which neither is ``fresh`` on the list met before.
    """
    id_type = rows.schema["id"].dataType.simpleString()
    lists = found.where(F.col("rank") <= LISTED).select("src", "dst", "fresh")
    counted = lists.groupBy(F.col("dst").alias("mid")).agg(F.ceil(F.count(F.lit(1)) / ASKERS).cast("int").alias("now"))
    seats = materialize(
        seats.join(counted, "mid", "left").select("mid", "cell", "part", F.greatest("cuts", "now").alias("cuts")), "seats"
    )
    group = ["cell", "part", "cut"]
    # Those of a hub may meet in another part than before.
    fresh = (F.col("fresh") | (F.col("cuts") > 1)).alias("fresh")
    own = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int").alias("cut")
    every = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut")
    backward = lists.select(F.col("dst").alias("mid"), F.col("src").alias("id"), "fresh").join(seats, "mid")
    forward = lists.select(F.col("src").alias("mid"), F.col("dst").alias("id"), "fresh").join(seats, "mid")
    links = materialize(
        backward.select("cell", "part", own, "mid", "id", fresh).unionByName(
            forward.select("cell", "part", every, "mid", "id", fresh)
        ),
        "links",
    )
    listed = found.groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("listed"))
    people = (
        links.select(*group, "id").distinct()
        .join(rows.select("id", "vec", "source").join(listed, "id", "left").join(_reach(found, k), "id", "left"), "id")
        .select(*[F.col(c).alias(c) for c in (*group, "id", "vec", "source", "listed")], F.coalesce("reach", F.lit(float("inf"))).alias("bound"))
    )

    met = links.groupBy(*group).cogroup(people.groupBy(*group)).applyInArrow(
        lambda links, people: _meet(links, people, metric), f"src {id_type}, dst {id_type}, distance double"
    )
    return met, seats


def _meet(links: pa.Table, people: pa.Table, metric: str) -> pa.Table:
    """New pairs (src, dst, distance) of rows (id, vec, source, listed, bound) that share a ``mid`` of the links (mid, id, fresh)."""
    people = people.sort_by("id")
    ids, n = people.column("id").to_numpy(), len(people)
    named, first, many = np.unique(ids, return_index=True, return_counts=True)
    once = len(named) == n
    source, bound = (people.column(c).to_numpy() for c in ("source", "bound"))
    places = _space(people.column("vec"), metric) if n else np.zeros((0, 1))
    mid, fresh = np.unique(links.column("mid").to_numpy(), return_inverse=True)[1], links.column("fresh").to_numpy()
    at = np.searchsorted(named, links.column("id").to_numpy())
    member = first[at]
    if not once:  # an id that several rows have stands for all of them
        copies = many[at]
        ahead = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        mid, fresh, member = np.repeat(mid, copies), np.repeat(fresh, copies), np.repeat(member, copies) + ahead
    key = mid * n + member
    order = np.lexsort((fresh, key))
    order = order[np.diff(key[order], prepend=-1) > 0]  # not fresh if one of its lists is not
    mid, fresh, member = mid[order], fresh[order], member[order]
    ends = np.flatnonzero(np.diff(mid, append=-1)) + 1
    known = _listed_pairs(people.column("listed"), named) if once else np.zeros(0, np.int64)
    done, keys, gaps, held = [], [], [], 0
    limit = bound + 10.0**-DISTANCE_DECIMALS

    def settle() -> None:
        pair, place = np.unique(np.concatenate(keys), return_index=True)
        gap = np.round(np.concatenate(gaps)[place], DISTANCE_DECIMALS)
        keep = gap <= bound[pair // n]
        if len(known):
            keep &= known[np.minimum(np.searchsorted(known, pair), len(known) - 1)] != pair
        done.append((pair[keep], gap[keep]))

    begin = 0
    for end in ends.tolist():
        i, new = member[begin:end], fresh[begin:end]
        begin = end
        j = i[new]
        if not len(j) or len(i) < 2:
            continue
        d = _pairwise(places[j], places[i], metric)
        r, c = np.nonzero((d <= limit[j][:, None]) & source[i][None, :])
        keys.append(j[r] * n + i[c])
        gaps.append(d[r, c])
        if len(j) < len(i):
            r, c = np.nonzero((d <= limit[i][None, :]) & source[j][:, None] & ~new[None, :])
            keys.append(i[c] * n + j[r])
            gaps.append(d[r, c])
        held += len(gaps[-1]) + len(gaps[-2]) if len(gaps) > 1 else len(gaps[-1])
        if held > PAIRS:
            settle()
            keys, gaps, held = [], [], 0
    if keys:
        settle()
    pair, gap = (np.concatenate(v) if done else np.zeros(0, t) for v, t in zip(list(zip(*done)) or [(), ()], (np.int64, float)))
    pair, place = np.unique(pair, return_index=True)
    apart = pair // max(1, n) != pair % max(1, n)
    pair, gap = pair[apart], gap[place][apart]
    return _found(people.column("id"), people.column("id"), pair // max(1, n), pair % max(1, n), gap)


def _listed_pairs(lists: pa.ChunkedArray, named: np.ndarray) -> np.ndarray:
    """Of rows with the sorted ids ``named``, the pairs (row times their number plus row) of which one lists the other."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    row, listed = np.repeat(np.arange(len(named)), lengths), pc.list_flatten(lists).to_numpy()
    if not len(listed):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(named, listed), len(named) - 1)
    here = named[at] == listed
    return np.sort(row[here] * len(named) + at[here])


def knn_graph(
    df: DataFrame,
    k: int = 30,
    metric: str = "cosine",
    method: str = "tree",
    vec: str = "embedding",
    probes: int = 8,
    cell_rows: int = 1024,
    query_rows: int = 2048,
    source_rows: int = 32_768,
    seed: int = 42,
) -> DataFrame:
    """The k nearest other rows of each row: src, dst, rank, distance; ties go to the lower id.

    A query meets its own cell first; the k-th distance found there bounds what later cells may send.

    * ``tree``, the default: pivots are found through pivots of their own, so the driver holds about the square root of their
      number; a query visits ``probes`` cells of its nearest group and some of the next groups, and then meets the neighbours of its
      neighbours. A few neighbours are missed; README states the recall. There is no limit to the number of rows.
    * ``exact`` visits every cell within that bound and gives the true neighbours; ``ivf`` visits only those among the
      ``probes`` nearest. Both hold one pivot for every ``cell_rows`` rows on the driver and refuse more than ``MAX_PIVOTS``.

    Of equal vectors only the k+1 lowest ids can be anyone's neighbour, so a large group of copies costs each of its
    members no more than k+1 candidates.
    """
    rows = df.select("id", F.col(vec).alias("vec"))
    copies = W.partitionBy("vec").orderBy("id")
    if method == "tree":
        wide = max(k, LISTED)
        marked = materialize(rows.withColumn("source", F.row_number().over(copies) <= wide + 1), "knn-rows")
        found = _tree_graph(marked, wide, metric, probes, cell_rows, query_rows, source_rows, seed)
        return found.where(F.col("rank") <= k)
    sources = materialize(
        rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy"),
        "knn-sources",
    )
    n_sources, n_rows = sources.count(), rows.count()
    n_pivots = max(1, -(-n_sources // cell_rows))
    if n_pivots > MAX_PIVOTS:
        raise ValueError(f"{n_pivots} pivots: take method 'tree', or cells of more than {cell_rows} rows")
    sampled = sources.orderBy(hash_key(F.col("id"), seed), "id").limit(n_pivots).select("vec")
    pivots = _space(sampled.toPandas()["vec"], metric) if n_sources else np.zeros((1, 1))

    placed = materialize(_to_cells(sources, pivots, metric), "knn-cells")
    asking = placed
    if n_rows != n_sources:
        asking = materialize(_to_cells(rows, pivots, metric), "knn-queries")
    at_home = asking.select(
        "id", "vec", F.lit(float("inf")).alias("bound"), F.array("cell").alias("targets")
    )
    first = _k_best(_block_join(at_home, placed, k, metric, query_rows, source_rows), k)
    if n_pivots == 1:
        return first

    first = materialize(first, "knn-first")
    # Cells without rows keep radius -inf and are never visited.
    radius = np.full(len(pivots), -np.inf)
    for row in placed.groupBy("cell").agg(F.max("to_pivot").alias("r")).collect():
        radius[row["cell"]] = row["r"]
    reach = first.groupBy(F.col("src").alias("id")).agg(
        F.when(F.count(F.lit(1)) == k, F.max("distance")).alias("reach")
    )
    bounded = asking.join(reach, "id", "left").select(
        "id", "vec", "cell", "to_pivot", F.coalesce("reach", F.lit(float("inf"))).alias("bound")
    )
    if method == "ivf":
        beyond = materialize(_unpruned_cells(bounded, pivots, radius, metric, probes), "knn-beyond")
        second = _block_join(beyond, placed, k, metric, query_rows, source_rows)
    else:
        second = _block_pairs(bounded, placed, pivots, radius, k, metric)
    return _k_best(first.drop("rank").unionByName(second), k)


def fuzzy_graph(knn: DataFrame, n_neighbors: int | None = None) -> DataFrame:
    """Symmetric fuzzy edges src, dst, weight from neighbour distances.

    Per row, rho is the nearest positive distance and sigma makes the weights sum to
    log2(``n_neighbors``) (McInnes et al. 2018, section 3.1). A row's neighbours are k values,
    so they fit one row; edges of both directions are joined by ``a + b - ab``.
    """
    id_type = knn.schema["src"].dataType.simpleString()
    lists = knn.groupBy("src").agg(
        F.sort_array(F.collect_list(F.struct("distance", "dst"))).alias("near")
    )
    lists = lists.select(
        "src",
        F.transform("near", lambda e: e["distance"]).alias("distances"),
        F.transform("near", lambda e: e["dst"]).alias("ids"),
    )

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            sizes = frame["distances"].map(len).to_numpy()
            d = np.full((len(frame), sizes.max()), np.inf)
            for i, row in enumerate(frame["distances"]):
                d[i, : len(row)] = row
            real = np.isfinite(d)
            positive = np.where(real & (d > 0), d, np.inf).min(axis=1)
            rho = np.where(np.isfinite(positive), positive, 0.0)
            target = np.log2(n_neighbors if n_neighbors else sizes + 1)
            over = np.where(real, np.maximum(d - rho[:, None], 0.0), np.inf)
            low, high, sigma = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
            for _ in range(64):
                total = np.exp(-over / sigma[:, None]).sum(axis=1)
                above = total > target
                high = np.where(above, sigma, high)
                low = np.where(above, low, sigma)
                sigma = np.where(np.isinf(high), sigma * 2.0, (low + high) / 2.0)
            mean = np.where(real, d, 0.0).sum(axis=1) / np.maximum(sizes, 1)
            sigma = np.maximum(sigma, 1e-3 * np.maximum(mean, 1e-12))
            w = np.exp(-over / sigma[:, None])
            rows, cols = np.nonzero(real)
            ids = frame["ids"].to_numpy()
            yield pd.DataFrame(
                {
                    "src": frame["src"].to_numpy()[rows],
                    "dst": [ids[r][c] for r, c in zip(rows, cols)],
                    "weight": w[rows, cols],
                }
            )

    directed = lists.mapInPandas(weigh, f"src {id_type}, dst {id_type}, weight double")
    both = F.inline(
        F.array(
            F.struct(F.col("src").alias("src"), F.col("dst").alias("dst"), "weight"),
            F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"),
        )
    )
    product = F.when(F.count("weight") == 2, F.min("weight") * F.max("weight")).otherwise(0.0)
    return (
        directed.select(both)
        .groupBy("src", "dst")
        .agg((F.sum("weight") - product).alias("weight"))
    )
