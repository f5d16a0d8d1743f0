"""Two-dimensional layout of a fuzzy neighbour graph.

Every epoch moves all nodes at once: edges pull (McInnes et al. 2018, appendix C), seeded random
nodes push. Nodes are dealt into blocks by number. The edges of a block are packed once and stay with it; an epoch is one
exchange, in which blocks send each other the places that were asked for, one row for each two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from corpusmap.operators.indexing import dense_index
from corpusmap.sources.scratch import discard, materialize

# Largest step of one force along one axis.
MAX_FORCE = 4.0
START_SPAN = 10.0
# Blocks of a small layout; nodes that a block takes at most; epochs that run before their result is written.
BLOCKS = 64
BLOCK_NODES = 1 << 15
ROUNDS = 10
# Edges whose forces are computed together.
SLICE = 1 << 17

_HELD = "block int, peer int, node binary, slot binary, weight binary, pulls binary, other binary"
# Between blocks: the places that the edges of ``block`` need of ``peer``, those that its draws need, and the nodes
# whose places ``peer`` needs next. Peer -1 is the block's own state, in ``near``.
_SENT = "block int, peer int, near binary, far binary, ask binary"


def curve_parameters(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a, b for which 1/(1 + a d^2b) best follows 1 up to ``min_dist``, then exp decay."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    wanted = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    a, b, damping = 1.0, 1.0, 1e-2

    def miss(a: float, b: float) -> np.ndarray:
        return 1.0 / (1.0 + a * d ** (2 * b)) - wanted

    for _ in range(200):
        power = d ** (2 * b)
        slope = -1.0 / (1.0 + a * power) ** 2
        jac = np.stack([slope * power, slope * a * power * 2 * np.log(d)], axis=1)
        old = miss(a, b)
        step = np.linalg.solve(jac.T @ jac + damping * np.eye(2), -jac.T @ old)
        if (miss(a + step[0], b + step[1]) ** 2).sum() < (old**2).sum():
            a, b, damping = a + step[0], b + step[1], damping / 3
        else:
            damping *= 4
    return float(a), float(b)


def pca_start(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """First two principal components (id, x, y), scaled to a span of 10."""
    rows = df.select("id", array_to_vector(F.transform(vec, lambda v: v.cast("double"))).alias("v"))
    fitted = PCA(k=2, inputCol="v", outputCol="p").fit(rows)
    places = fitted.transform(rows).select("id", vector_to_array("p").alias("p"))
    flat = places.select("id", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))
    reach = flat.select(F.greatest(F.max(F.abs("x")), F.max(F.abs("y")))).scalar()
    scale = F.when(reach > 0, F.lit(START_SPAN) / reach).otherwise(F.lit(1.0))
    return flat.select("id", (F.col("x") * scale).alias("x"), (F.col("y") * scale).alias("y"))


def _clip(c: Column) -> Column:
    return F.greatest(F.lit(-MAX_FORCE), F.least(F.lit(MAX_FORCE), c))


def layout_2d(
    graph: DataFrame,
    start: DataFrame,
    epochs: int = 50,
    min_dist: float = 0.05,
    negatives: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Coordinates (id, x, y) of the nodes of ``start`` under the edges (src, dst, weight)."""
    a, b = curve_parameters(min_dist)
    start = materialize(start.select("id", "x", "y"), "start")
    nodes = materialize(dense_index(start.select("id"), "node", seed), "nodes")
    n = nodes.count()
    ends = nodes.select(F.col("id").alias("dst"), F.col("node").alias("other"))
    edges = materialize(
        graph.join(nodes.withColumnRenamed("id", "src"), "src")
        .join(ends, "dst")
        .select("node", "other", "weight"),
        "layout_edges",
    )
    places = start.join(nodes, "id").select("node", "x", "y")
    if epochs:
        # Ids may repeat in the start; after one epoch a node has one place.
        places = epoch_moved(edges, materialize(places, "layout"), n, (a, b), 1.0, 0, negatives, seed)
    places = materialize(places, "layout")
    if epochs > 1:
        places = _later_epochs(edges, places, nodes.select("node"), n, (a, b), epochs, negatives, seed)
    discard(edges)
    return places.join(nodes, "node").select("id", "x", "y")


def drawn_nodes(places: DataFrame, n: int, epoch: int, negatives: int, seed: int) -> DataFrame:
    """(node, other): the nodes that push each node in an epoch."""
    drawn = F.pmod(F.xxhash64("node", F.lit(seed), F.lit(epoch), "draw"), F.lit(n))
    draws = places.select("node", F.explode(F.sequence(F.lit(1), F.lit(negatives))).alias("draw"))
    return draws.select("node", drawn.alias("other"))


def epoch_moved(
    edges: DataFrame,
    places: DataFrame,
    n: int,
    curve: tuple[float, float],
    alpha: float,
    epoch: int,
    negatives: int,
    seed: int,
) -> DataFrame:
    """Places (node, x, y) after one epoch.

    Every edge, and every draw, sends the place of ``other`` to ``node``. Edges lie where the places of ``other`` are sent, so they stay; what
    moves is one message for each, and forces are summed where the messages arrive.
    """
    a, b = curve
    there = places.select(F.col("node").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    pulls = edges.join(there, "other").select("node", "ox", "oy", "weight")
    pushes = drawn_nodes(places, n, epoch, negatives, seed).join(there, "other")
    sent = pulls.unionByName(pushes.select("node", "ox", "oy", F.lit(None).cast("double").alias("weight")))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    d2 = dx * dx + dy * dy
    pull = F.when(
        d2 > 0, -2.0 * a * b * F.pow(d2, F.lit(b - 1.0)) / (1.0 + a * F.pow(d2, F.lit(b)))
    ).otherwise(0.0)
    push = F.when(d2 > 0, 2.0 * b / ((0.001 + d2) * (1.0 + a * F.pow(d2, F.lit(b))))).otherwise(0.0)
    is_pull = F.col("weight").isNotNull()
    forces = {}
    for axis, gap in (("x", dx), ("y", dy)):
        forces[f"f{axis}"] = F.when(is_pull, F.col("weight") * _clip(pull * gap))
        forces[f"g{axis}"] = F.when(~is_pull, _clip(push * gap))
    total = (
        sent.join(places, "node")
        .groupBy("node")
        .agg(
            F.min("x").alias("x"),
            F.min("y").alias("y"),
            F.sum("weight").alias("mass"),
            *[F.sum(force).alias(name) for name, force in forces.items()],
        )
    )

    def moved(axis: str) -> Column:
        mass = F.greatest(F.coalesce("mass", F.lit(0.0)), F.lit(1e-9))
        step = F.coalesce(f"f{axis}", F.lit(0.0)) / mass + F.coalesce(f"g{axis}", F.lit(0.0))
        return (F.col(axis) + F.lit(alpha) * step).alias(axis)

    return total.select("node", moved("x"), moved("y"))


def _later_epochs(
    edges: DataFrame,
    places: DataFrame,
    nodes: DataFrame,
    n: int,
    curve: tuple[float, float],
    epochs: int,
    negatives: int,
    seed: int,
) -> DataFrame:
    """Places (node, x, y) after the epochs that follow the first, each as in :func:`epoch_moved`.

    Draws depend on node and epoch alone, so a block asks for the places of an epoch's draws two epochs ahead, in the
    rows that carry its answers; every epoch stays one exchange.
    """
    size = max(1, min(BLOCK_NODES, -(-n // BLOCKS)))
    dealt = edges.withColumn("block", F.floor(F.col("node") / F.lit(size)).cast("int"))
    held = materialize(dealt.groupBy("block").applyInArrow(_pack(size), _HELD), "layout_held")
    begun = nodes.join(places, "node", "left").withColumn("block", F.floor(F.col("node") / F.lit(size)).cast("int"))
    draws = _Draws(n, size, epochs, negatives, seed)
    sent = materialize(begun.groupBy("block").applyInArrow(_begin(draws), _SENT), "layout_sent")
    at = 0
    while at < epochs:
        table = sent
        for epoch in range(at, min(at + ROUNDS, epochs)):
            # Epoch 0 is done: its round only answers what was asked for the next.
            alpha = 1.0 - epoch / epochs if epoch else None
            step = _step(draws, epoch, alpha, curve)
            table = held.groupBy("block").cogroup(table.groupBy("block")).applyInArrow(step, _SENT)
        replaced, sent = sent, materialize(table, "layout_sent")
        discard(replaced)
        at += ROUNDS
    places = materialize(sent.where("peer < 0").select("block", "near").mapInArrow(_unfold(size), "node long, x double, y double"), "layout")
    discard(sent)
    discard(held)
    return places


_LONG = np.dtype("<i8")
_PLACE = np.dtype("<u4")
_REAL = np.dtype("<f8")


def _mixed(h: np.ndarray) -> np.ndarray:
    """The last step of xxHash64."""
    h = (h ^ (h >> np.uint64(33))) * _P[1]
    h = (h ^ (h >> np.uint64(29))) * _P[2]
    return h ^ (h >> np.uint64(32))


_P = [np.uint64(v) for v in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]


def _turned(v: np.ndarray, by: int) -> np.ndarray:
    return (v << np.uint64(by)) | (v >> np.uint64(64 - by))


def _hash_long(v: np.ndarray, h: np.ndarray) -> np.ndarray:
    """xxHash64 of 8 bytes each."""
    h = h + _P[4] + np.uint64(8)
    return _mixed(_turned(h ^ (_turned(v.astype(np.uint64) * _P[1], 31) * _P[0]), 27) * _P[0] + _P[3])


def _hash_int(v: np.ndarray, h: np.ndarray) -> np.ndarray:
    """xxHash64 of 4 bytes each."""
    h = h + _P[4] + np.uint64(4)
    return _mixed(_turned(h ^ ((v.astype(np.int64) & 0xFFFFFFFF).astype(np.uint64) * _P[0]), 23) * _P[1] + _P[2])


class _Draws:
    """What :func:`drawn_nodes` draws, for the nodes of a block."""

    def __init__(self, n: int, size: int, epochs: int, negatives: int, seed: int):
        self.n, self.size, self.epochs, self.seed = n, size, epochs, seed
        # The numbers of F.sequence(1, negatives).
        self.numbers = list(range(1, negatives + 1) if negatives > 0 else range(1, negatives - 1, -1))

    def nodes(self, block: int) -> np.ndarray:
        return np.arange(block * self.size, min(self.n, (block + 1) * self.size), dtype=np.int64)

    def drawn(self, block: int, epoch: int) -> np.ndarray:
        """Node numbers, those of a node side by side."""
        nodes = self.nodes(block)
        number = np.tile(np.array(self.numbers, np.int64), len(nodes))
        with np.errstate(over="ignore"):
            h = _hash_long(np.repeat(nodes, len(self.numbers)), np.full(len(number), 42, np.uint64))
            # A seed beyond the range of int is a long in Spark, too.
            fixed = _hash_int if -(2**31) <= self.seed < 2**31 else _hash_long
            h = fixed(np.full(len(number), self.seed, np.int64), h)
            h = _hash_int(np.full(len(number), epoch, np.int64), h)
            return np.mod(_hash_int(number, h).view(np.int64), self.n)

    def asks(self, block: int, epoch: int) -> dict[int, bytes]:
        """The nodes that a block draws in an epoch, each once and in order, by the block that holds them."""
        return _by_block(np.unique(self.drawn(block, epoch)), self.size) if epoch < self.epochs else {}


def _by_block(nodes: np.ndarray, size: int) -> dict[int, bytes]:
    """Places in their blocks of sorted nodes."""
    block = nodes // size
    begin = np.flatnonzero(np.diff(block, prepend=-1))
    places = (nodes % size).astype(_PLACE)
    return {int(block[a]): places[a:b].tobytes() for a, b in zip(begin, np.append(begin[1:], len(nodes)), strict=True)}


def _pack(size: int) -> Callable[[pa.Table], pa.Table]:
    """The edges of a block as one row, and for each block the nodes that they need of it."""

    def pack(table: pa.Table) -> pa.Table:
        if not len(table):
            return _rows(_HELD, [])
        block = table.column("block")[0].as_py()
        node, other = (table.column(c).to_numpy() for c in ("node", "other"))
        weight = table.column("weight").cast(pa.float64())
        pulls, weight = weight.is_valid().to_numpy(), weight.fill_null(0.0).to_numpy()
        order = np.lexsort((weight, other, node))
        others, slot = np.unique(other[order], return_inverse=True)
        edges = ((node[order] % size).astype(_PLACE), slot.astype(_PLACE), weight[order].astype(_REAL), pulls[order].astype(np.uint8))
        rows = [(block, -1, *(v.tobytes() for v in edges), others.astype(_LONG).tobytes())]
        rows += [(peer, block, places, b"", b"", b"", b"") for peer, places in _by_block(others, size).items()]
        return _rows(_HELD, rows)

    return pack


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.table({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


class _State:
    """Places of some nodes; ``there`` is 0 for nodes without one."""

    def __init__(self, x: np.ndarray, y: np.ndarray, there: np.ndarray):
        self.x, self.y, self.there = x, y, there

    def pick(self, places: np.ndarray) -> bytes:
        return self.x[places].tobytes() + self.y[places].tobytes() + self.there[places].tobytes()

    def raw(self) -> bytes:
        return self.pick(np.arange(len(self.x)))

    @staticmethod
    def of(raws: list[bytes]) -> _State:
        parts = [(r, len(r) // 17) for r in raws]
        x = [np.frombuffer(r, _REAL, n) for r, n in parts]
        y = [np.frombuffer(r, _REAL, n, 8 * n) for r, n in parts]
        there = [np.frombuffer(r, np.uint8, n, 16 * n) for r, n in parts]
        return _State(*(np.concatenate(v) if v else np.zeros(0) for v in (x, y, there)))


def _begin(draws: _Draws) -> Callable[[pa.Table], pa.Table]:
    """The state of a block, and what it asks for the epoch after the first."""

    def begin(table: pa.Table) -> pa.Table:
        if not len(table):
            return _rows(_SENT, [])
        block = table.column("block")[0].as_py()
        at = table.column("node").to_numpy() % draws.size
        m = len(draws.nodes(block))
        state = _State(np.zeros(m), np.zeros(m), np.zeros(m, np.uint8))
        state.x[at] = table.column("x").fill_null(0.0).to_numpy()
        state.y[at] = table.column("y").fill_null(0.0).to_numpy()
        state.there[at] = table.column("x").is_valid().to_numpy()
        asks = draws.asks(block, 1)
        return _rows(_SENT, [(block, -1, state.raw(), b"", b""), *((p, block, b"", b"", a) for p, a in asks.items())])

    return begin


def _clipped(force: np.ndarray) -> np.ndarray:
    """As :func:`_clip`, for which NaN is above all numbers."""
    return np.clip(np.where(np.isnan(force), MAX_FORCE, force), -MAX_FORCE, MAX_FORCE)


def _moved(
    draws: _Draws, block: int, epoch: int, alpha: float, curve: tuple[float, float], state: _State, near: _State, far: _State, edges: dict | None
) -> _State:
    a, b = curve
    m = len(state.x)
    fx, fy, gx, gy, mass, met = (np.zeros(m) for _ in range(6))

    def add(to: np.ndarray, slot: np.ndarray, source: _State, weight: np.ndarray, pulls: np.ndarray) -> None:
        here = (source.there[slot] > 0) & (state.there[to] > 0)
        to, slot, weight, pulls = to[here], slot[here], weight[here], pulls[here]
        met[:] += np.bincount(to, minlength=m)
        for pulling in (True, False):
            mine = pulls if pulling else ~pulls
            if not mine.any():
                continue
            at, there, w = (v if mine.all() else v[mine] for v in (to, slot, weight))
            dx, dy = state.x[at] - source.x[there], state.y[at] - source.y[there]
            d2 = dx * dx + dy * dy
            apart = (d2 > 0) | np.isnan(d2)
            if pulling:
                pull = np.where(apart, -2.0 * a * b * d2 ** (b - 1.0) / (1.0 + a * d2**b), 0.0)
                for force, sums in ((w * _clipped(pull * dx), fx), (w * _clipped(pull * dy), fy), (w, mass)):
                    sums += np.bincount(at, force, m)
            else:
                push = np.where(apart, 2.0 * b / ((0.001 + d2) * (1.0 + a * d2**b)), 0.0)
                for force, sums in ((_clipped(push * dx), gx), (_clipped(push * dy), gy)):
                    sums += np.bincount(at, force, m)

    with np.errstate(all="ignore"):
        if edges:
            to, slot = (np.frombuffer(edges[c], _PLACE) for c in ("node", "slot"))
            weight, pulls = np.frombuffer(edges["weight"], _REAL), np.frombuffer(edges["pulls"], np.uint8) > 0
            for i in range(0, len(to), SLICE):
                part = slice(i, i + SLICE)
                add(to[part], slot[part], near, weight[part], pulls[part])
        slot = np.unique(draws.drawn(block, epoch), return_inverse=True)[1]
        to = np.repeat(np.arange(m), len(draws.numbers))
        for i in range(0, len(to), SLICE):
            part = slice(i, i + SLICE)
            none = np.zeros(len(to[part]), bool)
            add(to[part], slot[part], far, np.zeros(len(none)), none)
        mass = np.maximum(mass, 1e-9)
        # A node that no place reached is left out, as by the join of an epoch.
        return _State(state.x + alpha * (fx / mass + gx), state.y + alpha * (fy / mass + gy), (state.there * (met > 0)).astype(np.uint8))


def _step(draws: _Draws, epoch: int, alpha: float | None, curve: tuple[float, float]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """An epoch of a block: its new places, what others asked of them, and what it asks for the epoch after the next."""

    def step(held: pa.Table, sent: pa.Table) -> pa.Table:
        if not len(sent):
            return _rows(_SENT, [])
        rows = {r["peer"]: r for r in sent.to_pylist()}
        block = sent.column("block")[0].as_py()
        own = rows.pop(-1)
        needs = {r["peer"]: r for r in held.to_pylist()}
        edges = needs.pop(-1, None)
        state = _State.of([own["near"]])
        if alpha is not None:
            near, far = (_State.of([rows[p][c] for p in sorted(rows)]) for c in ("near", "far"))
            state = _moved(draws, block, epoch, alpha, curve, state, near, far, edges)
        out = [(block, -1, state.raw(), b"", b"")]
        if epoch + 1 < draws.epochs:
            asks = draws.asks(block, epoch + 2)
            asked = {p: r["ask"] for p, r in rows.items()}
            for peer in sorted({*needs, *asked, *asks}):
                near, far = (state.pick(np.frombuffer(raw, _PLACE)) for raw in (needs[peer]["node"] if peer in needs else b"", asked.get(peer, b"")))
                out.append((peer, block, near, far, asks.get(peer, b"")))
        return _rows(_SENT, out)

    return step


def _unfold(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each node that has a place."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                state = _State.of([row["near"]])
                at = np.flatnonzero(state.there)
                columns = [row["block"] * size + at, state.x[at], state.y[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "x", "y"])

    return unfold
