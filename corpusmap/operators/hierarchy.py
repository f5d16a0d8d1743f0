"""The exact density hierarchy of 2-D points: HDBSCAN* (Campello et al., PAKDD 2013) without levels.

Two points are as far apart as their mutual reachability, the largest of their distance and both core distances. The hierarchy is that
of any graph holding a minimum spanning tree of it, and such a graph is found from cells of bounded size:

* within a cell, the tree of its own points;
* across two cells, the crossing edges of the tree of both, unless a witness rules the pair out: a point c nearer to all of either cell than the
  cells are to each other, with no larger core distance. Then every edge between the cells can be replaced by two that are
  no heavier and shorter, so by induction over weight and length nothing is lost, at any size of witness list.

Edges are then merged lightest first, those of one weight at once. Merging works in batches: the edges up to a weight fall into connected
groups, and each group is merged in a task by itself, which turns every component into one node for the edges that follow. A
batch is made smaller until no group holds more than ``GROUP_EDGES`` edges; the last one takes what is left. Whenever two or more components of the minimum size meet, their clusters
are closed: the stability is final, and so is the choice between a cluster and those below it (excess of mass).

Copies of a point are one node with a weight. A cluster of copies alone is taken to fall apart at the smallest distance of the graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusmap.operators.cells import CellTree, box_gap, box_reach, fit_cells, with_cells
from corpusmap.operators.components import connected_components
from corpusmap.sources.scratch import discard, materialize, materialize_observed

GROUP_EDGES = 1_000_000
#: Witnesses of a cell, and cells whose witnesses a cell asks.
WITNESSES, ASKED = 8, 48
#: Cells that a cell meets in one group.
PARTNERS = 32
#: Nodes of the tree whose boxes are compared with all witnesses at once.
NODES_AT_ONCE = 4096
_PLACE_BITS, _NODE_BITS = 24, 44


def _nodes(cored: DataFrame, tree: CellTree) -> DataFrame:
    """Distinct points as nodes: node, cell, x, y, core, size (copies). A node's number holds its cell."""
    distinct = cored.groupBy("x", "y").agg(F.min("core").alias("core"), F.count(F.lit(1)).alias("size"))

    def number(table: pa.Table) -> pa.Table:
        table = table.sort_by([("x", "ascending"), ("y", "ascending")])
        cell = table.column("cell")[0].as_py()
        node = (cell << _PLACE_BITS) + np.arange(len(table))
        return table.append_column("node", pa.array(node, pa.int64()))

    placed = with_cells(distinct, tree)
    return placed.groupBy("cell").applyInArrow(number, StructType([*placed.schema, StructField("node", LongType())]))


class _Neighbourhood:
    """Boxes, least core distances and witnesses of the cells."""

    def __init__(self, tree: CellTree, cells: pa.Table):
        n = tree.cells
        self.low, self.high = np.full((n, 2), np.inf), np.full((n, 2), -np.inf)
        at = cells.column("cell").to_numpy()
        for box, names in ((self.low, ("x0", "y0")), (self.high, ("x1", "y1"))):
            for axis, name in enumerate(names):
                box[at, axis] = cells.column(name).to_numpy()
        self.core = np.full(n, np.inf)
        self.core[at] = cells.column("core").to_numpy()
        self.tree = tree
        self.lows, self.highs = tree.boxed(self.low, self.high)
        cores = np.full(len(tree.axis), np.inf)
        for node in range(len(tree.axis) - 1, -1, -1):
            kids = [tree.left[node], tree.right[node]]
            cores[node] = self.core[tree.cell[node]] if tree.axis[node] < 0 else cores[kids].min()
        self.cores = cores
        self.axis, self.left, self.right, self.cell = (np.array(c) for c in (tree.axis, tree.left, tree.right, tree.cell))
        lists = [cells.column(c).combine_chunks() for c in ("wx", "wy", "wcore")]
        self.witness_cell = np.repeat(at, lists[0].value_lengths().to_numpy())
        self.witness = np.stack([w.flatten().to_numpy() for w in lists], axis=1)
        order = np.argsort(self.witness_cell, kind="stable")
        self.witness, self.witness_cell = self.witness[order], self.witness_cell[order]
        self.middle = np.where(np.isfinite(self.low), (self.low + self.high) / 2, np.inf)

    def partners(self, cell: int) -> list[int]:
        """Cells of higher number that may share an edge of the spanning tree with ``cell``."""
        low, high = self.low[cell], self.high[cell]
        apart = ((self.middle - self.middle[cell]) ** 2).sum(axis=1)
        near = np.argpartition(apart, min(ASKED, len(apart) - 1))[:ASKED] if len(apart) > ASKED else np.arange(len(apart))
        asked = self.witness[np.isin(self.witness_cell, near)]
        mine = box_reach(asked[:, :2], low, high)
        out, pending = [], [np.zeros(1, np.int64)]
        while pending:
            nodes = pending.pop()
            if len(nodes) > NODES_AT_ONCE:
                pending += [nodes[NODES_AT_ONCE:], nodes[:NODES_AT_ONCE]]
                continue
            nodes = nodes[np.isfinite(self.lows[nodes]).all(axis=1)]
            lows, highs = self.lows[nodes], self.highs[nodes]
            gap = box_gap(low, high, lows, highs)
            bound = np.maximum(np.maximum(gap, self.core[cell]), self.cores[nodes])
            far = np.zeros((len(nodes), len(asked)))
            for axis in (0, 1):
                place = asked[None, :, axis]
                far += np.maximum(np.abs(place - lows[:, None, axis]), np.abs(place - highs[:, None, axis])) ** 2
            able = (mine[None, :] < gap[:, None]) & (asked[None, :, 2] <= bound[:, None])
            nodes = nodes[~(able & (np.sqrt(far) < gap[:, None])).any(axis=1)]
            leaf = self.axis[nodes] < 0
            out.append(self.cell[nodes[leaf]])
            if not leaf.all():
                pending.append(np.concatenate([self.left[nodes[~leaf]], self.right[nodes[~leaf]]]))
        out = np.concatenate(out)
        return np.sort(out[out > cell]).tolist()


def _tasks(tree: CellTree) -> int:
    return max(1, min(1024, tree.cells // 16))


def _cell_pairs(nodes: DataFrame, tree: CellTree) -> DataFrame:
    """(a, b, slice): pairs of cells that may share an edge, a cell with itself included; at most ``PARTNERS`` in a slice of ``a``."""

    def summary(own: pd.DataFrame) -> pd.DataFrame:
        x, y, core = (own[c].to_numpy() for c in ("x", "y", "core"))
        parts = np.array_split(np.argsort(x if np.ptp(x) >= np.ptp(y) else y, kind="stable"), min(WITNESSES, len(x)))
        best = [p[np.argmin(core[p])] for p in parts]
        row = [own["cell"].iloc[0], x.min(), x.max(), y.min(), y.max(), core.min(), x[best], y[best], core[best]]
        return pd.DataFrame([row], columns=names)

    names = ["cell", "x0", "x1", "y0", "y1", "core", "wx", "wy", "wcore"]
    schema = "cell int, " + ", ".join(f"{c} double" for c in names[1:6]) + ", " + ", ".join(f"{c} array<double>" for c in names[6:])
    cells = materialize(nodes.groupBy("cell").applyInPandas(summary, schema), "cells")
    around = _Neighbourhood(tree, cells.toArrow())  # a row per cell

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column("cell").to_pylist():
                others = [cell, *around.partners(cell)]
                columns = [[cell] * len(others), others, [i // PARTNERS for i in range(len(others))]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in columns], ["a", "b", "slice"])

    # A number of its own: rows this narrow would be put together into one task.
    spread = cells.select("cell").repartition(_tasks(tree), "cell")
    return spread.mapInArrow(pair, "a int, b int, slice int")


def spanning_tree(x: np.ndarray, y: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, weight) of a minimum spanning tree of the mutual reachability of some points (Prim)."""
    n = len(x)
    source, best, outside = np.zeros(n, np.int64), np.full(n, np.inf), np.ones(n, bool)
    ends, weights, at = np.empty(n - 1, np.int64), np.empty(n - 1), 0
    for step in range(n - 1):
        outside[at] = False
        best[at] = np.inf
        w = np.maximum(np.hypot(x - x[at], y - y[at]), np.maximum(core, core[at]))
        nearer = outside & (w < best)
        best[nearer] = w[nearer]
        source[nearer] = at
        at = int(np.argmin(best))
        ends[step], weights[step] = at, best[at]
    return source[ends], ends, weights


class _Place:
    """Nodes of a cell with its spanning tree: ``up`` is the place of a node's parent, below 0 at the root."""

    def __init__(self, own: pa.Table):
        self.node, self.x, self.y, self.core, self.up, self.weight = (
            own.column(c).to_numpy() for c in ("node", "x", "y", "core", "up", "weight")
        )


def crossing_edges(a: _Place, b: _Place) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in a, place in b, weight): crossing edges of a minimum spanning tree of both (Borůvka).

    Edges are those of the two trees and all that cross. Each component takes its lightest edge to another, ties going to
    the edge of the lowest number, until one component is left.
    """
    n, m = len(a.x), len(b.x)
    cross = np.hypot(a.x[:, None] - b.x[None, :], a.y[:, None] - b.y[None, :])
    np.maximum(cross, a.core[:, None], out=cross)
    np.maximum(cross, b.core[None, :], out=cross)
    nearest = int(cross.argmin())
    if cross.flat[nearest] >= max(a.weight.max(), b.weight.max()):  # both trees are whole before they meet
        return np.array([nearest // m]), np.array([nearest % m]), np.array([cross.flat[nearest]])
    in_a, in_b = np.flatnonzero(a.up >= 0), np.flatnonzero(b.up >= 0)
    # Both ends, weights and numbers of the edges within a cell.
    low = np.concatenate([in_a, n + in_b])
    high = np.concatenate([a.up[in_a], n + b.up[in_b]])
    weight = np.concatenate([a.weight[in_a], b.weight[in_b]])
    number = n * m + np.arange(len(low))
    rows, cols = np.arange(n), np.arange(m)
    part, parts, taken = np.arange(n + m), n + m, []
    while parts > 1:
        if parts < n + m:
            cross[part[:n, None] == part[None, n:]] = np.inf
            apart = part[low] != part[high]
            low, high, weight, number = low[apart], high[apart], weight[apart], number[apart]
        right, left = cross.argmin(axis=1), cross.argmin(axis=0)
        begin = np.concatenate([rows, n + cols, low, high])
        end = np.concatenate([n + right, left, high, low])
        weights = np.concatenate([cross[rows, right], cross[left, cols], weight, weight])
        numbers = np.concatenate([rows * m + right, left * m + cols, number, number])
        owner = part[begin]
        order = np.lexsort((numbers, weights, owner))
        best = order[np.diff(owner[order], prepend=-1) > 0]
        taken.append(np.unique(numbers[best[numbers[best] < n * m]]))
        to = part[end[best]]
        # Two components that take each other hang on the lower one; no longer circles arise.
        mutual = (to[to] == np.arange(parts)) & (np.arange(parts) < to)
        to[mutual] = np.flatnonzero(mutual)
        while (further := to[to]).tobytes() != to.tobytes():
            to = further
        roots, to = np.unique(to, return_inverse=True)
        part, parts = to[part], len(roots)
    taken = np.concatenate(taken)
    u, v = np.divmod(taken, m)
    w = np.hypot(a.x[u] - b.x[v], a.y[u] - b.y[v])
    return u, v, np.maximum(w, np.maximum(a.core[u], b.core[v]))


def reachability_edges(nodes: DataFrame, tree: CellTree) -> DataFrame:
    """(u, v, weight): edges between nodes (node, cell, x, y, core) that hold a minimum spanning tree of all of them."""
    columns = ["node", "cell", "x", "y", "core"]

    def grow(own: pa.Table) -> pa.Table:
        """The spanning tree of a cell: the place of each node's parent, and how far it is."""
        x, y, core = (own.column(c).to_numpy() for c in ("x", "y", "core"))
        up, weight = np.full(len(x), -1), np.zeros(len(x))
        u, v, w = spanning_tree(x, y, core)
        up[v], weight[v] = u, w
        at = pa.array(np.arange(len(x)))
        return pa.table([*own.columns, at, pa.array(up), pa.array(weight)], [*columns, "at", "up", "weight"])

    grown = materialize(
        nodes.select(*columns).groupBy("cell").applyInArrow(
            grow, "node long, cell int, x double, y double, core double, at long, up long, weight double"
        ),
        "grown",
    )
    pairs = materialize(_cell_pairs(nodes, tree), "cell-pairs")
    own = grown.join(pairs.select(F.col("a").alias("cell"), "a", "slice").distinct(), "cell")
    other = grown.join(pairs.where("a != b").select(F.col("b").alias("cell"), "a", "slice"), "cell")
    held = [*columns, "at", "up", "weight"]

    def connect(table: pa.Table) -> pa.Table:
        """The tree of a cell, and the edges between it and some cells."""
        first = table.column("a")[0].as_py()
        table = table.sort_by([("cell", "ascending"), ("at", "ascending")])
        cell = table.column("cell").to_numpy()
        bounds = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        places = {int(cell[i]): _Place(table.slice(i, j - i)) for i, j in zip(bounds[:-1], bounds[1:], strict=True)}
        a = places.pop(first)
        found = []
        if table.column("slice")[0].as_py() == 0:
            below = np.flatnonzero(a.up >= 0)
            found.append((a.node[a.up[below]], a.node[below], a.weight[below]))
        for b in places.values():
            u, v, w = crossing_edges(a, b)
            found.append((a.node[u], b.node[v], w))
        u, v, w = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"u": u, "v": v, "weight": w})

    both = own.select("a", "slice", *held).unionByName(other.select("a", "slice", *held))
    return both.repartition(_tasks(tree), "a", "slice").groupBy("a", "slice").applyInArrow(connect, "u long, v long, weight double")


_OUT = "kind string, node long, into long, cluster string, parent string, size long, acc double, below double, wanted boolean"


class _Merger:
    """Merges the edges of one group, lightest first."""

    def __init__(self, nodes: pa.Table, min_size: int, floor: float, batch: int):
        self.ids = nodes.column("node").to_pylist()
        self.size = nodes.column("size").to_pylist()
        self.cluster = nodes.column("cluster").to_pylist()
        self.acc, self.below = nodes.column("acc").to_pylist(), nodes.column("below").to_pylist()
        self.parent = list(range(len(self.ids)))
        self.open = [[i] for i in self.parent]  # nodes of a component that no closed cluster holds
        self.label: list[str | None] = [None] * len(self.ids)
        self.min_size, self.floor, self.batch = min_size, floor, batch
        self.closed: list[tuple[str, str, bool]] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _close(self, root: int, gain: float, parent: str) -> float:
        stability = self.acc[root] - self.size[root] * gain
        wanted = stability >= self.below[root]
        self.closed.append((self.cluster[root], parent, wanted))
        for i in self.open[root]:
            self.label[i] = self.cluster[root]
        self.open[root] = []
        return max(stability, self.below[root])

    def _joined(self, root: int, parts: list[int], weight: float) -> None:
        """Components ``parts`` are one, at ``root``, from ``weight`` on."""
        gain = 1.0 / max(weight, self.floor)
        large = [p for p in parts if self.size[p] >= self.min_size]
        total = sum(self.size[p] for p in parts)
        cluster, acc, below = None, 0.0, 0.0
        if len(large) == 1:
            own = large[0]
            cluster, below = self.cluster[own], self.below[own]
            acc = self.acc[own] + (total - self.size[own]) * gain
        elif total >= self.min_size:
            cluster, acc = f"{self.ids[root]}|{weight!r}", total * gain
            below = sum(self._close(p, gain, cluster) for p in large)
        lists = sorted((self.open[p] for p in parts), key=len)
        for some in lists[:-1]:
            lists[-1].extend(some)
        self.size[root], self.cluster[root], self.acc[root], self.below[root] = total, cluster, acc, below
        self.open[root] = lists[-1]

    def run(self, u: np.ndarray, v: np.ndarray, weight: np.ndarray) -> None:
        order = np.lexsort((v, u, weight))
        weights = weight[order]
        bounds = [0, *(np.flatnonzero(np.diff(weights)) + 1).tolist(), len(weights)]
        u, v = u[order].tolist(), v[order].tolist()
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            parts: dict[int, list[int]] = {}
            for a, b in zip(u[begin:end], v[begin:end], strict=True):
                a, b = self.find(a), self.find(b)
                if a != b:
                    one, other = parts.pop(a, [a]), parts.pop(b, [b])
                    if len(self.open[a]) < len(self.open[b]):
                        a, b = b, a
                    self.parent[b] = a
                    parts[a] = one + other
            for root, merged in parts.items():
                self._joined(root, merged, float(weights[begin]))

    def result(self) -> pa.Table:
        mask = (1 << _NODE_BITS) - 1
        roots = [self.find(i) for i in range(len(self.ids))]
        least: dict[int, int] = {}
        for i, r in enumerate(roots):
            base = self.ids[i] & mask
            least[r] = min(base, least.get(r, base))
        fresh = {r: (self.batch << _NODE_BITS) + base for r, base in least.items()}
        rows = [("node", self.ids[i], fresh[r], self.label[i], None, None, None, None, None) for i, r in enumerate(roots)]
        rows += [("state", fresh[r], None, self.cluster[r], None, self.size[r], self.acc[r], self.below[r], None) for r in fresh]
        rows += [("cluster", None, None, c, parent, None, None, None, wanted) for c, parent, wanted in self.closed]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
        names = [f.split()[0] for f in _OUT.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _merged(edges: DataFrame, states: DataFrame, min_size: int, floor: float, batch: int) -> DataFrame:
    """Rows of :data:`_OUT` for each group of edges (group, u, v, weight) and of nodes (group, node, …)."""

    def merge(nodes: pa.Table, own: pa.Table) -> pa.Table:
        merger = _Merger(nodes, min_size, floor, batch)
        ids = nodes.column("node").to_numpy()
        order = np.argsort(ids)
        place = lambda c: order[np.searchsorted(ids, own.column(c).to_numpy(), sorter=order)]
        if len(own):
            merger.run(place("u"), place("v"), own.column("weight").to_numpy())
        return merger.result()

    return states.groupBy("group").cogroup(edges.groupBy("group")).applyInArrow(merge, _OUT)


def _batch(edges: DataFrame, n: int, group_edges: int) -> tuple[DataFrame, DataFrame | None, float]:
    """The next edges with their group, (group, node) of what they touch, and the weight up to which they go."""
    ends = lambda e: e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    if n <= group_edges:
        return edges.withColumn("group", F.lit(0)), ends(edges).withColumn("group", F.lit(0)), float("inf")
    share = 0.5
    while True:
        limit = edges.agg(F.percentile_approx("weight", share, 10_000)).first()[0]
        light = edges.where(F.col("weight") <= limit)
        if share * n <= group_edges:
            return light.withColumn("group", F.lit(0)), ends(light).withColumn("group", F.lit(0)), limit
        named = connected_components(light.select(F.col("u").alias("src"), F.col("v").alias("dst")))
        named = materialize(named.select("node", F.col("component").alias("group")), "groups")
        grouped = light.join(named.withColumnRenamed("node", "u"), "u").select("u", "v", "weight", "group")
        grouped = materialize(grouped, "grouped")
        most = grouped.groupBy("group").count().agg(F.max("count")).first()[0]
        if most <= group_edges:
            return grouped, named, limit
        share /= 2


def merge_tree(nodes: DataFrame, edges: DataFrame, min_size: int, group_edges: int = GROUP_EDGES) -> tuple[DataFrame, DataFrame]:
    """Clusters of the hierarchy of the edges (u, v, weight) over nodes (node, size, core).

    Returns (node, cluster): the first closed cluster that holds a node, nodes of none left out; and
    (cluster, parent, wanted): all closed clusters, wanted if not less stable than the best choice below.
    """
    floor = edges.agg(F.min("weight")).first()[0] or 1.0
    heavy = F.col("size") >= min_size
    states = nodes.select(
        "node",
        "size",
        F.when(heavy, F.concat(F.col("node").cast("string"), F.lit("|0"))).alias("cluster"),
        F.when(heavy, F.col("size") / F.greatest("core", F.lit(floor))).otherwise(0.0).alias("acc"),
        F.lit(0.0).alias("below"),
    )
    pointers, closed, batch = [], [], 0
    while n := edges.count():
        batch += 1
        grouped, touched, limit = _batch(edges, n, group_edges)
        out = materialize(
            _merged(grouped, states.join(touched, "node"), min_size, floor, batch), f"merged-{batch}"
        )
        pointers.append(out.where("kind = 'node'").select("node", "into", "cluster"))
        closed.append(out.where("kind = 'cluster'").select("cluster", "parent", "wanted"))
        if limit == float("inf"):
            break
        into = pointers[-1].select("node", "into")
        states = materialize(
            states.join(into, "node", "left_anti").unionByName(
                out.where("kind = 'state'").select("node", "size", "cluster", "acc", "below")
            ),
            "states",
        )
        moved = edges.where(F.col("weight") > limit)
        for end in ("u", "v"):
            ahead = into.select(F.col("node").alias(end), "into")
            moved = moved.join(ahead, end, "left").withColumn(end, F.coalesce("into", end)).drop("into")
        replaced = edges
        edges = materialize(moved.where("u != v").select("u", "v", "weight"), "edges")
        if batch > 1:
            discard(replaced)
    if not pointers:
        empty = nodes.select("node", F.lit("").alias("cluster")).where("false")
        return empty, empty.select("cluster", F.col("cluster").alias("parent"), F.lit(False).alias("wanted"))
    labels = pointers[-1].where("cluster is not null").select("node", "cluster")
    for earlier in reversed(pointers[:-1]):  # what became of a batch's nodes is known from the batches after it
        later = materialize(labels, "labels").select(F.col("node").alias("into"), F.col("cluster").alias("then"))
        told = earlier.join(later, "into", "left").select("node", F.coalesce("cluster", "then").alias("cluster"))
        labels = labels.unionByName(told.where("cluster is not null"))
    clusters = closed[0]
    for more in closed[1:]:
        clusters = clusters.unionByName(more)
    return labels, clusters


def topmost_wanted(clusters: DataFrame) -> DataFrame:
    """(cluster, chosen): the highest wanted cluster at or above each, by pointers that double their reach."""
    now, seen = materialize_observed(
        clusters.select("cluster", F.col("parent").alias("up"), F.when(F.col("wanted"), F.col("cluster")).alias("chosen")),
        "wanted",
        n=F.count(F.lit(1)),
    )
    while seen["n"]:
        over = now.select(F.col("cluster").alias("up"), F.col("up").alias("next"), F.col("chosen").alias("above"), F.lit(True).alias("there"))
        step = now.join(over, "up", "left").select(
            "cluster", F.col("next").alias("up"), F.coalesce("above", "chosen").alias("chosen"), F.coalesce("there", F.lit(False)).alias("went")
        )
        moved, seen = materialize_observed(step, "wanted", n=F.count_if("went"))
        discard(now)
        now = moved
    return now.where("chosen is not null").select("cluster", "chosen")


def hierarchy_clusters(cored: DataFrame, min_size: int, cell_rows: int | None = None, group_edges: int = GROUP_EDGES) -> DataFrame:
    """(x, y, chosen) of the points (x, y, core) in a chosen cluster, named by a text; the root is never chosen."""
    tree = fit_cells(cored, cell_rows) if cell_rows else fit_cells(cored)
    nodes = materialize(_nodes(cored, tree), "nodes")
    edges = materialize(reachability_edges(nodes, tree), "reach")
    labels, clusters = merge_tree(nodes, edges, min_size, group_edges)
    chosen = topmost_wanted(clusters)
    return nodes.join(labels, "node").join(chosen, "cluster").select("x", "y", "chosen")
