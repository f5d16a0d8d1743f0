"""Cells of bounded size over points of the plane, and the pairs of cells that can matter to each other.

A k-d tree on a sample cuts the plane into cells of about as many points each, whatever their density. The driver holds the tree and
one box per cell: at most ``MAX_CELLS`` cells, beyond which cells hold more points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusmap.functions.ordering import hash_key, hash_unit

CELL_ROWS = 256
MAX_CELLS = 1 << 16
#: Sampled points for each cell.
SAMPLE = 32


class CellTree:
    """Splits of the plane; cells are numbered from 0."""

    def __init__(self, points: np.ndarray, smallest: int):
        self.axis, self.cut, self.left, self.right, self.cell = [], [], [], [], []
        self.cells = 0
        stack = [(self._node(), points)]
        while stack:
            node, own = stack.pop()
            found = self._split(own) if len(own) >= 2 * smallest else None
            if found is None:
                self.cell[node] = self.cells
                self.cells += 1
                continue
            axis, cut = found
            self.axis[node], self.cut[node] = axis, cut
            self.left[node], self.right[node] = self._node(), self._node()
            low = own[:, axis] < cut
            stack += [(self.right[node], own[~low]), (self.left[node], own[low])]

    def _node(self) -> int:
        for column, empty in ((self.axis, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.cell, -1)):
            column.append(empty)
        return len(self.axis) - 1

    @staticmethod
    def _split(points: np.ndarray) -> tuple[int, float] | None:
        """The longer side of the points' box, cut at the median."""
        reach = points.max(axis=0) - points.min(axis=0)
        for axis in np.argsort(-reach):
            values = np.sort(points[:, axis])
            cut = values[len(values) // 2]
            if cut == values[0]:  # the lower half is one value: cut above it
                cut = values[np.searchsorted(values, cut, side="right")] if cut < values[-1] else cut
            if cut > values[0]:
                return int(axis), float(cut)
        return None

    def place(self, xy: np.ndarray) -> np.ndarray:
        """Cell of each point."""
        axis, cut = np.array(self.axis), np.array(self.cut)
        left, right = np.array(self.left), np.array(self.right)
        at = np.zeros(len(xy), np.int64)
        alive = np.flatnonzero(axis[at] >= 0)
        while len(alive):
            node = at[alive]
            at[alive] = np.where(xy[alive, axis[node]] < cut[node], left[node], right[node])
            alive = alive[axis[at[alive]] >= 0]
        return np.array(self.cell)[at]

    def boxed(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Boxes of all nodes from those of the cells; a cell without points has a box that no distance reaches."""
        lows, highs = np.full((len(self.axis), 2), np.inf), np.full((len(self.axis), 2), -np.inf)
        for node in range(len(self.axis) - 1, -1, -1):  # children come after their parents
            if self.axis[node] < 0:
                lows[node], highs[node] = low[self.cell[node]], high[self.cell[node]]
            else:
                kids = [self.left[node], self.right[node]]
                lows[node], highs[node] = lows[kids].min(axis=0), highs[kids].max(axis=0)
        return lows, highs


def fit_cells(points: DataFrame, cell_rows: int = CELL_ROWS) -> CellTree:
    """Tree over the points (x, y), fitted on a sample of at most about ``MAX_CELLS`` * ``SAMPLE`` of them."""
    n = points.count()
    wanted = max(1, min(MAX_CELLS, -(-n // cell_rows)))
    share = wanted * SAMPLE / max(n, 1)
    drawn = points.select("x", "y")
    if share < 1:
        drawn = drawn.where(hash_unit(hash_key(F.concat_ws("|", "x", "y"), 5)) < share)
    found = drawn.toArrow()
    xy = np.stack([found.column(c).to_numpy() for c in ("x", "y")], axis=1)
    return CellTree(xy, max(1, -(-len(xy) // (2 * wanted))))


def with_cells(points: DataFrame, tree: CellTree) -> DataFrame:
    """Add ``cell`` to rows that have x and y."""
    names = [*points.columns, "cell"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xy = np.stack([batch.column(c).to_numpy() for c in ("x", "y")], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.place(xy), pa.int32())], names)

    return points.mapInArrow(place, StructType([*points.schema, StructField("cell", IntegerType())]))


def box_gap(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Least distance of a box to boxes."""
    gap = np.maximum(np.maximum(lows - high, low - highs), 0.0)
    return np.sqrt((gap * gap).sum(axis=-1))


def box_reach(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest distance of each point to a box."""
    far = np.maximum(np.abs(points - low), np.abs(points - high))
    return np.sqrt((far * far).sum(axis=-1))


class Surroundings:
    """Cells around points, by their boxes (cell, x0, x1, y0, y1) and how many points they hold (n)."""

    def __init__(self, tree: CellTree, cells: pa.Table, k: int):
        self.tree, self.k = tree, k
        low, high = np.full((tree.cells, 2), np.inf), np.full((tree.cells, 2), -np.inf)
        at = cells.column("cell").to_numpy()
        for box, names in ((low, ("x0", "y0")), (high, ("x1", "y1"))):
            for axis, name in enumerate(names):
                box[at, axis] = cells.column(name).to_numpy()
        self.low, self.high = low, high
        self.lows, self.highs = tree.boxed(low, high)
        self.n = np.zeros(tree.cells, np.int64)
        self.n[at] = cells.column("n").to_numpy()

    def reached(self, xy: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) of every cell that may hold one of the k nearest others of a point, none of them farther than ``bound``."""
        found: list[tuple[np.ndarray, int]] = []
        stack = [(0, np.arange(len(xy)))]
        while stack:
            node, alive = stack.pop()
            alive = alive[box_gap(xy[alive], xy[alive], self.lows[node], self.highs[node]) <= bound[alive]]
            if not len(alive) or not np.isfinite(self.lows[node]).all():
                continue
            if self.tree.axis[node] < 0:
                found.append((alive, self.tree.cell[node]))
            else:
                stack += [(self.tree.left[node], alive), (self.tree.right[node], alive)]
        if not found:
            return np.zeros(0, int), np.zeros(0, int)
        point = np.concatenate([p for p, _ in found])
        cell = np.repeat([c for _, c in found], [len(p) for p, _ in found])
        # Whole cells that together hold enough points bound the distance as well.
        far = box_reach(xy[point], self.low[cell], self.high[cell])
        order = np.lexsort((far, point))
        point, cell, far = point[order], cell[order], far[order]
        first = np.searchsorted(point, point)
        held = np.cumsum(self.n[cell])
        held -= np.where(first > 0, held[first - 1], 0)
        limit = np.array(bound)
        enough = held > self.k
        np.minimum.at(limit, point[enough], far[enough])
        keep = box_gap(xy[point], xy[point], self.low[cell], self.high[cell]) <= limit[point]
        return point[keep], cell[keep]
