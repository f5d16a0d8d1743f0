"""Density clusters of 2-D points: core distances, DBSCAN* levels, clusters of the exact hierarchy.

The levels follow Campello et al., "Density-based clustering based on hierarchical density
estimates", PAKDD 2013: at level eps, core points (core distance <= eps) within eps of each
other are connected. The hierarchy itself needs no levels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpusmap.operators.cells import CELL_ROWS, Surroundings, fit_cells, with_cells
from corpusmap.operators.components import connected_components
from corpusmap.operators.hierarchy import hierarchy_clusters
from corpusmap.operators.indexing import dense_index
from corpusmap.sources.scratch import materialize, materialize_observed

# Half of the 5×5 neighbourhood of a cell: two cells further apart are over eps apart.
_HALF = [(0, 1), (0, 2)] + [(dx, dy) for dx in (1, 2) for dy in (-2, -1, 0, 1, 2)]


def core_distance(points: DataFrame, k: int = 30, cell_rows: int | None = None) -> DataFrame:
    """Distance of each point (id, x, y) to its k-th nearest other point: id, core.

    Copies of a point are one place with a weight. A place meets its own cell first; cells that its k-th distance there, or
    the counts of whole cells, cannot rule out are asked next, each for its k nearest. A point with fewer than k
    others has no row, nor has one without coordinates.
    """
    places = materialize(points.dropna(subset=["x", "y"]).groupBy("x", "y").agg(F.count(F.lit(1)).alias("size")), "sites")
    tree = fit_cells(places, cell_rows or max(CELL_ROWS, 4 * k))
    placed = materialize(with_cells(places, tree), "placed")
    # A row per cell.
    boxes = placed.groupBy("cell").agg(*_box(), F.sum("size").alias("n")).toArrow()
    around = Surroundings(tree, boxes, k)

    def at_home(table: pa.Table) -> pa.Table:
        xy, size = _sites(table)
        return table.append_column("bound", pa.array(np.concatenate([b for *_, b in _kth(xy, xy, size, k)])))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                xy = np.stack([batch.column(c).to_numpy() for c in ("x", "y")], axis=1)
                rows, cells = around.reached(xy, batch.column("bound").to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells, pa.int32()), pa.array(xy[rows, 0]), pa.array(xy[rows, 1])], ["cell", "x", "y"]
                )

    def nearest(asked: pa.Table, own: pa.Table) -> pa.Table:
        xy, size = _sites(own)
        theirs = np.stack([asked.column(c).to_numpy() for c in ("x", "y")], axis=1)
        out = {c: [] for c in ("x", "y", "distance", "weight")}
        for rows, gaps, weights, _ in _kth(theirs, xy, size, k):
            used = np.cumsum(weights, axis=1) - weights <= k  # up to the place that holds the k-th other
            at, column = np.nonzero(used)
            for name, values in (("x", theirs[rows[at], 0]), ("y", theirs[rows[at], 1]), ("distance", gaps[at, column]), ("weight", weights[at, column])):
                out[name].append(values)
        return pa.table({c: np.concatenate(v) if v else np.zeros(0, np.int64 if c == "weight" else float) for c, v in out.items()})

    bounded = placed.groupBy("cell").applyInArrow(at_home, "x double, y double, size long, cell int, bound double")
    asked = bounded.mapInArrow(ask, "cell int, x double, y double")
    found = asked.groupBy("cell").cogroup(placed.groupBy("cell")).applyInArrow(
        nearest, "x double, y double, distance double, weight long"
    )
    # At most k + 1 places of each cell that was asked.
    listed = found.groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("distance", "weight"))).alias("near"))
    last = F.aggregate(
        "near",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("core")),
        lambda a, e: F.struct(
            (a["n"] + e["weight"]).alias("n"),
            F.when((a["n"] <= k) & (a["n"] + e["weight"] > k), e["distance"]).otherwise(a["core"]).alias("core"),
        ),
    )
    cores = listed.select("x", "y", last["core"].alias("core")).where("core is not null")
    return points.select("id", "x", "y").join(cores, ["x", "y"]).select("id", "core")


def _sites(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([table.column(c).to_numpy() for c in ("x", "y")], axis=1), table.column("size").to_numpy()


def _kth(asked: np.ndarray, xy: np.ndarray, size: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For slices of the asked points: their rows, and the distances and weights of the k + 1 nearest places (the own one
    may be among them) in order, and the distance of the k-th other point, infinite if there are fewer."""
    for rows in np.array_split(np.arange(len(asked)), -(-len(asked) * len(xy) // (1 << 19)) or 1):
        gaps = np.hypot(asked[rows, None, 0] - xy[None, :, 0], asked[rows, None, 1] - xy[None, :, 1])
        if gaps.shape[1] > k + 1:
            near = np.argpartition(gaps, k, axis=1)[:, : k + 1]
            gaps, weights = np.take_along_axis(gaps, near, 1), size[near]
        else:
            weights = np.broadcast_to(size, gaps.shape)
        order = np.argsort(gaps, axis=1, kind="stable")
        gaps, weights = np.take_along_axis(gaps, order, 1), np.take_along_axis(weights, order, 1)
        enough = np.cumsum(weights, axis=1) > k
        bound = np.where(enough[:, -1], gaps[np.arange(len(rows)), np.argmax(enough, axis=1)], np.inf)
        yield rows, gaps, weights, bound


def _at_levels(points: DataFrame, eps: list[float]) -> DataFrame:
    """Core points at each level with their grid cell; cells have diagonal eps."""
    levels = F.array(
        *[F.struct(F.lit(i + 1).alias("level"), F.lit(float(e)).alias("eps")) for i, e in enumerate(eps)]
    )
    side = F.col("eps") / math.sqrt(2.0)
    return points.select(
        "*", F.inline(F.filter(levels, lambda lv: F.col("core") <= lv["eps"]))
    ).withColumns(
        {
            "cx": F.floor(F.col("x") / side).cast("bigint"),
            "cy": F.floor(F.col("y") / side).cast("bigint"),
        }
    )


def _box() -> list[Column]:
    return [
        F.min("x").alias("x0"),
        F.max("x").alias("x1"),
        F.min("y").alias("y0"),
        F.max("y").alias("y1"),
    ]


def _judge(pairs: DataFrame) -> DataFrame:
    """``yes`` when all points of two boxes are within eps, ``no`` when none are, else null."""

    def axis(lo: str, hi: str) -> tuple[Column, Column]:
        a0, a1, b0, b1 = (F.col(f"a.{lo}"), F.col(f"a.{hi}"), F.col(f"b.{lo}"), F.col(f"b.{hi}"))
        far = F.greatest(F.abs(a1 - b0), F.abs(b1 - a0))
        near = F.greatest(a0 - b1, b0 - a1, F.lit(0.0))
        return far, near

    far_x, near_x = axis("x0", "x1")
    far_y, near_y = axis("y0", "y1")
    far = F.sqrt(far_x * far_x + far_y * far_y)
    near = F.sqrt(near_x * near_x + near_y * near_y)
    return pairs.withColumn(
        "joined",
        F.when(far <= F.col("eps"), F.lit(True)).when(near > F.col("eps"), F.lit(False)),
    )


def _boxes(members: DataFrame, depth: int) -> DataFrame:
    """Bounding boxes of the sub-cells of each cell at ``depth`` halvings of the side."""
    scale = F.lit(float(2**depth) * math.sqrt(2.0)) / F.col("eps")
    return (
        members.withColumns(
            {
                "sx": F.floor(F.col("x") * scale).cast("bigint"),
                "sy": F.floor(F.col("y") * scale).cast("bigint"),
            }
        )
        .groupBy("cell", "sx", "sy")
        .agg(*_box())
        .withColumn("box", F.struct("x0", "x1", "y0", "y1"))
        .select("cell", "sx", "sy", "box")
    )


def _cell_edges(at_levels: DataFrame, cells: DataFrame) -> DataFrame:
    """Pairs of cells that hold two points within eps of each other.

    Boxes are compared before points: a pair of cells is settled as soon as two of its boxes lie
    wholly within eps or all lie beyond it, else its boxes are halved. Points are never paired,
    and the test is exact because a box of one point is a point.
    """
    a = cells.select("level", "eps", "cx", "cy", F.col("cell").alias("ca"), F.col("box").alias("a"))
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in _HALF])
    reach = a.select("*", F.inline(steps)).select(
        "level",
        "eps",
        "ca",
        "a",
        (F.col("cx") + F.col("dx")).alias("cx"),
        (F.col("cy") + F.col("dy")).alias("cy"),
    )
    b = cells.select("level", "cx", "cy", F.col("cell").alias("cb"), F.col("box").alias("b"))
    open_pairs = F.count_if(F.col("joined").isNull())
    judged, seen = materialize_observed(
        _judge(reach.join(b, ["level", "cx", "cy"])), "cell-pairs", open=open_pairs
    )
    edges = judged.where("joined").select("ca", "cb")
    doubtful = judged.where("joined is null")
    if not seen["open"]:
        return edges
    involved = doubtful.select(F.explode(F.array("ca", "cb")).alias("cell")).distinct()
    # A row of points stands for up to one row per level, which its table size does not show:
    # the merge hint keeps the planner from broadcasting that side.
    members = materialize(
        at_levels.hint("merge").join(
            cells.join(involved, "cell", "left_semi").select("level", "cx", "cy", "cell"),
            ["level", "cx", "cy"],
        )
        .select("cell", "eps", "x", "y")
        .distinct(),
        "cell-points",
    )
    # Sub-cell numbers at depth 0 are the cell numbers.
    numbers = cells.select("cell", F.col("cx").alias("sx"), F.col("cy").alias("sy"))
    doubtful = (
        doubtful.select("ca", "cb", "eps")
        .join(numbers.select(F.col("cell").alias("ca"), F.col("sx").alias("ax"), F.col("sy").alias("ay")), "ca")
        .join(numbers.select(F.col("cell").alias("cb"), F.col("sx").alias("bx"), F.col("sy").alias("by")), "cb")
    )
    depth = 0
    while True:
        depth += 1
        boxes = _boxes(members, depth)
        half_a = boxes.select(
            F.col("cell").alias("ca"),
            F.shiftright("sx", 1).alias("ax"),
            F.shiftright("sy", 1).alias("ay"),
            F.col("sx").alias("ax2"),
            F.col("sy").alias("ay2"),
            F.col("box").alias("a"),
        )
        half_b = boxes.select(
            F.col("cell").alias("cb"),
            F.shiftright("sx", 1).alias("bx"),
            F.shiftright("sy", 1).alias("by"),
            F.col("sx").alias("bx2"),
            F.col("sy").alias("by2"),
            F.col("box").alias("b"),
        )
        tried, seen = materialize_observed(
            _judge(doubtful.join(half_a, ["ca", "ax", "ay"]).join(half_b, ["cb", "bx", "by"])),
            "box-pairs",
            open=open_pairs,
        )
        found = tried.where("joined").select("ca", "cb").distinct()
        edges = edges.unionByName(found)
        doubtful = (
            tried.where("joined is null")
            .join(found, ["ca", "cb"], "left_anti")
            .select(
                "ca",
                "cb",
                "eps",
                F.col("ax2").alias("ax"),
                F.col("ay2").alias("ay"),
                F.col("bx2").alias("bx"),
                F.col("by2").alias("by"),
            )
        )
        if not seen["open"]:
            return edges


def _level_cells(points: DataFrame, eps: list[float]) -> DataFrame:
    """Grid cells of every level with their component: level, cx, cy, component, n, at.

    ``at`` is one point of the cell. Cells, not points, are the nodes of the graph: points that
    share a cell are within eps of each other.
    """
    at_levels = _at_levels(points, eps)
    cells = materialize(
        at_levels.groupBy("level", "eps", "cx", "cy")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("x", "y")).alias("at"), *_box())
        .select("level", "eps", "cx", "cy", "n", "at", F.struct("x0", "x1", "y0", "y1").alias("box"))
        .withColumn("cell", F.monotonically_increasing_id()),
        "level-cells",
    )
    edges = _cell_edges(at_levels, cells)
    components = connected_components(edges.select(F.col("ca").alias("src"), F.col("cb").alias("dst")))
    named = cells.join(components.withColumnRenamed("node", "cell"), "cell", "left")
    return materialize(
        named.select(
            "level", "eps", "cx", "cy", "n", "at", F.coalesce("component", "cell").alias("component")
        ),
        "level-components",
    )


def dbscan_levels(points: DataFrame, eps: list[float], min_size: int = 1) -> DataFrame:
    """Component of each core point (id, x, y, core) at each level: level, id, component.

    All levels are worked on at once. Components under ``min_size`` points are noise and left
    out; a component is named by its lowest point id.
    """
    cells = _level_cells(points, eps)
    sizes = cells.groupBy("component").agg(F.sum("n").alias("size")).where(F.col("size") >= min_size)
    kept = cells.join(sizes, "component").select("level", "cx", "cy", "component")
    members = materialize(
        _at_levels(points, eps)
        .hint("merge")
        .join(kept, ["level", "cx", "cy"])
        .select("level", "id", "component"),
        "level-members",
    )
    names = members.groupBy("component").agg(F.min("id").alias("name"))
    return members.join(names, "component").select("level", "id", F.col("name").alias("component"))


def density_clusters(points: DataFrame, min_cluster_size: int = 30) -> DataFrame:
    """Density cluster of each point (id, x, y): id, cluster; -1 is noise.

    Clusters are those of the exact hierarchy, numbered in a seeded hash order of their lowest ids. Points without
    coordinates are noise, and so is everything if no point has ``min_cluster_size`` others.
    """
    rows = points.select("id", "x", "y")
    cored = materialize(rows.join(core_distance(rows, min_cluster_size), "id"), "cored")
    noise = rows.select("id", F.lit(-1).alias("cluster"))
    if cored.isEmpty():
        return noise
    found = hierarchy_clusters(cored, min_cluster_size)
    members = materialize(cored.select("id", "x", "y").join(found, ["x", "y"]).select("id", "chosen"), "members")
    names = materialize(members.groupBy("chosen").agg(F.min("id").alias("id")), "names")
    numbers = names.join(dense_index(names.select("id"), "number"), "id").select("chosen", F.col("number").cast("int").alias("number"))
    return (
        noise.join(members, "id", "left")
        .join(numbers, "chosen", "left")
        .select("id", F.coalesce("number", "cluster").alias("cluster"))
    )
