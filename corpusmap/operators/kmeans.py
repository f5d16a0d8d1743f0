"""k-means inside every group at once."""

from __future__ import annotations

from itertools import count

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from corpusmap.functions.ordering import hash_key
from corpusmap.sources.scratch import materialize, materialize_observed


def _squared(c: Column) -> Column:
    dx, dy = F.col("x") - c["x"], F.col("y") - c["y"]
    return dx * dx + dy * dy


def start_centres(points: DataFrame, group: str, k: int = 3, seed: int = 42) -> DataFrame:
    """``k`` start centres per group: the first row in seeded order, then farthest rows in turn.

    One row per group, ``centres`` an array in order of choice; a group with fewer distinct
    points has fewer centres.
    """
    here = F.struct("x", "y")
    first = F.min_by(here, F.struct(hash_key(F.col("id"), seed), "id"))
    # Written, the few centres have a known size, so the points need not be shuffled to meet them.
    chosen = materialize(points.groupBy(group).agg(F.array(first).alias("centres")), "centres")
    for _ in range(k - 1):
        spread = points.join(chosen, group).withColumn(
            "gap", F.array_min(F.transform("centres", _squared))
        )
        farthest = (
            spread.where("gap > 0")
            .groupBy(group)
            .agg(F.min_by(here, F.struct(-F.col("gap"), hash_key(F.col("id"), seed), "id")).alias("next"))
        )
        chosen = materialize(
            chosen.join(farthest, group, "left").select(
                group,
                F.when(F.col("next").isNull(), F.col("centres"))
                .otherwise(F.concat("centres", F.array("next")))
                .alias("centres"),
            ),
            "centres",
        )
    return chosen


def assign_centres(points: DataFrame, centres: DataFrame, group: str) -> DataFrame:
    """Number of the nearest centre of the own group, lowest number on a tie, as ``sub``.

    The points keep their partitioning when the centre table is small enough for the planner
    to broadcast; otherwise adaptive execution splits a hot group.
    """
    nearest = F.array_min(
        F.transform("centres", lambda c, i: F.struct(_squared(c).alias("d"), i.alias("sub")))
    )["sub"]
    return points.join(centres, group).select(points["*"], nearest.alias("sub"))


def update_centres(assigned: DataFrame, group: str) -> DataFrame:
    """Mean point of each (group, sub), numbered again by x, y."""
    means = assigned.groupBy(group, "sub").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return means.groupBy(group).agg(
        F.sort_array(F.collect_list(F.struct("x", "y"))).alias("centres")
    )


#: Groups up to which the centres pass through the driver from round to round; those of more are written.
SENT_GROUPS = 50_000


def _next_centres(points: DataFrame, centres: DataFrame, group: str, k: int) -> DataFrame:
    """A round: the centres of :func:`update_centres` after :func:`assign_centres`, and those ``before``.

    One exchange of partial sums by group; a centre that got no point ends.
    """
    nearest = F.array_min(
        F.transform("centres", lambda c, i: F.struct(_squared(c).alias("d"), i.alias("sub")))
    )["sub"]
    assigned = points.join(centres, group).select(group, "x", "y", F.col("centres").alias("before"), nearest.alias("sub"))
    sums = []
    for sub in range(k):
        mine = F.col("sub") == sub
        sums += [F.count_if(mine).alias(f"n{sub}"), *[F.avg(F.when(mine, F.col(c))).alias(f"{c}{sub}") for c in ("x", "y")]]
    found = assigned.groupBy(group).agg(F.any_value("before").alias("before"), *sums)
    held = [F.struct(F.col(f"n{i}").alias("n"), F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in range(k)]
    means = F.transform(F.filter(F.array(*held), lambda c: c["n"] > 0), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))
    return found.select(group, F.sort_array(means).alias("centres"), "before")


def grouped_kmeans(
    points: DataFrame,
    group: str = "cluster",
    k: int = 3,
    iters: int | None = None,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Lloyd's algorithm in every group at once, until no centre moves or for ``iters`` rounds.

    Returns the points (id, group, x, y) with ``sub``, and the centres, one row per group.
    """
    # Every round reads the points: as a table of their own they are four columns, whatever they come from.
    narrow = materialize(points.select("id", group, "x", "y"), "points")
    centres = start_centres(narrow, group, k, seed)
    few = centres.count() <= SENT_GROUPS
    moved = F.col("centres") != F.col("before")
    for _ in range(iters) if iters is not None else count():
        if few:
            found = _next_centres(narrow, F.broadcast(centres), group, k).withColumn("moved", moved).toArrow()
            centres = narrow.sparkSession.createDataFrame(found.select([group, "centres"]), centres.schema)
            some = pc.any(found.column("moved")).as_py()
        else:
            found, seen = materialize_observed(_next_centres(narrow, centres, group, k), "centres", moved=F.count_if(moved))
            centres, some = found.select(group, "centres"), seen["moved"]
        if not some:
            break
    return assign_centres(narrow, centres, group), centres
