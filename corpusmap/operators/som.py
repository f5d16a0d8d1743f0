"""Self-organizing map: batch training, assignment, U-matrix, cell views.

The codebook has a fixed number of neurons whatever the data, so it may live on the driver and
travel to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusmap.functions.ordering import hash_key
from corpusmap.functions.text import truncate
from corpusmap.sources.scratch import materialize

CODEBOOK = "som_x int, som_y int, weights array<double>"


def _codebook_rows(codebook: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = codebook.orderBy("som_x", "som_y").collect()  # the grid's size is the caller's choice
    places = np.array([(r["som_x"], r["som_y"]) for r in rows], dtype=np.int32)
    return places, np.array([r["weights"] for r in rows], dtype=np.float64)


def _nearest(vectors: pd.Series, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
    squared = (m * m).sum(1)[:, None] + (weights * weights).sum(1)[None, :] - 2.0 * (m @ weights.T)
    best = squared.argmin(axis=1)
    return m, best, np.sqrt(np.maximum(squared[np.arange(len(m)), best], 0.0))


def som_assign(df: DataFrame, codebook: DataFrame, vec: str = "embedding") -> DataFrame:
    """Best-matching neuron of each row: id, som_x, som_y, error. The first neuron wins a tie."""
    places, weights = _codebook_rows(codebook)
    id_type = df.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            _, best, error = _nearest(frame["vec"], weights)
            yield pd.DataFrame(
                {
                    "id": frame["id"],
                    "som_x": places[best, 0],
                    "som_y": places[best, 1],
                    "error": error,
                }
            )

    return df.select("id", F.col(vec).alias("vec")).mapInPandas(
        run, f"id {id_type}, som_x int, som_y int, error double"
    )


def _neuron_sums(rows: DataFrame, weights: np.ndarray) -> list:
    """Sum and count of the rows of each neuron; summed per batch before the shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros_like(weights), np.zeros(len(weights))
        for frame in frames:
            if frame.empty:
                continue
            m, best, _ = _nearest(frame["vec"], weights)
            np.add.at(sums, best, m)
            counts += np.bincount(best, minlength=len(weights))
        hit = np.flatnonzero(counts)
        yield pd.DataFrame({"neuron": hit, "total": list(sums[hit]), "n": counts[hit]})

    return (
        rows.mapInPandas(run, "neuron int, total array<double>, n double")
        .groupBy("neuron")
        .agg(
            vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"),
            F.sum("n").alias("n"),
        )
        .collect()
    )


def som_train(
    df: DataFrame,
    gx: int = 30,
    gy: int = 20,
    sigma: float = 1.5,
    epochs: int = 10,
    seed: int = 42,
    vec: str = "embedding",
) -> DataFrame:
    """Codebook of a batch self-organizing map, trained on all rows.

    Start weights are the first rows in seeded order. Each epoch assigns all training rows and
    moves each neuron to the mean of its Gaussian neighbourhood, whose width ends at ``sigma``.
    """
    rows = materialize(df.select("id", F.col(vec).alias("vec")), "som-rows")
    n = gx * gy
    first = [
        np.asarray(r["vec"], dtype=np.float64)
        for r in rows.orderBy(hash_key(F.col("id"), seed), "id").limit(n).collect()
    ]
    if not first:
        raise ValueError("no vectors to train on")
    weights = np.array([first[i % len(first)] for i in range(n)])
    # The Gaussian of a grid distance is the product of one along x and one along y.
    along = [np.subtract.outer(np.arange(g), np.arange(g)).astype(np.float64) ** 2 for g in (gx, gy)]
    wide = max(gx, gy) / 4.0
    for epoch in range(epochs):
        share = epoch / max(epochs - 1, 1)
        width = max(sigma, wide * (sigma / wide) ** share)
        kx, ky = (np.exp(-squares / (2.0 * width * width)) for squares in along)
        sums, counts = np.zeros_like(weights), np.zeros(n)
        for r in _neuron_sums(rows, weights):
            sums[r["neuron"]], counts[r["neuron"]] = r["total"], r["n"]
        mass = (kx @ counts.reshape(gx, gy) @ ky.T).reshape(n)
        pulled = np.einsum("ab,bcd,ec->aed", kx, sums.reshape(gx, gy, -1), ky, optimize=True)
        moved = mass > 1e-12
        weights[moved] = pulled.reshape(n, -1)[moved] / mass[moved, None]
    data = [(int(i // gy), int(i % gy), [float(w) for w in weights[i]]) for i in range(n)]
    return df.sparkSession.createDataFrame(data, CODEBOOK)


def som_umatrix(codebook: DataFrame) -> DataFrame:
    """Sum of distances of each neuron to its up to 8 neighbours, divided by the largest sum."""
    around = [
        F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
        for dx in (-1, 0, 1)
        for dy in (-1, 0, 1)
        if (dx, dy) != (0, 0)
    ]
    steps = codebook.select("*", F.inline(F.array(*around)))
    here = steps.select(
        "som_x",
        "som_y",
        "weights",
        (F.col("som_x") + F.col("dx")).alias("nx"),
        (F.col("som_y") + F.col("dy")).alias("ny"),
    )
    there = codebook.select(
        F.col("som_x").alias("nx"), F.col("som_y").alias("ny"), F.col("weights").alias("other")
    )
    gap = F.sqrt(
        F.aggregate(
            F.zip_with("weights", "other", lambda a, b: (a - b) * (a - b)),
            F.lit(0.0),
            lambda s, v: s + v,
        )
    )
    sums = (
        here.join(there, ["nx", "ny"], "left")
        .groupBy("som_x", "som_y")
        .agg(F.coalesce(F.sum(gap), F.lit(0.0)).alias("total"))
    )
    largest = sums.select(F.max("total")).scalar()
    return sums.select(
        "som_x",
        "som_y",
        F.when(largest > 0, F.col("total") / largest).otherwise(F.lit(0.0)).alias("distance"),
    )


def round4(column: Column) -> Column:
    """Four decimals, for display."""
    return F.round(column, 4)


def som_grid(spark: SparkSession, gx: int, gy: int) -> DataFrame:
    """All cells of the map."""
    return spark.range(gx * gy).select(
        F.expr(f"cast(id div {gy} as int)").alias("som_x"),
        F.expr(f"cast(id % {gy} as int)").alias("som_y"),
    )


def som_density(assignment: DataFrame, gx: int, gy: int) -> DataFrame:
    """Rows per cell, with zeros."""
    counts = assignment.groupBy("som_x", "som_y").agg(F.count(F.lit(1)).alias("n"))
    return (
        som_grid(assignment.sparkSession, gx, gy)
        .join(counts, ["som_x", "som_y"], "left")
        .select("som_x", "som_y", F.coalesce("n", F.lit(0)).alias("density"))
    )


def attach_som(records: DataFrame, assignment: DataFrame) -> DataFrame:
    """Records with the neuron of each."""
    return records.join(assignment.select("id", "som_x", "som_y"), "id")


def som_points_with_cluster(sample: DataFrame, points: DataFrame) -> DataFrame:
    """Sampled records (id, som_x, som_y, title, year) with the cluster of each; -1 without one."""
    return sample.join(points.select("id", "cluster"), "id", "left").select(
        "id",
        "som_x",
        "som_y",
        F.coalesce("cluster", F.lit(-1)).alias("cluster"),
        truncate(F.coalesce("title", F.lit("")), 120).alias("title"),
        F.col("year").cast("int").alias("year"),
    )


def som_cell_details(
    umatrix: DataFrame, density: DataFrame, points: DataFrame, seed: int = 42
) -> DataFrame:
    """Per cell: distance, density and the first sample point in seeded order."""
    first = points.groupBy("som_x", "som_y").agg(
        F.min_by(
            F.struct("title", "year", "cluster"), F.struct(hash_key(F.col("id"), seed), "id")
        ).alias("point")
    )
    return (
        umatrix.join(density, ["som_x", "som_y"], "left")
        .join(first, ["som_x", "som_y"], "left")
        .select(
            "som_x",
            "som_y",
            round4(F.col("distance")).alias("distance"),
            F.coalesce("density", F.lit(0)).alias("density"),
            "point.title",
            "point.year",
            "point.cluster",
        )
    )
