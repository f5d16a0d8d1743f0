"""Scores in [0, 1] from one raw figure: a logistic curve through all labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from corpusmap.functions.ordering import hash_key, hash_unit
from corpusmap.sources.scratch import materialize

BINS = 400
#: Models are fitted on about so many labelled rows, chosen by a hash of the id; all of them if fewer.
SAMPLE_ROWS = 40_000


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def row_labels(labels: DataFrame, name: str) -> DataFrame:
    """One row per doc_id: (doc_id, label). Ids whose labels disagree, and nulls, are left out."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(name).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(name).alias("label"), F.max(name).alias("_other"))
        .where("label = _other")
        .select("doc_id", "label")
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, label) of about ``rows`` labelled documents, as a written table.

    Only the chosen ids travel, so the texts are read once and never shuffled.
    """
    total = labels.count()
    if total > rows:
        labels = labels.where(hash_unit(hash_key(F.col("doc_id"), 11)) < rows / total)
    chosen = F.broadcast(labels)  # about ``rows`` narrow rows, by the line above
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return materialize(texts.join(chosen, "doc_id"), "labelled")


def labelled(docs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """Sample of the rows that may be learned from, those with crc32(doc_id) mod 5 not 0."""
    train = labels.where(~held_out(F.col("doc_id"), 5, 0))
    return labelled_sample(docs, row_labels(train, name))


def fit_logistic(rows: DataFrame, ranges: dict[str, tuple[float, float]], bins: int = BINS) -> list[float]:
    """[intercept, slope of each figure] of label ~ figures. Rows are counted in bins of every figure's
    range first, so the driver gets a table of bounded size. With one class only, or none, the curve is flat.
    """
    places = []
    for name, (low, high) in ranges.items():
        inside = F.least(F.greatest(F.col(name), F.lit(low)), F.lit(high))
        places.append(F.floor((inside - low) / ((high - low) / bins)).alias(name))
    counts = rows.groupBy(*places, "label").agg(F.count(F.lit(1)).alias("n")).collect()
    flat = [0.0] * len(ranges)
    if not counts:
        return [0.0, *flat]
    x = np.array(
        [[low + (r[c] + 0.5) * (high - low) / bins for r in counts] for c, (low, high) in ranges.items()]
    )
    y = np.array([float(r["label"]) for r in counts])
    n = np.array([float(r["n"]) for r in counts])
    share = (n @ y + 0.5) / (n.sum() + 1.0)
    b = np.array([np.log(share / (1 - share)), *flat])
    if len(set(y)) < 2:
        return [float(b[0]), *flat]
    centre = x @ n / n.sum()
    spread = np.maximum(np.sqrt((x - centre[:, None]) ** 2 @ n / n.sum()), 1e-9)
    z = np.vstack([np.ones_like(y), (x - centre[:, None]) / spread[:, None]])
    ridge = np.diag([1e-6, *[1e-2] * len(ranges)])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(b @ z, -35, 35)))
        step = np.linalg.solve((z * (n * p * (1 - p))) @ z.T + ridge, z @ (n * (y - p)) - ridge @ b)
        b = b + np.clip(step, -4, 4)
        if abs(step).max() < 1e-9:
            break
    slopes = b[1:] / spread
    return [float(b[0] - slopes @ centre), *map(float, slopes)]


def logistic(figures: list[Column], curve: list[float]) -> Column:
    """The fitted curve as a column; never null."""
    total = F.lit(curve[0])
    for x, slope in zip(figures, curve[1:], strict=True):
        total = total + x * slope
    return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), total))))
