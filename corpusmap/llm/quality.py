"""Quality from compression: a text is like the class whose dictionary shortens it more.

Two zstandard dictionaries are trained on good and on bad labelled texts. Every whole text is
cut into pieces of ``PIECE`` bytes, so that the dictionary counts as much at a text's end as at its
start, and each piece is compressed with both. With b and g bytes after the bad and the good one
and n before, the normalised differences (b - g) / (b + g) and (n - g) / (n + g) are the raw figures: which class the text is
nearer to, and how much of it is news at all. A logistic curve through the labelled rows makes them a score.

Defined cases: null is the empty text, whose figures are 0; repeated rows score alike; without labelled rows of both classes the score is the same
for every row; an empty table gives an empty result. Extra columns are neither read nor needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T

from corpusmap.llm.calibrate import fit_logistic, logistic

PIECE = 4096
#: The dictionaries are trained on at most so many rows of each class, first by md5 of the id.
SAMPLE_ROWS = 1500
#: Bytes of the samples handed to the trainer, of each class.
SAMPLE_BYTES = 8 << 20
DICTIONARY_BYTES = 65536
LEVEL = 3
_RANGES = {"_apart": (-0.6, 0.6), "_saved": (-0.6, 1.0)}


@dataclass
class QualityModel:
    good: bytes = b""
    bad: bytes = b""
    curve: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0])
    _coders: list = field(default_factory=list, repr=False)

    def __reduce__(self):
        return QualityModel, (self.good, self.bad, self.curve)

    def coders(self) -> list:
        if not self._coders:
            for raw in (self.good, self.bad):
                known = zstandard.ZstdCompressionDict(raw) if raw else None
                if known:
                    known.precompute_compress(level=LEVEL)
                self._coders.append(
                    zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False)
                )
        return self._coders


def _pieces(raw: bytes) -> list[bytes]:
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


def _train(texts: list[str]) -> bytes:
    pieces = [p for t in texts for p in _pieces(t.encode())]
    size = sum(map(len, pieces))
    try:
        return zstandard.train_dictionary(
            max(256, min(DICTIONARY_BYTES, size // 4)), pieces, k=256, d=8
        ).as_bytes()
    except zstandard.ZstdError:  # too few samples for the trainer: they are the dictionary
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def _figures(texts: pa.Array, model: QualityModel) -> tuple[list[float], list[float]]:
    """Both figures of every text of a batch."""
    good, bad = model.coders()
    apart, saved = [], []
    for text in texts:
        raw = text.as_buffer().to_pybytes() if text.is_valid else b""
        pieces = _pieces(raw)
        b = sum(len(bad.compress(p)) for p in pieces)
        g = sum(len(good.compress(p)) for p in pieces)
        apart.append((b - g) / (b + g) if raw else 0.0)
        saved.append((len(raw) - g) / (len(raw) + g) if raw else 0.0)
    return apart, saved


def differences(rows: DataFrame, model: QualityModel) -> DataFrame:
    """``rows`` with the raw figures of their column ``text`` instead of it."""
    kept = [c for c in rows.columns if c != "text"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pa.array(f, pa.float64()) for f in _figures(batch.column("text"), model)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], [*kept, *_RANGES])

    fields = T.StructType([f for f in rows.schema if f.name != "text"])
    for name in _RANGES:
        fields = fields.add(name, "double")
    return rows.mapInArrow(measure, fields)


def fit(labelled: DataFrame) -> QualityModel:
    """Model from (doc_id, text, label 0/1): dictionaries from a bounded sample, curve from all rows."""
    model = QualityModel()
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    texts = {}
    for label in (0, 1):
        rows = (
            labelled.where((F.col("label") == label) & (F.length("text") > 0))
            .orderBy(order, F.md5("text"))
            .limit(SAMPLE_ROWS)
            .select("text")
            .toLocalIterator()
        )
        got, size = [], 0
        for r in rows:
            size += len(r["text"])
            if size > SAMPLE_BYTES and got:
                break
            got.append(r["text"])
        texts[label] = got
    if texts[0] and texts[1]:
        model.good, model.bad = _train(texts[1]), _train(texts[0])
        model.curve = fit_logistic(differences(labelled.select("label", "text"), model), _RANGES, 80)
    else:
        flat = labelled.select("label", *(F.lit(0.0).alias(name) for name in _RANGES))
        model.curve = fit_logistic(flat, _RANGES)
    return model


def score(rows: DataFrame, model: QualityModel) -> DataFrame:
    """``rows`` with ``score`` (higher: good is likelier) instead of their column ``text``."""
    if not model.good:
        return rows.withColumn("score", logistic([], model.curve[:1])).drop("text")
    figures = [F.col(name) for name in _RANGES]
    return differences(rows, model).withColumn("score", logistic(figures, model.curve)).drop(*_RANGES)


def keep(docs: DataFrame, model: QualityModel, threshold: float) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``; all columns stay, nothing is shuffled."""
    at = docs.columns.index("text")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.full(batch.num_rows, model.curve[0])
            if model.good:
                for slope, figure in zip(model.curve[1:], _figures(batch.column(at), model), strict=True):
                    total += slope * np.array(figure)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))) >= threshold))

    return docs.mapInArrow(pick, docs.schema)
