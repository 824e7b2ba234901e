"""Quality classification by compression under a dictionary of good and one of bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, zstd_models


#: Small block and high level: short blocks keep the dictionary in play, and the two alphabets of shapes are few bytes.
LEVEL, BLOCK = 12, 300
#: A byte's shape: letters of either case become one letter each, digits one digit; marks and white space stay.
SHAPES = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))


@dataclass(frozen=True)
class QualityModel:
    bad: bytes
    good: bytes
    #: Of the normalised size difference, and the bias.
    weights: tuple[float, float]


def prepared(text: str | None) -> bytes:
    """Quality shows in how text is laid out more than in its words, so its shape is compressed."""
    return (text or "").encode().translate(SHAPES)


def difference(texts: list[bytes], sizes: zstd_models.SizeBy) -> np.ndarray:
    """(bad - good) / (bad + good) of the compressed sizes, positive where good text explains it better."""
    s = sizes(texts)
    return (s[:, 0] - s[:, 1]) / np.maximum(s.sum(axis=1), 1)


def scores(texts: list[str | None], sizes: zstd_models.SizeBy, weights: tuple[float, float]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    z = difference([prepared(t) for t in texts], sizes) * weights[0] + weights[1]
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_quality(labelled: DataFrame, label: str = "quality", rows_per_class: int = 1500, bytes_per_class: int = 128_000, calibrate_rows: int = 3000) -> QualityModel:
    """Learns from doc_id, text and a 0/1 label column; rows with a null label or text are no examples.

    Dictionaries take at most bytes_per_class of each class, and calibration at most calibrate_rows of other rows, in
    their natural shares: the model and what the driver sees have a fixed bound.
    """
    rows = labelled.where(f"{label} in (0, 1) and text is not null").select("doc_id", "text", F.col(label).cast("int").alias("_y"))
    fold = F.crc32(F.concat(F.lit("fold"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) % 2
    texts = zstd_models.training_texts(rows.where(fold == 0), "_y", rows_per_class, 2 * bytes_per_class)
    bad, good = (zstd_models.dictionary([prepared(t) for t in texts.get(k, [])], bytes_per_class) for k in (0, 1))
    ids = common.pick_ids(rows.where(fold == 1).withColumn("_all", F.lit(1)), "_all", calibrate_rows)
    sample = rows.where(fold == 1).join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = zstd_models.SizeBy([bad, good], LEVEL, BLOCK)
        for batch in batches:
            if batch.num_rows:
                x = difference([prepared(t) for t in batch.column("text").to_pylist()], sizes)
                yield pa.RecordBatch.from_arrays([pa.array(x), batch.column("_y")], names=["x", "y"])

    seen = common.arrow_map(sample.select("text", "_y"), measure, "x double, y int").collect()
    x, y = np.array([r.x for r in seen]).reshape(-1, 1), np.array([r.y for r in seen], dtype=float)
    scale = float(x.std()) if len(x) and x.std() > 0 else 1.0
    w = zstd_models.fit_logistic(x / scale, y)
    return QualityModel(bad, good, (float(w[0]) / scale, float(w[1])))


_SCHEMA = "doc_id long, score double"


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """One row per row of docs: doc_id and score, 0 to 1, higher where the label is likelier 1.

    Only doc_id and text are read, and texts are compressed whole. Null counts as empty; empty texts get the
    score of an empty block. Equal texts get equal scores. An empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast((model.bad, model.good, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good, weights = held.value
        sizes = zstd_models.SizeBy([bad, good], LEVEL, BLOCK)
        for batch in batches:
            score = scores(batch.column("text").to_pylist(), sizes, weights)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _SCHEMA)


def filter_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least threshold. A null text counts as empty and is
    scored as such; rows that repeat are kept or dropped together; an empty table gives an empty result."""
    held = docs.sparkSession.sparkContext.broadcast((model.bad, model.good, model.weights))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good, weights = held.value
        sizes = zstd_models.SizeBy([bad, good], LEVEL, BLOCK)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at).to_pylist(), sizes, weights) >= threshold))

    return common.arrow_map(docs, run, docs.schema)
