"""Compression with raw-content dictionaries, shared by language identification and the quality classifier."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


def training_texts(labelled: DataFrame, by: str, rows_per_class: int, bytes_per_class: int) -> dict[object, list[str]]:
    """A bounded sample of texts for each value of column by, to learn from: at most rows_per_class rows, and no row
    that begins beyond bytes_per_class. Of a text over a fourth of that, a piece of as many characters from its middle
    is taken, so that a class of long texts alone has its examples too. labelled: doc_id, text and by; equal texts
    count once."""
    ids = F.broadcast(common.pick_ids(labelled, by, rows_per_class).select("doc_id"))  # bounded: rows_per_class ids a class
    room = bytes_per_class // 8  # characters, mostly of one or two bytes
    begin = F.greatest(F.floor((F.length("text") - room) / 2).cast("int"), F.lit(0)) + 1
    # By doc_id alone Spark can cut the texts down to the sample below the join with the labels.
    rows = labelled.join(ids, "doc_id", "left_semi").where("length(text) > 0").select(by, F.substring("text", begin, F.lit(room)).alias("text"), F.xxhash64("doc_id").alias("_h"))
    rows = rows.withColumn("_b", F.octet_length("text"))
    order = Window.partitionBy(by).orderBy("_h", "text")
    fits = rows.dropDuplicates([by, "text"]).withColumn("_sum", F.sum("_b").over(order)).where(F.col("_sum") - F.col("_b") < bytes_per_class)
    found: dict[object, list[str]] = {}
    for value, text in fits.orderBy(by, "_h", "text").select(by, "text").collect():
        found.setdefault(value, []).append(text)
    return found


class SizeBy:
    """Compressed sizes of texts under one dictionary per class; made in each Python worker from the raw dictionaries.

    Texts are compressed whole, in blocks of a fixed size each started from the dictionary: in one long block a text
    would soon be coded from its own past, and the dictionary would no longer tell the classes apart.
    """

    def __init__(self, raw: Sequence[bytes], level: int, block: int):
        self.block, self.packers = block, []
        for content in raw:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            self.packers.append(zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, texts: Sequence[bytes]) -> np.ndarray:
        out, k = np.empty((len(texts), len(self.packers)), dtype=np.float64), self.block
        for j, packer in enumerate(self.packers):
            pack = packer.compress
            out[:, j] = [sum(len(pack(t[i : i + k])) for i in range(0, max(len(t), 1), k)) for t in texts]
        return out


def dictionary(texts: Sequence[bytes], size: int) -> bytes:
    """Raw content: whole texts joined by newlines, as many as fit into size bytes; never under the 8 bytes that zstd asks for."""
    out = b""
    for t in texts:
        if len(out) + len(t) < size:
            out += t + b"\n"
    return out if len(out) >= 8 else out + b"\n" * 8


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Weights with the bias last, by Newton steps with a small ridge; one class alone gives its smoothed share."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        w[-1] = np.log(share / (1 - share))
        return w
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-9])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w
