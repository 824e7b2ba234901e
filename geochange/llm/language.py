"""Language identification by compression: the language whose dictionary codes the text in fewest bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, zstd_models

#: A text has a letter if this finds one; numbers such as those in circles or fractions are none.
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: What is neither a letter nor a mark on one says little about a language; a run of it becomes one space. The second is
#: the same for texts without other letters.
NO_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
NO_ASCII_LETTERS = re.compile(r"[^a-z]+")
LEVEL, BLOCK = 6, 2000


def prepared(text: str) -> bytes:
    """Letters in lower case with their marks, such as vowel signs and accents that are code points of their own."""
    low = text.lower()
    return (NO_ASCII_LETTERS if low.isascii() else NO_LETTERS).sub(" ", low).encode()


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    #: Turns how much larger the other sizes are, as shares of the smallest, into chances.
    sharpness: float = 60.0


def chances(sizes: np.ndarray, sharpness: float) -> np.ndarray:
    """The chance of each language, column by column, from its compressed sizes."""
    low = sizes.min(axis=1, keepdims=True)
    e = np.exp(np.maximum(-sharpness * (sizes - low) / low, -700))
    return e / e.sum(axis=1, keepdims=True)


def fit_language(labelled: DataFrame, rows_per_language: int = 400, bytes_per_language: int = 32_000, calibrate_rows: int = 2000) -> LanguageModel:
    """Learns from doc_id, text and lang of labelled; rows with a null lang or text are no examples.

    The sample for dictionaries is bounded by the first two parameters for each language, so the model has a fixed size
    however many rows there are. The sharpness of the score is that of most likelihood for calibrate_rows other rows.
    """
    spark = labelled.sparkSession
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    fold = F.crc32(F.concat(F.lit("lang"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) % 8
    texts = zstd_models.training_texts(rows.where(fold > 0), "lang", rows_per_language, 2 * bytes_per_language)
    # A row for each language, as the model has a dictionary for each.
    share = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = tuple(sorted(texts, key=lambda x: (-share[x], x)))
    packs = tuple(zstd_models.dictionary([prepared(t) for t in texts[x]], bytes_per_language) for x in names)
    if len(names) < 2:
        return LanguageModel(names, packs)
    ids = common.pick_ids(rows.where(fold == 0).withColumn("_all", F.lit(1)), "_all", calibrate_rows)
    held = spark.sparkContext.broadcast((names, packs))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, raw = held.value
        sizes = zstd_models.SizeBy(raw, LEVEL, BLOCK)
        for batch in batches:
            seen = [(prepared(t), known.index(x)) for t, x in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True) if x in known and LETTER.search(t)]
            found = sizes([t for t, _ in seen])
            yield pa.RecordBatch.from_arrays([pa.array(found.tolist(), pa.list_(pa.float64())), pa.array([y for _, y in seen], pa.int32())], names=["s", "y"])

    seen = common.arrow_map(rows.where(fold == 0).join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi").select("text", "lang"), measure, "s array<double>, y int").collect()
    if not seen:
        return LanguageModel(names, packs)
    s, y = np.array([r.s for r in seen]), np.array([r.y for r in seen])
    steps = np.geomspace(1, 1000, 61)
    # A small charge on sharpness keeps the score from certainty where the sample has no error.
    loss = [-np.log(np.maximum(chances(s, k)[np.arange(len(y)), y], 1e-12)).sum() + k * 0.01 for k in steps]
    return LanguageModel(names, packs, float(steps[int(np.argmin(loss))]))


_SCHEMA = "doc_id long, lang_pred string, score double, margin double, rejected boolean"


def identify_language(docs: DataFrame, model: LanguageModel, min_margin: float = 0.01) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score, margin, rejected.

    lang_pred is the language with the smallest compressed size (ties: the one with more examples, then the first by name); und where the text is null, has
    no letter, or nothing was learned. margin is how much larger the runner-up is, as a share of the smallest;
    rejected marks margins under min_margin and und. score is between 0 and 1, 0 for und; with one learned language
    it is 1. Only doc_id and text are read; texts are compressed whole. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((model.languages, model.dictionaries, model.sharpness))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, raw, sharp = held.value
        sizes = zstd_models.SizeBy(raw, LEVEL, BLOCK)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = len(texts)
            known = np.array([bool(names) and t is not None and LETTER.search(t) is not None for t in texts], dtype=bool)
            pred, score, margin = [UNKNOWN] * n, np.zeros(n), np.zeros(n)
            at = np.flatnonzero(known)
            if len(at):
                data = [prepared(texts[i]) for i in at]
                s = sizes(data)
                best = s.argmin(axis=1)
                for i, b in zip(at, best, strict=True):
                    pred[i] = names[b]
                low = s.min(axis=1, keepdims=True)
                score[at] = chances(s, sharp).max(axis=1)
                second = np.partition(s, 1, axis=1)[:, 1] if len(names) > 1 else np.full(len(at), np.inf)
                margin[at] = np.minimum(second / low[:, 0] - 1, 1e9)
            no = ~known | (margin < min_margin)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred), pa.array(score), pa.array(margin), pa.array(no)], names=["doc_id", "lang_pred", "score", "margin", "rejected"])

    return common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _SCHEMA)
