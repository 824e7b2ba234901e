"""Exact duplicates by a content sort.

Sampled splitters deal the rows out by the range of their normalised bytes, each range is sorted on disk if need be,
and one pass over it compares neighbours in full. The order is that of the leading bytes; texts that agree in these
are in the order of a hash, then of all bytes. It ends with doc_id, so that a group of equal texts of any
size is cut into as many ranges as it needs; the pieces of a group that touch the ends of ranges are joined from one
small row each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Leading characters that splitters hold; the sample of them that the driver sees stays small however long texts are.
SPLIT_CHARS = 48

_ROWS = "doc_id long, text_sha256 string, keep_id long, group_size long, edge string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("edge", pa.string())])


def normalised(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _runs(keep: str):
    best = min if keep == "smallest" else max

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, first, out = None, [], True, []

        def end(edge: str) -> None:
            known = [x for x in ids if x is not None]
            digest = hashlib.sha256(last.encode()).hexdigest()
            top = best(known) if known else None
            out.extend((x, digest, top, len(ids), edge) for x in ids)

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            for text, x in zip(batch.column("_norm").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
                if text != last or last is None:
                    if last is not None:
                        end("edge" if first else "")
                        first = False
                    last, ids = text, []
                ids.append(x)
            if len(out) >= 4096:
                yield block()
                out.clear()
        if last is not None:
            end("edge")
        if out:
            yield block()

    return neighbours


def exact_dedup(docs: DataFrame, keep: str = "smallest", partitions: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, text_sha256, keep_id, group_size, kept.

    docs needs doc_id and text; other columns, whatever their names, are not read. Texts are equal if they agree after
    A-Z are lower-cased; null counts as empty, and empty texts form one group. Of equal texts the row with the
    smallest (or largest) doc_id stays; rows that repeat the kept doc_id in a group are all marked as kept.
    A null doc_id stays only where its group has no other. An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    spark = docs.sparkSession
    n = partitions or common.shuffle_parts(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("_norm"))
    keyed = rows.select("doc_id", "_norm", F.substring("_norm", 1, SPLIT_CHARS).alias("_lead"), F.xxhash64("_norm").alias("_h"))
    # The hash parts texts with one lead; equal texts stay neighbours, in the order of doc_id.
    dealt = keyed.repartitionByRange(n, "_lead", "_h", "doc_id").sortWithinPartitions("_lead", "_h", "_norm", "doc_id")
    runs = common.written(common.arrow_map(dealt.select("doc_id", "_norm"), _runs(keep), _ROWS), "runs")
    # All rows of a group that goes over the end of a range are marked as edge; at most two such groups a range.
    best = (F.min if keep == "smallest" else F.max)("keep_id")
    whole = runs.where("edge = 'edge'").groupBy("text_sha256").agg(best.alias("_keep"), F.count("*").alias("_size"))
    out = runs.join(F.broadcast(whole), "text_sha256", "left")
    keep_id, size = F.coalesce("_keep", "keep_id"), F.coalesce("_size", "group_size")
    return out.select("doc_id", "text_sha256", keep_id.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"))
