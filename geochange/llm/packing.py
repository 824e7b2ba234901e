"""Packing token pieces into sequences of one capacity by best two fit.

A bin is filled greedily, always with the largest piece that fits. Then its smallest piece is given back if two unpacked
pieces fill the gap that this leaves more tightly, of all such two the tightest.

Only lengths matter to this, and there are no more of them than the capacity: the driver plans with the number of pieces
of each length. A bin that comes out like the one before it, as long as no length that it is made with runs short, is
planned once with how often it is repeated. The pieces are then numbered within their length, where they lie, and each
finds its sequence and place by that number in a table of the plan's slots.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, common


@dataclass(frozen=True)
class Packing:
    """capacity: tokens of a sequence at most; end: the id after each document. Capacities beyond 2^20 are refused, as
    the plan's size is bounded by it."""

    capacity: int = 2048
    end: int = 0

    def __post_init__(self):
        if not 1 <= self.capacity <= 2**20:
            raise ValueError("capacity must be from 1 to 2^20")


def two_that_fit(lengths: np.ndarray, counts: np.ndarray, room: int) -> tuple[int, int] | None:
    """Of lengths (rising, counts each over 0) two pieces with the largest sum that fits into room: the one with the
    longest piece among equals. One length serves twice if it has two pieces."""
    a = lengths[: bisect_right(lengths, room - 1)]
    if not len(a):
        return None
    b = np.searchsorted(lengths, room - a, side="right") - 1  # the largest that fits beside each
    alone = (b >= 0) & (lengths[b] == a) & (counts[b] < 2)
    b = np.where(alone, b - 1, b)
    total = np.where(b >= 0, a + lengths[b], -1)
    best = len(total) - 1 - int(total[::-1].argmax())
    return (int(a[best]), int(lengths[b[best]])) if total[best] > 0 else None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins and how often each is repeated, of counts[length] pieces; lengths of a bin fall. The plan's size grows with
    the capacity, not with the pieces: a bin is repeated until a length that it was made with runs short."""
    if any(n > 0 and not 1 <= k <= capacity for k, n in counts.items()):
        raise ValueError("lengths must be from 1 to the capacity")
    left = np.zeros(capacity + 1, dtype=np.int64)
    for k, n in counts.items():
        left[k] = max(n, 0)
    lengths = np.flatnonzero(left).tolist()
    out: list[tuple[list[int], int]] = []
    while lengths:
        used: Counter[int] = Counter()
        gap, top = capacity, len(lengths)
        while top := bisect_right(lengths, gap, 0, top):
            k = lengths[top - 1]
            take = min(gap // k, int(left[k]))
            used[k] += take
            gap -= take * k
            top -= 1
        need = Counter(used)
        if gap:
            small = min(used)
            after = left.copy()
            for k, n in used.items():
                after[k] -= n
            free = np.flatnonzero(after[: gap + small])
            found = two_that_fit(free, after[free], gap + small)
            if found and sum(found) > small:
                used[small] -= 1
                used.update(found)
                need.update(found)
        # The next bin comes out like this one as long as all that this one was made with is there again.
        times = 1 + min((int(left[k]) - need[k]) // n for k, n in used.items() if n)
        out.append((sorted((+used).elements(), reverse=True), times))
        for k, n in used.items():
            left[k] -= n * times
        if any(not left[k] for k in used):
            lengths = np.flatnonzero(left).tolist()
    return out


@dataclass(frozen=True)
class Slots:
    """Of each run of pieces of one length, in order of (length, first): its first number within the length, the first
    sequence, the pieces that a sequence takes of it, and the place of the first of these."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.empty(len(length), dtype=np.int64)
        for k in np.unique(length):
            own = length == k
            low, high = np.searchsorted(self.length, [k, k + 1])
            at[own] = low + np.searchsorted(self.first[low:high], number[own], side="right") - 1
        within = number - self.first[at]
        return self.sequence[at] + within // self.each[at], self.offset[at] + within % self.each[at] * length


def slots(bins: list[tuple[list[int], int]]) -> Slots:
    rows, taken, base = [], Counter(), 0
    for lengths, times in bins:
        offset = 0
        for k, n in Counter(lengths).items():
            rows.append((k, taken[k], base, n, offset))
            taken[k] += n * times
            offset += n * k
        base += times
    return Slots(*(np.array(c, dtype=np.int64) for c in (zip(*sorted(rows), strict=True) if rows else [[]] * 5)))


class _Words(dict):
    """Packed ids of the words that a task has met, others by the library's model; beyond bpe.CACHE words it starts anew."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.model, self.symbols = Tokenizer.from_str(content).model, bpe.byte_symbols()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= bpe.CACHE:
            self.clear()
        own = "".join([self.symbols[b] for b in word.encode()])
        found = self[word] = np.array([t.id for t in self.model.tokenize(own)], "<u4").tobytes()
        return found


@lru_cache(maxsize=1)
def _coder(content: str) -> tuple[bpe.Tokenizer, _Words]:
    """The rules of splitting texts into words, read from the file, and the ids of words."""
    return bpe._compiled(content), _Words(content)


def packed_ids(text: str | None, coder: tuple[bpe.Tokenizer, _Words]) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit integers: words are encoded once a task, not once a place."""
    t, words = coder
    if not text:
        return b""
    get = words.__getitem__
    if not any(x in text for x in t.special):
        return b"".join(map(get, t.words(text)))
    return b"".join([np.array([t.special[x]], "<u4").tobytes() if x in t.special else b"".join(map(get, t.words(x))) for x in t.cut.split(text)])


def pieces(docs: DataFrame, tokenizer: str, opts: Packing = Packing(), ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids if asked for, ids_crc32, task, number): the pieces of each document, and each
    one's number among those of its length in its task."""
    held = docs.sparkSession.sparkContext.broadcast(tokenizer)
    names = ["doc_id", "piece", "start", "length", *(["ids"] if ids else []), "ids_crc32", "task", "number"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, seen = _coder(held.value), TaskContext.get().partitionId(), Counter()
        end = np.array([opts.end], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = packed_ids(text, coder) + end
                for i, at in enumerate(range(0, len(raw), 4 * opts.capacity)):
                    own = raw[at : at + 4 * opts.capacity]
                    n = len(own) // 4
                    out.append((doc, i, at // 4, n, *([np.frombuffer(own, "<u4").astype(np.int32)] if ids else []), zlib.crc32(own), task, seen[n]))
                    seen[n] += 1
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if ids else []), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    schema = "doc_id long, piece int, start long, length long, " + ("ids array<int>, " if ids else "") + "ids_crc32 long, task int, number long"
    return common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def pack(docs: DataFrame, tokenizer: str, opts: Packing = Packing(), ids: bool = True) -> DataFrame:
    """Per piece of a document: doc_id, piece int, start long, length long, ids array<int> (if asked for), ids_crc32
    long, sequence_id long, offset long.

    Needs doc_id and text; other columns are not read. tokenizer is the content of the file, see bpe.read_tokenizer. A
    document's ids are its text's (null: empty) and opts.end; only documents of over opts.capacity ids are cut. Every
    row is a document of its own, whatever its doc_id, null or repeated. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = common.written(pieces(docs, tokenizer, opts, ids), "pieces")
    sizes = rows.groupBy("task", "length").agg(F.count("*").alias("n"))
    sizes = common.written(sizes, "sizes")
    counts = dict(sizes.groupBy("length").agg(F.sum("n")).collect())  # at most `capacity` rows
    table = slots(plan(counts, opts.capacity))
    held = spark.sparkContext.broadcast(table)
    # Pieces of a length before a task: a row for each task is met, whose number follows the files.
    upto = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select(F.col("task"), F.col("length"), F.coalesce(upto, F.lit(0)).alias("before"))
    numbered = rows.join(before, ["task", "length"]).withColumn("number", F.col("number") + F.col("before"))
    columns = ["doc_id", "piece", "start", "length", *(["ids"] if ids else []), "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found, offset = held.value.find(b.column("length").to_numpy(), b.column("number").to_numpy())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(found), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, " + ("ids array<int>, " if ids else "") + "ids_crc32 long, sequence_id long, offset long"
    return common.arrow_map(numbered.select(*columns, "number"), run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids array<int>, docs array<struct<doc_id, piece, offset, length>>): the sequences that pack's rows
    with ids make, their documents in order of place. A sequence has at most `capacity` tokens, so a group is bounded."""
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("own")
    made = packed.groupBy("sequence_id").agg(own)
    return made.select("sequence_id", F.flatten(F.col("own.ids")).alias("ids"), F.transform("own", lambda x: F.struct(x.doc_id.alias("doc_id"), x.piece.alias("piece"), x.offset.alias("offset"), x.length.alias("length"))).alias("docs"))
