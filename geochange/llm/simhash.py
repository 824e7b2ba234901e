"""SimHash near-duplicates, found through vantage-point partitions of the fingerprints.

Fingerprints link when they differ in at most `bits` places. The 64 places are cut into blocks; a pair within reach
agrees in full on some choice of the blocks. For each choice the places in it give a metric of their own, in which
such a pair is at distance 0 and so, by the triangle inequality, at the same distance from every vantage point: no
branch but one of the vantage-point partition need be visited for it. The shards are the rings around the vantage
points. Within a shard a vantage-point tree over the whole fingerprint finds the exact pairs; there a query visits
both sides where it lies within reach of the boundary.

Fingerprints may be of several words of 64 places, with rings of other metrics (near_copies): ring_links joins within
rings that are given. Within a shard they are an array with a row for each word and a column for each point.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: Points that a leaf of the tree in a shard compares with one another.
LEAF = 192
#: Points of a shard that one task takes at a time; larger shards are met block against block.
BLOCK = 65536
#: Vantage points of a partition; more part it no finer once their rings tell all its values apart.
VANTAGES = 12


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The SimHash of one whole text; a bit is set if it is in over half of the shingles' hashes, repeats included."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and split at ASCII white space
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[: len(words) - shingle]]).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    view = memoryview(joined)
    hashes = np.fromiter((digest(view[a:b], seed) for a, b in zip(starts, stops, strict=True)), dtype="<u8", count=len(starts))
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        total += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, t (a hash of the text) and fp, the fingerprint as a signed long, for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(found.view(np.int64))], names=["doc_id", "t", "fp"])

    return common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_key(), "text"), run, "doc_id long, t long, fp long")


def choices(bits: int, extra: int = 2) -> list[int]:
    """Masks of the choices of blocks: of bits + extra blocks at most `bits` are touched by the differences, so each
    linked pair agrees on some choice of `extra` blocks."""
    n = bits + extra
    edge = [round(64 * i / n) for i in range(n + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:], strict=False)]
    return [sum(block[i] for i in c) for c in combinations(range(n), extra)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def vantage_points(mask: int, n: int = VANTAGES) -> list[int]:
    """Fixed points of a choice's metric, drawn from the mask alone: the partition is the same whatever the data."""
    return [xxhash.xxh64_intdigest(f"{mask}/{i}".encode(), 7) & mask for i in range(n)]


class _Forest:
    """Union-find over the positions of one shard."""

    def __init__(self, n: int):
        self.to = list(range(n))

    def root(self, i: int) -> int:
        while self.to[i] != i:
            self.to[i] = self.to[self.to[i]]
            i = self.to[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = self.root(i), self.root(j)
            if i != j:
                self.to[max(i, j)] = min(i, j)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places fingerprints differ; their first axis is that of words."""
    found = np.bitwise_count(a[0] ^ b[0])
    for x, y in zip(a[1:], b[1:], strict=True):
        found = found + np.bitwise_count(x ^ y).astype(np.int16)
    return found


def _tree(fp: np.ndarray, at: np.ndarray, bits: int, forest: _Forest) -> None:
    """Joins all linked points of fp[:, at]. What lies within reach of the vantage point is joined with it at once, and
    those points are not compared with one another."""
    todo, rng = [at], None
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            x = fp[:, at]
            i, j = np.nonzero(np.triu(_apart(x[:, :, None], x[:, None, :]) <= bits, 1))
            forest.join(at[i], at[j])
            continue
        rng = rng or np.random.default_rng(1)
        v = at[rng.integers(len(at))]
        d = _apart(fp[:, at], fp[:, [v]]).astype(np.int64)
        near = d <= bits
        forest.join(np.full(int(near.sum()), v), at[near])
        rest, ring = at[~near], d[~near]
        # A partner of a joined point is at most two reaches from the vantage point.
        _cross(fp, at[near], rest[ring <= 2 * bits], bits, forest)
        if not len(rest):
            continue
        mid = int(np.median(ring))
        inside = ring <= mid
        if inside.all():
            mid -= 1
            inside = ring <= mid
        if not inside.any():  # all at one distance from v, which is gone now: draw another
            todo.append(rest)
            continue
        # Pairs over the boundary: only points within reach of it, by the triangle inequality.
        _cross(fp, rest[inside & (ring > mid - bits)], rest[~inside & (ring <= mid + bits)], bits, forest)
        todo += [rest[inside], rest[~inside]]


def _cross(fp: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int, forest: _Forest) -> None:
    if not len(b):
        return
    step = max(1, 2_000_000 // len(b))
    for i in range(0, len(a), step):
        x, y = np.nonzero(_apart(fp[:, a[i : i + step], None], fp[:, None, b]) <= bits)
        forest.join(a[i : i + step][x], b[y])


def shard_edges(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of links (u, v) that joins whatever is joined by pairs of the distinct fingerprints fp. Those of several
    words, a row each, are named by the first."""
    words = fp.reshape(-1, fp.shape[-1])
    n = words.shape[1]
    forest = _Forest(n)
    _tree(words, np.arange(n), bits, forest)
    roots = np.array([forest.root(i) for i in range(n)], np.int64)
    at = np.flatnonzero(roots != np.arange(n))
    return words[0, roots[at]], words[0, at]


def _links(bits: int, words: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of shard and words: rows of one shard follow one another, over the ends of batches too."""
        kept_key, kept_fp = np.zeros(0, np.int64), np.zeros((len(words), 0), np.int64)

        def solve(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.diff(key)) + 1
            start, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
            size, us, vs, x = stop - start, [], [], fp.view(np.uint64)
            pairs = [np.zeros((2, 0), np.int64)]
            small = np.repeat(size <= 16, size)
            for gap in range(1, 16):  # all small shards at once: each row against the gap-th after it
                if gap >= len(key):
                    break
                i = np.flatnonzero((key[:-gap] == key[gap:]) & small[:-gap])
                i = i[(_apart(x[:, i], x[:, i + gap]) <= bits) & (x[0, i] != x[0, i + gap])]
                pairs.append(np.stack([i, i + gap]))
            i, j = np.concatenate(pairs, axis=1)
            low = np.arange(len(key))
            np.minimum.at(low, j, i)
            keep = (low[j] == i) | (low[i] != low[j])  # a pair that meets at one earlier point is joined there
            us.append(x[0, i[keep]])
            vs.append(x[0, j[keep]])
            first = np.concatenate([[True], (x[:, 1:] != x[:, :-1]).any(axis=0)])
            for a, b in zip(start[size > 16], stop[size > 16], strict=True):
                first[a] = True
                u, v = shard_edges(x[:, a:b][:, first[a:b]], bits)
                us.append(u)
                vs.append(v)
            u, v = (np.concatenate([np.zeros(0, np.uint64), *y]).view(np.int64) for y in (us, vs))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            key = np.concatenate([kept_key, batch.column("shard").to_numpy()])
            fp = np.concatenate([kept_fp, np.stack([batch.column(w).to_numpy() for w in words])], axis=1)
            if not len(key):
                continue
            end = int(np.searchsorted(key != key[-1], False)) if key[0] == key[-1] else int(np.flatnonzero(key != key[-1])[-1]) + 1
            if end:
                yield solve(key[:end], np.ascontiguousarray(fp[:, :end]))
            kept_key, kept_fp = key[end:], fp[:, end:]
        if len(kept_key):
            yield solve(kept_key, np.ascontiguousarray(kept_fp))

    return run


def near_links(distinct: DataFrame, bits: int = 4, extra: int = 2, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between the distinct fingerprints fp of a table: enough of them to join all that is linked. The more
    extra blocks of places a choice has, the smaller are the shards and the more copies of each point are dealt out."""
    masks = choices(bits, extra)
    shards = []
    for i, mask in enumerate(masks):
        rings = [F.bit_count(F.col("fp").bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(F.lit(_signed(v)))) for v in vantage_points(mask)]
        shards.append(F.xxhash64(F.lit(i), *rings))
    rows = distinct.select("fp", F.explode(F.array(*shards)).alias("ring"))
    return ring_links(rows, rows.groupBy("ring").agg(F.count("*").alias("n")), bits, ["fp"], block)


def ring_links(rows: DataFrame, size: DataFrame, bits: int, words: list[str], block: int = BLOCK) -> DataFrame:
    """Links (u, v), first words of fingerprints within `bits` places over all words, that share a ring of rows(ring,
    words); enough of them to join all that is linked so. size(ring, n) has the rows of the larger rings, nearly at least:
    it only decides in how many blocks a ring is met."""
    spark = rows.sparkSession
    # A shard of over block points is met block against block, so that no task holds more than two blocks of it.
    large = size.where(F.col("n") > block).select("ring", F.ceil(F.col("n") / F.lit(block / 2)).cast("int").alias("b"))
    dealt = rows.join(large, "ring", "left").withColumn("own", F.pmod(F.xxhash64(*words), F.col("b")))
    pair = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda o: F.xxhash64("ring", F.least(F.col("own"), o.cast("long")), F.greatest(F.col("own"), o.cast("long"))))
    shard = F.explode(F.when(F.col("b").isNull(), F.array("ring")).otherwise(pair)).alias("shard")
    n = common.shuffle_parts(spark)
    placed = dealt.select(shard, *words).repartition(n, "shard").sortWithinPartitions("shard", *words)
    return common.arrow_map(placed, _links(bits, words), "u long, v long").distinct()


def near_components(docs: DataFrame, bits: int = 4, shingle: int = 4, seed: int = 42, extra: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits) and component_id."""
    return row_components(docs, bits, shingle, seed, extra).select("doc_id", "fingerprint", "component_id")


def row_components(docs: DataFrame, bits: int = 4, shingle: int = 4, seed: int = 42, extra: int = 2) -> DataFrame:
    """near_components with t, the text's hash, which tells rows of one or no doc_id apart, and root, which names the
    component also where none of its rows has a doc_id.

    Only doc_id and text are read. Null and blank texts have the fingerprint 0 and are linked like any other; texts of
    fewer words than a shingle are one shingle. component_id is the smallest doc_id that links reach, null doc_ids
    aside; rows that repeat a doc_id keep their rows. An empty table gives an empty result.
    """
    found = common.written(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = common.written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = common.written(components(near_links(distinct.select("fp"), bits, extra)), "roots")
    # Classes of fingerprints carry the smallest doc_id; only linked fingerprints are in roots.
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.select("fp", "root").join(least, "root").select("fp", "root", "component_id")
    out = found.join(classes, "fp", "left")
    return out.select("doc_id", "t", "root", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
