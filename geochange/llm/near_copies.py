"""Near copies by verified likeness: texts whose sets of shingles of five words are alike by 0.8 or more (Jaccard).

Candidates come from SimHashes of WORDS words of 64 places, by simhash's vantage-point partitions. At a likeness of 0.8
SimHashes differ in 15 % of the places, too many for a choice of blocks that every pair agrees on. So the metrics are
METRICS sets of PLACES places, no place in two of them: a pair is at distance 0 in each with chance 0.85 ** PLACES,
and then in one ring of each of its vantage points. In the shards, which are the rings, a vantage-point tree over the
first CHECK words, which no metric is over, joins what lies within CHECK_REACH. Texts that are joined, over any number
of others, are a pool; in a pool each pair that isn't joined yet is tested: its SimHashes must lie within REACH, and
then its sets are compared in full. So every link is right, and a pair is missed only if it shares no ring (by
calculation one of three million at 0.8; one of 5,600 if four shingles meet five) or if its SimHashes are further apart
than a reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash
from .components import components

SHINGLE, LIKENESS = 5, 0.8
#: Words of a fingerprint: the first are compared in a shard, the metrics are over the places of the others.
CHECK, RINGED = 3, 20
WORDS = CHECK + RINGED
#: Places of a metric, and metrics. Larger tables want more places (shards hold a 2 ** PLACES-th of the texts), and then more words.
PLACES = 12
METRICS = RINGED * (64 // PLACES)
#: Bits of the first CHECK words: at 0.8 they differ in 29 places, give or take 5; those of texts that have nothing in common in 96, give or take 7.
CHECK_REACH = 58
#: Bits of 64: at a likeness of 0.8 SimHashes differ in 9.7 places, give or take 2.9; those of texts that have nothing in common in 32.
REACH = 28
#: Texts, and bytes of them, that a block of a pool holds; a task holds two blocks of a larger pool, no more.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Rings are counted on one of so many texts, only to see which shards are met in blocks.
COUNTED = 16

_SEEDS = np.random.default_rng(11).integers(0, 2**64, WORDS, dtype=np.uint64)


def _ring_table() -> np.ndarray:
    """For each set of PLACES places of a word: the ring, as a number, of each value that the places can have; it is made
    of the distances to the vantage points of their metric."""
    values, out = np.arange(1 << PLACES, dtype=np.uint64), []
    for i in range(64 // PLACES):
        shift = np.uint64(i * PLACES)
        ring = np.zeros(len(values), np.int64)
        for v in simhash.vantage_points(((1 << PLACES) - 1) << (i * PLACES)):
            ring = ring * (PLACES + 1) + np.bitwise_count((values << shift) ^ np.uint64(v))
        out.append(ring)
    return np.array(out)


_RING = _ring_table()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # as simhash.fingerprint does


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The hashes of the distinct shingles, in order; a text of fewer words is one shingle, one of none has none."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh3_64_intdigest
    if len(words) <= size:
        return np.array([digest(joined)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[: len(words) - size]]).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    view = memoryview(joined)
    return np.unique(np.fromiter((digest(view[a:b]) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts)))


def fingerprint(found: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The SimHash of a set of shingles in this many words; each is of other hashes, the first of the shingles' own."""
    total = np.zeros(64 * words, np.int64)
    for i in range(0, len(found), 255):  # sums of so many bits fit a byte: eight are added at a time
        x = found[i : i + 255, None] + _SEEDS[:words]  # wraps
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        x[:, 0] = found[i : i + 255]
        total += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").view(np.uint64).sum(axis=0).view(np.uint8)
    return np.packbits(2 * total > len(found), bitorder="little").view("<u8")


def simhash_of(found: np.ndarray) -> int:
    return int(fingerprint(found, 1)[0])


def rings(prints: np.ndarray) -> np.ndarray:
    """A key for each of the METRICS metrics of each row of prints(n, WORDS): the ring in it, and its number."""
    out = np.empty((len(prints), METRICS), np.int64)
    for m in range(METRICS):
        word, at = CHECK + m // len(_RING), m % len(_RING)
        value = (prints[:, word] >> np.uint64(at * PLACES)) & np.uint64((1 << PLACES) - 1)
        out[:, m] = _RING[at][value.astype(np.int64)] + (m << 45)  # 13 ** 12 distances fit 45 bits
    return out


def bands(found: np.ndarray) -> np.ndarray:
    """The rings of one set of shingles."""
    return rings(fingerprint(found)[None])[0]


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def signed_rows(docs: DataFrame) -> DataFrame:
    """(d, t, w, size, fp) of each row: w is the hash of the words, by which equal texts meet; fp, the words of the fingerprint, is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, size, keys = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                w.append(xxhash.xxh3_64_intdigest(b" ".join(words), 1))
                size.append(sum(map(len, words)))
                keys.append(fingerprint(shingles(words)).view(np.int64) if words else None)
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("t"), _signed(w), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["d", "t", "w", "size", "fp"])

    return common.arrow_map(docs.select(common.row_key(), common.text_key(), "text"), run, "d long, t long, w long, size long, fp array<long>")


def _ringed(prints: DataFrame) -> DataFrame:
    """(ring, f0, f1, ...) for each metric of each row of prints(fp)."""
    names = [f"f{i}" for i in range(CHECK)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WORDS)
            found = [pa.array(np.repeat(fp[:, i], METRICS).view(np.int64)) for i in range(CHECK)]
            yield pa.RecordBatch.from_arrays([pa.array(rings(fp).ravel()), *found], names=["ring", *names])

    return common.arrow_map(prints, run, ", ".join(f"{x} long" for x in ["ring", *names]))


def candidates(prints: DataFrame) -> DataFrame:
    """Links (u, v) between fingerprints of prints(w, fp), named by their first words: enough of them to join whatever shares
    a ring and lies within CHECK_REACH."""
    some = _ringed(prints.where(F.pmod(F.xxhash64("w"), F.lit(COUNTED)) == 0).select("fp"))
    size = some.groupBy("ring").agg((F.count("*") * COUNTED).alias("n"))
    # Of these the join takes those of over a block: a row for 65536 of the others at most.
    links = simhash.ring_links(_ringed(prints.select("fp")), F.broadcast(size), CHECK_REACH, [f"f{i}" for i in range(CHECK)], simhash.BLOCK)
    # A group has links in every metric, nearly all to no end: a point and those before it are tied to the least of these.
    near = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).groupBy("v").agg(F.collect_set("u").alias("us"))
    tied = F.transform(F.array_append("us", F.col("v")), lambda x: F.struct(F.array_min("us").alias("u"), x.alias("v")))
    return near.select(F.explode(tied).alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def alike(sets: list[np.ndarray], prints: np.ndarray) -> list[tuple[int, int]]:
    """Links that join whatever is joined by pairs of sets of LIKENESS or more. Pairs that are joined already are left out."""
    n = np.array([len(s) for s in sets])
    root, links = np.arange(len(sets)), []
    for i in range(len(sets)):
        rest = np.arange(i + 1, len(sets))
        rest = rest[(root[rest] != root[i]) & (np.minimum(n[rest], n[i]) >= LIKENESS * np.maximum(n[rest], n[i]))]
        for j in rest[np.bitwise_count(prints[rest] ^ prints[i]) <= REACH].tolist():
            if root[j] == root[i]:
                continue
            small, large = (sets[i], sets[j]) if n[i] <= n[j] else (sets[j], sets[i])
            at = np.searchsorted(large, small)
            both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            if both >= LIKENESS * (n[i] + n[j] - both):
                links.append((i, j))
                root[root == root[j]] = root[i]
    return links


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, w, text) come in the order of part and w."""

    def rows():
        for batch in batches:
            yield from zip(batch.column("part").to_pylist(), batch.column("w").to_pylist(), (x.as_py() for x in batch.column("text")))

    for _, part in groupby(rows(), lambda r: r[0]):
        names, sets = [], []
        for _, w, text in part:
            if not names or names[-1] != w:  # rows of one doc_id and text come again
                names.append(w)
                sets.append(shingles(words_of(text)))
        links = alike(sets, np.array([simhash_of(s) for s in sets], np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in links], pa.int64()), pa.array([names[j] for _, j in links], pa.int64())], names=["u", "v"])


def grouped(docs: DataFrame) -> DataFrame:
    """(d, t, root) of each row of docs(doc_id, text): rows of one root are near copies, over any number of others.

    d and t are common.row_key and common.text_key. Texts of the same words are copies; null and blank texts are, too.
    """
    spark = docs.sparkSession
    found = common.written(signed_rows(docs), "signed")
    one = found.groupBy("w").agg(F.min(F.struct("d", "t")).alias("k"), F.max("size").alias("size"), F.min("fp").alias("fp"))
    one = common.written(one.where("fp is not null"), "distinct")
    pools = common.written(components(candidates(one.select("w", "fp"))), "pools")
    # Texts of one first word are a pool, too, whatever else it is linked with.
    members = one.select("w", "k", "size", F.element_at("fp", 1).alias("node")).join(pools, "node", "left").withColumn("root", F.coalesce("root", "node"))
    size = members.groupBy("root").agg(F.count("*").alias("n"), F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_BYTES)).cast("int").alias("b"))
    size = size.where("n > 1").drop("n")
    # Two blocks of a larger pool meet in a task of their own, so that no task holds more of it.
    own = F.pmod(F.xxhash64("w"), F.col("b"))
    pair = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda o: F.xxhash64("root", F.least(own, o.cast("long")), F.greatest(own, o.cast("long"))))
    members = members.join(size, "root").select("w", F.col("k.d").alias("d"), F.col("k.t").alias("t"), pair.alias("parts"))
    texts = docs.select(common.row_key(), common.text_key(), "text").join(members, ["d", "t"]).select(F.explode("parts").alias("part"), "w", "text")
    dealt = texts.repartition(common.shuffle_parts(spark), "part").sortWithinPartitions("part", "w")
    links = common.written(common.arrow_map(dealt, _verified, "u long, v long"), "links")
    roots = components(links).withColumnRenamed("node", "w")
    return found.join(roots, "w", "left").select("d", "t", F.coalesce("root", "w").alias("root"))
