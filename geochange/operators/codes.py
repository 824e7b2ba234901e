"""An index of vectors that grows: lists of near vectors, short codes that are scanned first, exact ranking of
what they name.

A vector's code is a byte for each of its parts: the nearest of 256 centres of what the parts of vectors differ from their
list's centre by. A query reads the codes of its nearest lists alone, a sixteenth of the vectors' bytes or less, and only
the best of them are compared as they are. Centres are fitted once, on a bounded sample; vectors are added, marked as
deleted and compacted without a new fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pairs, vector
from .raster import kept

#: Vectors that the centres of lists and codes are fitted on, about.
FIT_ROWS = 20_000
_CODES = "tile_id long, scene_id long, list int, code binary"


@dataclass(frozen=True)
class Codes:
    """lists: a centre a row; books: (parts, 256, dims / parts), the centres of the parts of what is left."""

    lists: np.ndarray
    books: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.books)

    def vectors(self, lists: np.ndarray, code: np.ndarray) -> np.ndarray:
        """What lists and codes stand for."""
        return self.lists[lists] + self.books[np.arange(self.parts), code].reshape(len(code), -1)

    def place(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and the code of vectors of length one."""
        near = (unit @ self.lists.T - (self.lists**2).sum(axis=1) / 2).argmax(axis=1)
        left = (unit - self.lists[near]).reshape(len(unit), self.parts, -1)
        code = np.stack([(left[:, m] @ b.T - (b**2).sum(axis=1) / 2).argmax(axis=1) for m, b in enumerate(self.books)], axis=1)
        return near, code.astype(np.uint8)


def list_count(n: int) -> int:
    """Lists for n vectors: their root, from 8 to 4096, so that lists and what is in one grow alike."""
    return max(8, min(4096, round(math.sqrt(n))))


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means on a bounded sample; an empty centre takes the vector farthest from its own."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        score = x @ c.T - (c**2).sum(axis=1) / 2
        at = score.argmax(axis=1)
        n = np.bincount(at, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if (n == 0).any():
            c[n == 0] = x[np.argsort(score.max(axis=1))[: int((n == 0).sum())]]
    return c


def fit(tiles: DataFrame, parts: int | None = None, lists: int | None = None, rows: int = FIT_ROWS) -> Codes:
    """Centres of lists and codes on about `rows` vectors that a hash of their id picks: the driver holds that sample, of a
    fixed size whatever the table's. Vectors that are null or not finite are left out; dims must be a multiple of parts, by
    default one for four components: codes of eight for 64 name too few of the nearest where vectors are evenly spread."""
    fine = tiles.where(F.coalesce(vector.finite(F.col("embedding")), F.lit(False)))
    n = fine.count()
    if not n:
        raise ValueError("no vector to fit on")
    share = min(1.0, rows / n)
    picked = fine.where(F.pmod(F.xxhash64("tile_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).orderBy("tile_id").select("embedding").collect()
    x = np.array([r[0] for r in picked], dtype=float)
    parts = parts or max(1, x.shape[1] // 4)
    if x.shape[1] % parts:
        raise ValueError(f"{x.shape[1]} components can't be cut into {parts} parts")
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    rng = np.random.default_rng(0)
    centres = _means(x, lists or list_count(n), rng)
    near = (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
    left = (x - centres[near]).reshape(len(x), parts, -1)
    books = np.stack([np.resize(_means(left[:, m], 256, rng), (256, left.shape[2])) for m in range(parts)])
    return Codes(centres, books)


def coded(tiles: DataFrame, codes: Codes) -> DataFrame:
    """(tile_id, scene_id, list, code) of tiles; those whose vector is null or not finite are left out. No shuffle."""

    def work(batches):
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["embedding"].tolist(), dtype=float)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                near, code = codes.place(x)
                yield pd.DataFrame({"tile_id": pdf["tile_id"], "scene_id": pdf["scene_id"], "list": near.astype(np.int32), "code": [c.tobytes() for c in code]})

    fine = tiles.where(F.coalesce(vector.finite(F.col("embedding")), F.lit(False)))
    return fine.select("tile_id", "scene_id", "embedding").mapInPandas(work, _CODES)


def _scanned(codes: Codes, probes: int, keep: int):
    """Of each query of a group the `keep` rows whose codes are most like it, of its `probes` nearest lists."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(list(batches))
        own, asked = both.filter(pc.is_valid(both["code"])), both.filter(pc.is_null(both["code"]))
        if not own.num_rows or not asked.num_rows:
            return
        ids, lists = (np.array(own[c]) for c in ("id", "list"))
        order = np.lexsort((ids, lists))
        ids, lists = ids[order], lists[order]
        code = np.frombuffer(b"".join(own["code"].to_pylist()), np.uint8).reshape(len(ids), -1)[order]
        ends = np.searchsorted(lists, np.arange(len(codes.lists) + 1))
        whole, queries = None, np.array(asked["id"])
        _, q = pairs.vectors(asked["v"])[codes.lists.shape[1]]
        near = np.concatenate([np.argsort(-(q[a : a + 1024] @ codes.lists.T - (codes.lists**2).sum(axis=1) / 2), axis=1, kind="stable")[:, :probes].astype(np.int32) for a in range(0, len(q), 1024)])
        by_list = np.argsort(near[:, 0], kind="stable")  # queries that read the same lists are met together
        for a in range(0, len(by_list), 256):
            rows = by_list[a : a + 256]
            read = np.zeros((len(rows), len(codes.lists)), bool)
            np.put_along_axis(read, near[rows], True, axis=1)
            cols = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in np.flatnonzero(read.any(axis=0))])
            if not len(cols):
                continue
            if 2 * len(cols) > len(ids):
                cols = np.arange(len(ids))
                whole = whole or pairs.Pool(codes.vectors(lists, code), ids)
            pool, held = whole if len(cols) == len(ids) and whole else pairs.Pool(codes.vectors(lists[cols], code[cols]), ids[cols]), lists[cols]
            for qi, ti, s in pool.best(q[rows], keep, allowed=lambda r, c, read=read, held=held: read[r][:, held[c]]):
                yield pa.RecordBatch.from_arrays([pa.array(queries[rows[qi]]), pa.array(ids[cols[ti]]), pa.array(held[ti].astype(np.int32)), pa.array(s)], names=["query_id", "tile_id", "list", "score"])

    return work


def named(index: DataFrame, queries: DataFrame, codes: Codes, probes: int, keep: int, block: int = 2048, share: int = 131_072) -> DataFrame:
    """(query_id, tile_id, list): of each query (query_id, query) the `keep` vectors of its `probes` nearest lists whose
    codes are most like it, ties by id. Codes and queries are dealt by hash: a group is a block of queries and a share of the
    codes, and sends on no more than `keep` of each query. Of a share only the lists are read that its queries name."""
    parts = max(1, -(-index.count() // share))
    blocks = max(-(-16 // parts), -(-queries.count() // block))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    fine = F.coalesce(vector.finite(F.col("query")), F.lit(False)) & (F.size("query") == codes.lists.shape[1])
    asked = queries.where(fine).select(F.col("query_id").alias("id"), F.transform("query", lambda v: v.cast("double")).alias("v"), deal("query_id", blocks).alias("_b"), each(parts).alias("_p"))
    held = index.select(F.col("tile_id").alias("id"), "list", "code", deal("tile_id", parts).alias("_p"), each(blocks).alias("_b"))
    both = held.unionByName(asked, allowMissingColumns=True).repartition(max(1, min(blocks * parts, 2000)), "_b", "_p")
    found = both.groupBy("_b", "_p").applyInArrow(_scanned(codes, probes, keep), "query_id long, tile_id long, list int, score double")
    return vector.top_k(found.withColumnRenamed("score", "similarity"), keep).select("query_id", "tile_id", "list")


def search(index: DataFrame, tiles: DataFrame, queries: DataFrame, codes: Codes, k: int, probes: int, keep: int | None = None) -> DataFrame:
    """V2: (query_id, tile_id, scene_id, similarity, rank): the k most similar of each query among those that its codes
    name (`keep` of them, 20 k by default), ranked by the vectors themselves. tiles: (tile_id, scene_id, embedding)."""
    return vector.top_k(pairs.ranked(named(index, queries, codes, probes, keep or 20 * k), tiles, queries, k), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact (query_id, tile_id) that was found."""
    n, hit = exact.join(found.select("query_id", "tile_id", F.lit(1).alias("hit")), ["query_id", "tile_id"], "left").agg(F.count("*"), F.count("hit")).first()
    return hit / n if n else 1.0


def plan_for(index: DataFrame, tiles: DataFrame, queries: DataFrame, codes: Codes, k: int, least: float = 0.95, few: int = vector.FEW) -> tuple[int, int]:
    """(probes, keep): the lists to read and the vectors to name so that this share of the k nearest is found, measured on
    `few` queries, by a hash of their id, against all vectors. As many lists are read as hold that share; where the codes lose
    more than a hundredth of it, twice as many vectors are named, else more lists are read."""
    some = kept(queries.where(F.coalesce(vector.finite(F.col("query")), F.lit(False))).orderBy(F.xxhash64("query_id")).limit(few))
    exact = kept(vector.top_k(pairs.nearest(tiles, some, k), k).select("query_id", "tile_id"))
    asked = {r.query_id: np.array(r.query, dtype=float) for r in some.collect()}
    places = []
    for r in exact.join(index.select("tile_id", "list"), "tile_id").select("query_id", "list").collect():  # at most few * k
        score = codes.lists @ asked[r.query_id] - (codes.lists**2).sum(axis=1) / 2
        places.append(int((score > score[r.list]).sum()) + 1)
    if not places:
        return 1, 20 * k
    n, want, keep, rows = len(places), least, 20 * k, index.count()
    while True:
        probes = sorted(places)[min(n, math.ceil(want * n)) - 1]
        found = recall(search(index, tiles, some, codes, k, probes, keep), exact)
        if found >= least:
            return probes, keep
        if found < sum(p <= probes for p in places) / n - 0.01 and keep < rows:
            keep *= 2
        elif probes < max(places):
            want = (1 + want) / 2
        else:
            return len(codes.lists), keep


def probes_for(index: DataFrame, tiles: DataFrame, queries: DataFrame, codes: Codes, k: int, least: float = 0.95, few: int = vector.FEW) -> int:
    """The lists of plan_for."""
    return plan_for(index, tiles, queries, codes, k, least, few)[0]


class StoredIndex:
    """An index at a path: centres, codes by list, and marks of deleted ids. Adding appends files; deleting appends marks."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def create(self, codes: Codes) -> StoredIndex:
        """An empty index of these centres; one that is there already is an error and stays."""
        row = [(codes.lists.tolist(), codes.books.tolist())]
        self.spark.createDataFrame(row, "lists array<array<double>>, books array<array<array<double>>>").coalesce(1).write.parquet(f"{self.path}/centres")
        return self

    def codes(self) -> Codes:
        lists, books = self.spark.read.parquet(f"{self.path}/centres").first()
        return Codes(np.array(lists), np.array(books))

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        """(tile_id, scene_id, code, list) of what isn't deleted."""
        live = self._table("codes", "tile_id long, scene_id long, code binary, batch long, list int")
        gone = self._table("gone", "tile_id long, batch long").groupBy("tile_id").agg(F.max("batch").alias("gone"))
        # What was added after its deletion is there again.
        return live.join(gone, "tile_id", "left").where(F.col("gone").isNull() | (F.col("batch") > F.col("gone"))).drop("gone", "batch")

    def _batch(self) -> int:
        known = [self._table(t, s).agg(F.max("batch")).first()[0] or 0 for t, s in (("codes", "tile_id long, batch long, list int"), ("gone", "tile_id long, batch long"))]
        return max(known) + 1

    def add(self, tiles: DataFrame) -> int:
        """Appends tiles that the index lacks, a repeated id once; a batch with a vector that is null or not finite is
        refused whole. How many were added."""
        if tiles.where(~F.coalesce(vector.finite(F.col("embedding")), F.lit(False))).limit(1).count():
            raise ValueError("a vector of the batch is not finite")
        fresh = kept(coded(tiles.dropDuplicates(["tile_id"]).join(self.rows().select("tile_id"), "tile_id", "left_anti"), self.codes()))
        fresh.withColumn("batch", F.lit(self._batch()).cast("long")).repartition("list").write.mode("append").partitionBy("list").parquet(f"{self.path}/codes")
        return fresh.count()

    def delete(self, ids: DataFrame) -> None:
        """V9: marks ids (tile_id) as deleted."""
        ids.select("tile_id").distinct().withColumn("batch", F.lit(self._batch()).cast("long")).write.mode("append").parquet(f"{self.path}/gone")

    def compact(self, path: str) -> StoredIndex:
        """V9: the index without what is deleted, at a new path; the old one stays until it is dropped."""
        out = StoredIndex(self.spark, path).create(self.codes())
        self.rows().withColumn("batch", F.lit(1).cast("long")).repartition("list").write.partitionBy("list").parquet(f"{path}/codes")
        return out
