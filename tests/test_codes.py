"""The index of codes: recall and what is read on clumped vectors, appends, deletion marks, compaction, odd input."""

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from geochange.operators import codes, vector

TILES = "tile_id long, scene_id long, embedding array<float>"


@pytest.fixture(scope="module")
def clumped(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 32))
    rows = [(i, i % 7, (centres[i % 40] + 0.35 * rng.normal(size=32)).astype(np.float32).tolist()) for i in range(4000)]
    tiles = spark.createDataFrame(rows, TILES).repartition(4).cache()
    model = codes.fit(tiles)
    queries = tiles.where("tile_id % 20 = 0").select(F.col("tile_id").alias("query_id"), F.col("embedding").alias("query"))
    return tiles, model, queries


def test_few_lists_and_short_codes_find_the_nearest(spark, clumped):
    tiles, model, queries = clumped
    assert len(model.lists) == codes.list_count(4000) == 63 and model.books.shape == (8, 256, 4)
    index = codes.coded(tiles, model).cache()
    assert index.count() == 4000 and {len(r.code) for r in index.select("code").distinct().limit(50).collect()} == {8}
    exact = vector.top_k(vector.similarities(tiles, queries), 10).cache()
    probes = codes.probes_for(index, tiles, queries, model, 10)
    assert probes <= 4
    found = codes.search(index, tiles, queries, model, 10, probes).cache()
    assert codes.recall(found, exact) >= 0.95
    # Similarities are those of the vectors themselves.
    both = found.join(exact.select("query_id", "tile_id", F.col("similarity").alias("s")), ["query_id", "tile_id"])
    assert both.where(F.abs(F.col("similarity") - F.col("s")) > 1e-12).count() == 0 and found.groupBy("query_id").count().where("count <> 10").count() == 0
    # Bytes: the codes of the lists that are read, and the vectors that they name, against all vectors.
    named = codes.named(index, queries, model, probes, 200)
    scanned = index.groupBy("list").count().agg(F.max("count")).first()[0] * probes
    per_query = named.groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert scanned * 8 + per_query * 32 * 4 < 0.1 * 4000 * 32 * 4


def test_an_index_grows_and_shrinks(spark, clumped, tmp_path):
    tiles, model, queries = clumped
    path = str(tmp_path / "index")
    own = codes.StoredIndex(spark, path).create(model)
    with pytest.raises(AnalysisException):
        codes.StoredIndex(spark, path).create(model)
    assert own.rows().count() == 0
    assert own.add(tiles.where("tile_id < 3000")) == 3000
    more = tiles.where("tile_id >= 2900")
    assert own.add(more.unionByName(more)) == 1000 and own.rows().count() == 4000
    with pytest.raises(ValueError):
        own.add(spark.createDataFrame([(9001, 0, [float("nan")] * 32)], TILES))
    with pytest.raises(ValueError):
        own.add(spark.createDataFrame([(9002, 0, None)], TILES))
    again = codes.StoredIndex(spark, path)
    assert np.array_equal(again.codes().books, model.books)
    want = {tuple(r) for r in codes.search(codes.coded(tiles, model), tiles, queries, model, 5, 4).select("query_id", "tile_id").collect()}
    assert {tuple(r) for r in codes.search(again.rows(), tiles, queries, again.codes(), 5, 4).select("query_id", "tile_id").collect()} == want
    again.delete(tiles.where("tile_id % 2 = 0").select("tile_id"))
    assert again.rows().where("tile_id % 2 = 0").count() == 0 and again.rows().count() == 2000
    assert {t % 2 for _, t in ((r.query_id, r.tile_id) for r in codes.search(again.rows(), tiles, queries, model, 5, 4).collect())} == {1}
    assert again.add(tiles.where("tile_id = 100")) == 1 and again.rows().count() == 2001
    small = again.compact(str(tmp_path / "small"))
    assert sorted(r.tile_id for r in small.rows().collect()) == sorted(r.tile_id for r in again.rows().collect())
    assert spark.read.parquet(str(tmp_path / "small/codes")).count() == 2001


def test_odd_vectors(spark, clumped):
    _, model, queries = clumped
    odd = spark.createDataFrame([(1, 0, None), (2, 0, [float("inf")] * 32), (3, 0, [0.0] * 32), (4, 0, [1.0] * 32)], TILES)
    assert sorted(r.tile_id for r in codes.coded(odd, model).collect()) == [3, 4]
    assert codes.search(codes.coded(odd, model), odd, queries.limit(3), model, 5, 63).count() == 6
    assert codes.search(codes.coded(odd, model).limit(0), odd, queries, model, 5, 2).count() == 0
    with pytest.raises(ValueError):
        codes.fit(odd.where("tile_id = 1"))
    with pytest.raises(ValueError):
        codes.fit(odd, parts=7)
    assert [codes.list_count(n) for n in (0, 10**4, 10**12)] == [8, 100, 4096]


def test_the_query_finds_what_is_near(spark):
    from geochange import queries as engine

    d = "/root/testdata/sf0.01"
    exact = engine.knn_exact(spark, d)
    assert codes.recall(engine.knn_coded(spark, d), exact) >= 0.9


def test_codes_of_evenly_spread_vectors_name_the_nearest(spark):
    """Codes of eight bytes for 64 components lose a fifth of the nearest of 51282 such vectors (200 named, all lists read)."""
    rng = np.random.default_rng(11)
    rows = [(i, 0, v.tolist()) for i, v in enumerate(rng.normal(size=(12_000, 64)).astype(np.float32))]
    tiles = spark.createDataFrame(rows, TILES).repartition(4).cache()
    queries = tiles.where("tile_id % 400 = 0").select(F.col("tile_id").alias("query_id"), F.col("embedding").alias("query"))
    model = codes.fit(tiles, rows=3000)
    assert model.parts == 16
    index = codes.coded(tiles, model).cache()
    exact = vector.top_k(vector.similarities(tiles, queries), 10)
    probes, keep = codes.plan_for(index, tiles, queries, model, 10)
    assert codes.recall(codes.search(index, tiles, queries, model, 10, probes, keep), exact) >= 0.9
    # Each group sends on what is asked for, and ties of codes go by id.
    twice = index.unionByName(index.withColumn("tile_id", F.col("tile_id") + 50_000))
    both = codes.named(twice, queries, model, 5, 20, share=3000).groupBy("query_id").agg(F.count("*").alias("n"), F.sum((F.col("tile_id") < 50_000).cast("int")).alias("low"))
    assert {(r.n, r.low) for r in both.collect()} == {(20, 10)}
