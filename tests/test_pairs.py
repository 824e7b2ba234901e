"""Queries against all tiles in groups, by the definition, with ties and odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geochange import queries as engine
from geochange.operators import pairs, vector
from tests.oracle import compare

TILES = "tile_id long, scene_id long, embedding array<float>"


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3 if i % 11 else None, rng.normal(size=6).astype(np.float32).tolist()) for i in range(150)]
    same = rows[7][2]
    rows += [(i, i % 3, same) for i in range(200, 230)]
    rows += [(300, 0, None), (301, 1, [math.nan] * 6), (302, 2, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, 0, [math.inf] + [0.5] * 5), (304, 1, [1.0, 2.0]), (305, 1, []), (306, 1, [0.0] * 6), (307, None, [-math.inf] * 6)]
    tiles = spark.createDataFrame(rows, TILES).repartition(3).cache()
    twice = tiles.where("tile_id in (20, 140)").select(F.lit(20).cast("long").alias("query_id"), F.col("embedding").alias("query"))
    queries = tiles.where("tile_id % 20 = 0 or tile_id > 299").select(F.col("tile_id").alias("query_id"), F.col("embedding").alias("query")).unionByName(twice)
    return tiles, queries


def plain(df):
    return sorted((tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("others", [False, True])
@pytest.mark.parametrize(("k", "block", "share"), [(10, 4, 40), (3, 1000, 1000), (500, 7, 25)])
def test_nearest_by_definition(odd, others, k, block, share):
    tiles, queries = odd
    scored = vector.similarities_in_blocks(tiles, queries)
    want = vector.top_k(scored.where("tile_id <> query_id") if others else scored, k)
    got = vector.top_k(pairs.nearest(tiles, queries, k, others, block, share), k)
    cols = ["query_id", "tile_id", "scene_id", "similarity", "rank"]
    assert plain(got.select(cols).drop("rank")) == plain(want.select(cols).drop("rank"))
    assert plain(got.select("query_id", "rank")) == plain(want.select("query_id", "rank"))
    assert vector.top_k(pairs.nearest(tiles.limit(0), queries, k), k).count() == 0


@pytest.mark.parametrize("share", [10_000, 20])
def test_percentiles_by_definition(odd, share):
    tiles, queries = odd
    scored = vector.similarities_in_blocks(tiles, queries)
    key = F.struct(F.col("similarity").isNull().alias("n"), "similarity").alias("s")  # null is the largest, as in the SQL
    over = vector.Window.partitionBy("query_id", "scene_id").orderBy(key)
    want = scored.withColumn("percentile", F.cume_dist().over(over)).select("query_id", "tile_id", "scene_id", "similarity", "percentile")
    got = pairs.percentiles(tiles, queries, 5, share)
    assert plain(got) == plain(want)
    assert pairs.percentiles(tiles.limit(0), queries).count() == 0 and pairs.percentiles(tiles, queries.limit(0)).count() == 0


def test_ties_within_the_error_of_a_product(spark):
    """Vectors whose similarities differ in the last digit alone, or not at all, keep the order of the definition."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=48)
    rows = [(i, 0, (base[rng.permutation(48)] if i % 2 else base).tolist()) for i in range(400)]
    tiles = spark.createDataFrame(rows, "tile_id long, scene_id long, embedding array<double>").cache()
    queries = spark.createDataFrame([(1, [1 / 3] * 48)], "query_id long, query array<double>")
    want = vector.top_k(vector.similarities_in_blocks(tiles, queries), 150)
    assert plain(vector.top_k(pairs.nearest(tiles, queries, 150, share=200), 150).select(want.columns)) == plain(want)


def test_searches_shuffle_vectors_not_pairs(spark):
    d = "/root/testdata/sf0.01"
    for name in ("knn_exact", "search_hits", "find_similar", "knn_scoped", "semantic_percentile"):
        df = engine.QUERIES[name](spark, d)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "lambdafunction" not in plan, name
        assert compare(df, engine.SQL[name], d) == "", name


def test_lists_by_definition(odd):
    tiles, _ = odd
    fine = tiles.where((F.size("embedding") == 6) & vector.finite(F.col("embedding")))
    model = vector.fit_lists(fine, 4)
    index = vector.indexed(fine, model).cache()
    queries = vector.with_lists(fine.where("tile_id % 20 = 0").select(F.col("tile_id").alias("query_id"), F.col("embedding").alias("query")), model)
    want = vector.top_k(vector.similarities_in_lists(index, queries, 2), 5)
    for block, share in ((3, 20), (1000, 1000)):
        assert plain(vector.top_k(vector.nearest_in_lists(index, queries, 2, 5, block, share), 5).select(want.columns)) == plain(want)
    # The norm is worked out once a vector: outside of the lambda over its elements.
    expression = fine.select(vector.normalised(F.col("embedding")))._jdf.queryExecution().analyzed().toString()
    assert "Project [transform(array(" in expression
