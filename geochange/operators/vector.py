"""Vector retrieval on array columns: exact, where filters go below the ranking, or by lists of near vectors."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pairs


def dot(a: Column, b: Column) -> Column:
    """V5, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """V6; a zero vector stays."""
    # In a list of its own the norm is worked out once, and not for each element.
    return F.transform(F.array(F.sqrt(dot(v, v))), lambda norm: F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x)))[0]


def finite(v: Column) -> Column:
    """No element is null, infinite or not a number."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


#: Query vectors that are sent to every task; more are met in blocks.
FEW = 64


def similarities(tiles: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, tile_id, scene_id, similarity) of query vectors (query_id, query) against all tiles. Similarities are
    not rounded: what ranks or counts them needs them as they are."""
    if queries.limit(FEW + 1).count() > FEW:
        return similarities_in_blocks(tiles, queries)
    return tiles.join(F.broadcast(queries), F.lit(True)).select("query_id", "tile_id", "scene_id", dot(F.col("embedding"), F.col("query")).alias("similarity"))


def similarities_in_blocks(tiles: DataFrame, queries: DataFrame, block: int = 256, share: int = 50_000) -> DataFrame:
    """similarities of any number of queries. Queries and tiles are dealt by hash: each block of about `block` queries
    meets each share of about `share` tiles (eight shares at least) in a group of its own, so that no side is broadcast
    and a group holds no more as the table grows."""
    n, parts = max(1, -(-queries.count() // block)), max(8, -(-tiles.count() // share))
    shares, blocks = F.sequence(F.lit(0), F.lit(parts - 1)), F.sequence(F.lit(0), F.lit(n - 1))
    q = queries.select("query_id", "query", F.pmod(F.xxhash64("query_id"), F.lit(n)).cast("int").alias("_b"), F.explode(shares).alias("_p"))
    t = tiles.select("tile_id", "scene_id", "embedding", F.pmod(F.xxhash64("tile_id"), F.lit(parts)).cast("int").alias("_p"), F.explode(blocks).alias("_b"))
    both = t.join(q.hint("shuffle_hash"), ["_b", "_p"])
    return both.select("query_id", "tile_id", "scene_id", dot(F.col("embedding"), F.col("query")).alias("similarity"))


def shown(scored: DataFrame) -> DataFrame:
    """The similarity as it is shown: 4 digits, after all ranking."""
    return scored.withColumn("similarity", F.round("similarity", 4))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k most similar tiles of each query, ties by id; each task keeps k before the shuffle."""
    over = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("tile_id"))
    return scored.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)


def percentile_in_scene(scored: DataFrame) -> DataFrame:
    """The share of a scene's tiles that are at most as similar."""
    over = Window.partitionBy("query_id", "scene_id").orderBy("similarity")
    return scored.withColumn("percentile", F.cume_dist().over(over))


def midrank_percentile(rows: DataFrame, group: str, value: str, buckets: int = 256) -> DataFrame:
    """Each row against the pool of its group's values, ties by half: (smaller + not larger) / 2 / n. Null values
    are the smallest. Values are counted first; running counts are in two steps, within sampled ranges of a group's
    values and over the ranges, so that a hot group is as many tasks' work as it has ranges."""
    cuts = sorted(set(rows.approxQuantile(value, [i / buckets for i in range(1, buckets)], 0.2 / buckets)))
    bucket = F.aggregate(F.array(*[F.lit(float(x)) for x in cuts]), F.lit(0), lambda n, x: n + (F.col("_v") >= x).cast("int")) if cuts else F.lit(0)
    counts = rows.groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_n")).withColumn("_b", F.coalesce(bucket, F.lit(-1)))
    ranges = counts.groupBy("_g", "_b").agg(F.sum("_n").alias("_s"))  # at most `buckets` + 1 rows a group
    ranges = ranges.select(F.col("_g").alias("_h"), F.col("_b").alias("_c"), (F.sum("_s").over(Window.partitionBy("_g").orderBy("_b")) - F.col("_s")).alias("_off"), F.sum("_s").over(Window.partitionBy("_g")).alias("_total"))
    placed = counts.withColumn("_in", F.sum("_n").over(Window.partitionBy("_g", "_b").orderBy("_v")))
    placed = placed.join(ranges, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_b") == F.col("_c")))
    pct = placed.select("_g", "_v", ((2 * (F.col("_off") + F.col("_in")) - F.col("_n")) / 2 / F.col("_total")).alias("percentile"))
    return rows.join(pct, rows[group].eqNullSafe(F.col("_g")) & rows[value].eqNullSafe(F.col("_v"))).drop("_g", "_v")


def renumbered(rows: DataFrame, key: str, buckets: int = 64) -> DataFrame:
    """V9: dense numbers from 0 in the order of key, as dense_id: numbers within sampled ranges of key, and the counts
    of the ranges before; no window is over all rows."""
    cuts = sorted(set(rows.approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.2 / buckets)))
    bucket = F.aggregate(F.array(*[F.lit(float(x)) for x in cuts]), F.lit(0), lambda n, x: n + (F.col(key) >= x).cast("int")) if cuts else F.lit(0)
    dealt = rows.withColumn("_b", bucket)
    before = dealt.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_off", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n"))  # at most `buckets` rows
    numbered = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy(key)))
    return numbered.join(F.broadcast(before.drop("_n")), "_b").withColumn("dense_id", F.col("_off") + F.col("_i") - 1).drop("_b", "_i", "_off")


def appended(index: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New vectors behind those that are there. A batch with one that is not finite is refused whole; rows whose
    key is there already are left out."""
    if new.where(~finite(F.col("embedding"))).limit(1).count():
        raise ValueError("a vector of the batch is not finite")
    return index.unionByName(new.join(index.select(key), key, "left_anti"))


# --- an index of lists -----------------------------------------------------------------------------------------

#: About as many vectors are clustered to find the lists' centres. Every vector is in the index.
FIT_ROWS = 20_000


def _placed(rows: DataFrame, v: Column) -> DataFrame:
    """rows with a vector of length one for the clustering; rows whose vector is null or not finite are left out."""
    return rows.where(finite(v)).withColumn("_v", array_to_vector(normalised(F.transform(v, lambda x: x.cast("double")))))


def fit_lists(tiles: DataFrame, lists: int = 64, rows: int = FIT_ROWS) -> KMeansModel:
    """V2: centres of `lists` lists, by k-means over about `rows` vectors that a hash of their id picks."""
    share = min(1.0, rows / max(1, tiles.count()))
    picked = tiles.where(F.pmod(F.xxhash64("tile_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    return KMeans(k=lists, seed=0, maxIter=10, featuresCol="_v", predictionCol="list").fit(_placed(picked, F.col("embedding")))


def indexed(tiles: DataFrame, model: KMeansModel) -> DataFrame:
    """V2: every vector with the list of its nearest centre. One pass without a shuffle."""
    return model.transform(_placed(tiles, F.col("embedding"))).select("tile_id", "scene_id", "embedding", "list")


def save_index(index: DataFrame, model: KMeansModel, path: str) -> None:
    """The index as a table by list, its centres beside it. What is at path already is never overwritten; a table
    without its _SUCCESS file was not finished."""
    index.repartition("list", F.pmod(F.xxhash64("tile_id"), F.lit(8))).write.partitionBy("list").parquet(f"{path}/lists")
    model.save(f"{path}/centres")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, KMeansModel]:
    """An index and its centres. An unreadable one is an error and stays as it is, so that it can be recovered."""
    return spark.read.parquet(f"{path}/lists"), KMeansModel.load(f"{path}/centres")


def with_lists(queries: DataFrame, model: KMeansModel) -> DataFrame:
    """Queries with the numbers of all lists, the nearest centre first. The centres are one row."""
    one = queries.sparkSession.createDataFrame([([c.tolist() for c in model.clusterCenters()],)], "_centres array<array<double>>")
    unit = normalised(F.transform("query", lambda x: x.cast("double")))
    near = F.transform("_centres", lambda c, i: F.struct((dot(c, F.col("_unit")) - dot(c, c) / 2).alias("s"), (-i).alias("i")))
    placed = queries.where(finite(F.col("query"))).withColumn("_unit", unit).join(F.broadcast(one), F.lit(True))
    return placed.withColumn("lists", F.transform(F.sort_array(near, asc=False), lambda x: -x["i"])).drop("_centres", "_unit")


def probes_for(index: DataFrame, queries: DataFrame, k: int, recall: float = 0.97) -> int:
    """The lists to read for each query so that this share of its k nearest is found: measured on FEW of the queries
    (rows of with_lists, by a hash of their id) against all vectors. Vectors in clumps need few lists, evenly spread
    ones more than half."""
    few = queries.orderBy(F.xxhash64("query_id")).limit(FEW)
    hits = top_k(pairs.nearest(index, few, k), k).select("query_id", "tile_id")
    place = F.array_position("lists", F.col("list"))
    at = hits.join(index.select("tile_id", "list"), "tile_id").join(few.select("query_id", "lists"), "query_id").select(place.alias("place"))
    most = at.agg(F.percentile("place", F.lit(recall))).first()[0]
    return math.ceil(most or 1)


def similarities_in_lists(index: DataFrame, queries: DataFrame, probes: int, parts: int = 8) -> DataFrame:
    """similarities of queries (rows of with_lists) with the vectors of their `probes` nearest lists. A list is dealt
    into `parts` shares, so that a large one is several groups."""
    q = queries.select("query_id", "query", F.explode(F.slice("lists", 1, probes)).alias("list"))
    q = q.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_p"))
    t = index.withColumn("_p", F.pmod(F.xxhash64("tile_id"), F.lit(parts)).cast("int"))
    return t.join(q, ["list", "_p"]).select("query_id", "tile_id", "scene_id", dot(F.col("embedding"), F.col("query")).alias("similarity"))


def nearest_in_lists(index: DataFrame, queries: DataFrame, probes: int, k: int, block: int = pairs.BLOCK, share: int = pairs.SHARE) -> DataFrame:
    """(query_id, tile_id, scene_id, similarity) with rows of at least the k most similar vectors of each query (rows of
    with_lists) in its `probes` nearest lists. A list meets those that ask for it in groups: large lists are cut into shares,
    queries into blocks, and a group sends on k of each query."""
    blocks = max(1, -(-queries.count() // block))
    sizes = F.broadcast(index.groupBy("list").agg(F.ceil(F.count("*") / share).cast("int").alias("_n")))  # a row a list
    q = queries.select("query_id", "query", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("_b"), F.explode(F.slice("lists", 1, probes)).alias("list"))
    q = q.join(sizes, "list").withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    t = index.join(sizes, "list").withColumn("_p", F.pmod(F.xxhash64("tile_id"), "_n").cast("int"))
    t = t.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return pairs.nearest_in_groups(t, q, ["list", "_p", "_b"], k, 64 * blocks)
