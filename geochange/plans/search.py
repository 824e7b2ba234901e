"""Hybrid search: detections of the analysed pairs around a scene, ranked by how well their after-scene tile matches a
query, and by confidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import pairs, spatial, vector
from ..params import P


def after_tiles(candidates: DataFrame, scored: DataFrame, tiles: DataFrame, cell: float = 2.0) -> DataFrame:
    """Each candidate's best tile in its after-scene among those that meet it, and that tile's similarity and
    percentile, taken over all tiles of the scene before any is left out. Ties go to the smaller id. Only after-scenes
    of candidates are ranked."""
    wanted = scored.join(candidates.select(F.col("scene_b").alias("scene_id")).distinct(), "scene_id", "left_semi")
    boxed = vector.percentile_in_scene(wanted).join(tiles.select("tile_id", *S.BOX), "tile_id")
    pairs = spatial.box_join(candidates.select("candidate_id", *S.BOX, F.col("scene_b").alias("scene")), boxed.withColumn("scene", F.col("scene_id")), cell, keys=("scene",))
    rank = F.struct(F.col("r.similarity").alias("s"), (-F.col("r.tile_id")).alias("t"), F.col("r.percentile").alias("p"))
    best = pairs.groupBy(F.col("l.candidate_id").alias("candidate_id"), F.col("r.query_id").alias("query_id")).agg(F.max(rank).alias("k"))
    return best.select("query_id", "candidate_id", (-F.col("k.t")).alias("tile_id"), F.col("k.s").alias("similarity"), F.col("k.p").alias("percentile"))


def scope_scenes(places: DataFrame, scene_id: int | None) -> DataFrame:
    """A scene and those of its sensor whose footprint meets its own; every scene where none is given."""
    if scene_id is None:
        return places.select("scene_id")
    one = places.where(F.col("scene_id") == scene_id)
    near = spatial.box_join(one, places, 8.0, keys=("sensor",)).select(F.col("r.scene_id").alias("scene_id"))
    return one.select("scene_id").union(near).distinct()


@dataclass(frozen=True)
class ChangeSearch:
    """jobs: all in scope; completed: those that count, with dates and coverage; pool: their detections; matches: the
    list; status: one row."""

    jobs: DataFrame
    completed: DataFrame
    pool: DataFrame
    scored: DataFrame
    matches: DataFrame
    status: DataFrame


def change_search(view: DataFrame, jobs: DataFrame, scored: DataFrame, tiles: DataFrame, places: DataFrame, query_text: str, scene_id: int | None = None, top_k: int = P.search_top_k, cap: int = P.match_cap, cell: float = 2.0) -> ChangeSearch:
    """V10, A8, J5, T10. Scope first: pairs of which both scenes are in it, and of these the completed ones' detections;
    of those the ones that meet one of the top_k tiles of the search; each is scored by its best after-scene tile, and
    those of the percentile or more are listed by combined score, which a direction that the text hints at lifts."""
    scope = scope_scenes(places, scene_id)
    both = jobs
    for side in "ab":
        both = both.join(scope.withColumnRenamed("scene_id", f"scene_{side}"), f"scene_{side}", "left_semi")
    dates = places.select("scene_id", "acquired")
    for side in "ab":
        both = both.join(dates.toDF(f"scene_{side}", f"date_{side}"), f"scene_{side}", "left")
    both = both.withColumn("coverage", S.job_coverage(F.col("details")))
    done = both.where("status = 'completed'")
    pool = view.join(done.select("scene_a", "scene_b"), ["scene_a", "scene_b"], "left_semi")
    searched = scored if scene_id is None else scored.where(F.col("scene_id") == scene_id)
    hits = vector.top_k(searched, top_k).join(tiles.select("tile_id", *S.BOX), "tile_id")
    met = spatial.box_join(pool.select("candidate_id", *S.BOX), hits, cell).select(F.col("l.candidate_id").alias("candidate_id")).distinct()
    near = pool.join(met, "candidate_id", "left_semi")
    best = after_tiles(near, scored, tiles, cell)
    hints = S.hinted_directions(F.lit(query_text))
    score = S.py_round(S.combined_score(F.col("percentile"), F.col("confidence"), F.array_contains(hints, F.col("direction"))), 4)
    rated = near.join(best, "candidate_id", "left").withColumn("score", score)
    good = rated.where(F.col("percentile") >= P.match_percentile)
    # Ties in the rounded score stay in the order of the catalogue.
    listed = good.orderBy(F.desc("score"), F.desc("confidence"), F.desc("area_px"), F.asc("candidate_id")).limit(cap)
    matches = vector.shown(listed.select("query_id", "candidate_id", "tile_id", "similarity", "percentile", "confidence", "direction", "change_type", "review", "score"))
    n_jobs = both.agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "completed").alias("completed"))
    seen = done.agg(F.min("date_a").alias("first_date"), F.max("date_b").alias("last_date"), S.py_round(F.min("coverage"), 4).alias("valid_coverage"))
    days = done.select(F.explode(F.array("date_a", "date_b")).alias("d")).where("d is not null").agg(F.array_join(F.array_sort(F.collect_set(F.col("d").cast("string"))), ",").alias("dates_analysed"))
    n_pool = pool.agg(F.count("*").alias("changes"))
    n_rated = rated.agg(F.count_if(F.col("percentile") >= P.match_percentile).alias("matching"), F.count_if(F.col("percentile").isNull()).alias("unscored"))
    one = n_jobs
    for other in (seen, days, n_pool, n_rated):  # single rows
        one = one.join(other, F.lit(True))
    status = F.when(F.col("completed") == 0, "no_comparison_available").when(F.col("changes") == 0, "no_change_detected").when(F.col("matching") == 0, "no_match").otherwise("found")
    return ChangeSearch(both, done, pool, scored, matches, one.withColumn("status", status))


def searched_pairs(found: ChangeSearch) -> DataFrame:
    """The completed pairs of a search with dates, coverage and how many detections each has."""
    n = found.pool.groupBy("scene_a", "scene_b").agg(F.count("*").alias("candidates"))
    out = found.completed.join(n, ["scene_a", "scene_b"], "left")
    return out.select("scene_a", "scene_b", "date_a", "date_b", "coverage", F.coalesce("candidates", F.lit(0)).alias("candidates"))


def search_hits(tiles: DataFrame, queries: DataFrame, places: DataFrame, k: int = P.search_top_k) -> DataFrame:
    """The top_k hits of queries (query_id, query) that have a tile row and a scene: tiles without a scene go before
    the ranking, so nothing need be fetched in excess."""
    known = tiles.join(places.select("scene_id"), "scene_id", "left_semi")
    hits = vector.top_k(pairs.nearest(known, queries, k), k).drop("rank")
    shown = hits.join(tiles.select("tile_id", *S.BOX), "tile_id").join(places.select("scene_id", "name", "acquired"), "scene_id")
    return vector.shown(vector.top_k(shown, k))


def similar_changes(candidates: DataFrame, jobs: DataFrame, seed_id: int, tiles: DataFrame, k: int = P.search_top_k) -> DataFrame:
    """V7, V8: other detections of completed jobs by the similarity of their best after-scene tile to the seed's tile;
    those whose best tile is the seed's own are left out, as they match trivially."""
    seed = spatial.seed_tile(candidates.where(F.col("candidate_id") == seed_id), tiles.join(candidates.where(F.col("candidate_id") == seed_id).select(F.col("scene_b").alias("scene_id")), "scene_id", "left_semi"))
    query = seed.join(tiles.select("tile_id", F.col("embedding").alias("query")), "tile_id").select(F.col("tile_id").alias("query_id"), "query")
    others = candidates.where(F.col("candidate_id") != seed_id).join(jobs.where("status = 'completed'").select("scene_a", "scene_b"), ["scene_a", "scene_b"], "left_semi")
    best = after_tiles(others, vector.similarities(tiles, query), tiles).where(F.col("tile_id") != F.col("query_id"))
    rounded = vector.shown(best).join(others.select("candidate_id", "confidence", "area_px"), "candidate_id")
    return rounded.orderBy(F.desc("similarity"), F.desc("confidence"), F.desc("area_px"), F.asc("candidate_id")).limit(k).select("candidate_id", "tile_id", "similarity")
