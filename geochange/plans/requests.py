"""Checks of requests that come as rows: each function adds `problem`, what the first broken bound is, or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

#: Bounds of requests.
DEFAULT_TOP_K, MAX_TOP_K, MAX_QUERY = 10, 100, 500
SCENE_PATTERN, TILE_PATTERN = r"^[\w\-.]{1,200}$", r"^[A-Za-z0-9_.-]{1,300}$"
DEFAULT_RADIUS_M, MAX_RADIUS_M, DEFAULT_THRESHOLD, MAX_NAME = 500.0, 50_000.0, 0.5, 100


def _first(**broken: Column) -> Column:
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in broken.items()])


def _top_k() -> Column:
    return F.coalesce("top_k", F.lit(DEFAULT_TOP_K))


def checked_searches(rows: DataFrame) -> DataFrame:
    """P14. rows: query, top_k (null: 10), scene_id (null: every scene)."""
    text = F.coalesce("query", F.lit(""))
    return rows.withColumns({
        "problem": _first(
            query=(F.length(text) > MAX_QUERY) | ~text.rlike(r"\S"),
            top_k=~_top_k().between(1, MAX_TOP_K),
            scene_id=~F.col("scene_id").rlike(SCENE_PATTERN),
        ),
        "top_k": _top_k(),
    })


def checked_similar(rows: DataFrame) -> DataFrame:
    """P14. rows: tile_id, vector_id and candidate_id, of which one is the seed, and top_k."""
    seeds = sum(F.col(c).isNotNull().cast("int") for c in ("tile_id", "vector_id", "candidate_id"))
    return rows.withColumns({
        "problem": _first(
            seed=seeds != 1,
            tile_id=~F.col("tile_id").rlike(TILE_PATTERN),
            vector_id=F.col("vector_id") < 0,
            candidate_id=F.col("candidate_id") < 1,
            top_k=~_top_k().between(1, MAX_TOP_K),
        ),
        "top_k": _top_k(),
    })


def checked_watches(rows: DataFrame) -> DataFrame:
    """P14, F10. rows: name, either min_x .. max_y or lon and lat with radius_m (null: 500), threshold (null: 0.5).
    Rows without a problem get their box: the one given, or the one around the centre."""
    given = [F.col(c).isNotNull() for c in S.BOX]
    some, whole = given[0] | given[1] | given[2] | given[3], given[0] & given[1] & given[2] & given[3]
    centre, point = F.col("lon").isNotNull() | F.col("lat").isNotNull(), F.col("lon").isNotNull() & F.col("lat").isNotNull()
    b = S.box()
    ordered = (b["min_x"] >= -180) & (b["min_x"] < b["max_x"]) & (b["max_x"] <= 180) & (b["min_y"] >= -90) & (b["min_y"] < b["max_y"]) & (b["max_y"] <= 90)
    radius, threshold = F.coalesce("radius_m", F.lit(DEFAULT_RADIUS_M)), F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD))
    problem = _first(
        name=F.length("name") > MAX_NAME,
        place=(some == centre) | (some & ~whole) | (centre & ~point),
        bounds=whole & ~ordered,
        center=point & ~(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)),
        radius_m=(radius <= 0) | (radius > MAX_RADIUS_M),
        threshold=~threshold.between(0, 1),
    )
    around = S.box_around(F.col("lon"), F.col("lat"), radius)
    out = rows.withColumns({"problem": problem, "_threshold": threshold, **{f"_{k}": F.coalesce(b[k], around[k]) for k in S.BOX}})
    fine = F.col("problem").isNull()
    return out.withColumns({"threshold": F.col("_threshold"), **{k: F.when(fine, F.col(f"_{k}")) for k in S.BOX}}).drop("_threshold", *[f"_{k}" for k in S.BOX])
