"""The NDVI of a detection's own ground in earlier scenes, from their pixels.

An archive is a folder of chunk files, a folder for each scene and chunk. A detection's outline is filled on each scene's grid
by scanlines to spans of rows, which name the chunks that they cross; only those are opened. A span meets its row's pixels
in an equi-join, and a detection is a sum over them.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..params import P
from .raster import kept
from .resampling import Grid, utm_forward
from .spatial import box_join

CHUNK = 512
#: Chunks named to the scan of the archive before it begins; beyond so many rows (24 bytes each) it is a join like any other.
MOST_NAMED = 200_000
_SPANS = "candidate_id long, scene_id long, r long, first long, last long, c0 long, ratio double, n long"


def write_archive(pixels: DataFrame, path: str, chunk: int = CHUNK, mode: str = "append") -> None:
    """Pixels (scene_id, r, c, b04, b08, and scl where there is a mask) as an archive: a file for each scene and chunk."""
    placed = pixels.withColumns({"cr": F.floor(F.col("r") / chunk), "cc": F.floor(F.col("c") / chunk)})
    placed.repartition("scene_id", "cr", "cc").write.mode(mode).partitionBy("scene_id", "cr", "cc").parquet(path)


def scanlines(rings: list[np.ndarray], height: int, width: int) -> list[tuple[int, int, int]]:
    """(row, first, last) of the pixels whose centres lie within rings of (x, y) pixel corners: those that an odd number of
    sides is to the left of, so that holes and parts need no order."""
    a = np.concatenate([r[:-1] for r in rings])
    b = np.concatenate([r[1:] for r in rings])
    out = []
    for row in range(max(0, int(np.floor(min(a[:, 1].min(), b[:, 1].min())))), min(height, int(np.ceil(max(a[:, 1].max(), b[:, 1].max()))))):
        y = row + 0.5
        cut = (a[:, 1] <= y) != (b[:, 1] <= y)
        p, q = a[cut], b[cut]
        x = np.sort(p[:, 0] + (y - p[:, 1]) / (q[:, 1] - p[:, 1]) * (q[:, 0] - p[:, 0]))
        for left, right in zip(x[::2], x[1::2], strict=False):
            first, last = max(0, int(np.ceil(left - 0.5))), min(width - 1, int(np.ceil(right - 0.5)) - 1)
            if last >= first:
                out.append((row, first, last))
    return out


def _to_grid(grid: Grid, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pixel corners (x, y) of places in degrees."""
    x, y = utm_forward(lon, lat, *grid.zone) if grid.zone else (lon, lat)
    sx, _, left, _, sy, top = grid.transform
    return (x - left) / sx, (y - top) / sy


def filled(geometry: str | None, box: tuple[float, float, float, float], grid: Grid, most: int = P.season_sample_px) -> tuple[list[tuple[int, int, int]], int, float]:
    """A detection on a grid: spans (row, first, last column) of sampled pixels, the window's first column, and the columns
    from one sample to the next. The window is that of its box; it is sampled in every so-many-th row and column where it
    has over `most` a side. Without an outline, or where the outline holds no pixel's centre, all of the window counts."""
    t = np.linspace(0, 1, 23)
    west, south, east, north = box
    x, y = _to_grid(grid, np.concatenate([west + (east - west) * t, west + (east - west) * t, np.full(23, west), np.full(23, east)]), np.concatenate([np.full(23, south), np.full(23, north), south + (north - south) * t, south + (north - south) * t]))
    # What is whole but for the rounding of degrees is whole.
    near = lambda v: np.where(np.abs(v - np.rint(v)) < 1e-6, np.rint(v), v)
    c0, r0 = max(0, int(np.floor(near(x.min())))), max(0, int(np.floor(near(y.min()))))
    c1, r1 = min(grid.width, int(np.ceil(near(x.max())))), min(grid.height, int(np.ceil(near(y.max()))))
    if c1 <= c0 or r1 <= r0:
        return [], 0, 1.0
    step = max(1, -(-max(c1 - c0, r1 - r0) // most))
    h, w = max(1, -(-(r1 - r0) // step)), max(1, -(-(c1 - c0) // step))
    down, across = (r1 - r0) / h, (c1 - c0) / w
    inside: list[tuple[int, int, int]] = []
    if geometry:
        shape = json.loads(geometry)
        polygons = shape["coordinates"] if shape["type"] == "MultiPolygon" else [shape["coordinates"]]
        rings = []
        for ring in (r for p in polygons for r in p):
            px, py = _to_grid(grid, *np.array(ring, dtype=float)[:, :2].T)
            rings.append(np.stack([(px - c0) / across, (py - r0) / down], axis=1))
        inside = scanlines(rings, h, w)
    if not inside:
        inside = [(i, 0, w - 1) for i in range(h)]
    at = lambda j: c0 + int((j + 0.5) * across)
    return [(r0 + int((i + 0.5) * down), at(a), at(b)) for i, a, b in inside], c0, across


def spans(wanted: DataFrame) -> DataFrame:
    """(candidate_id, scene_id, r, first, last, c0, ratio, n) of rows (candidate_id, scene_id, geometry, min_lon, min_lat,
    max_lon, max_lat, crs, width, height, transform): see filled. n: samples in the span. A scene that has no grid, or one
    of an unknown system, gives no span."""

    def work(batches):
        for pdf in batches:
            out = []
            for x in pdf.itertuples():
                try:
                    grid = Grid(x.crs, int(x.width), int(x.height), tuple(x.transform))
                    found, c0, ratio = filled(x.geometry, (x.min_lon, x.min_lat, x.max_lon, x.max_lat), grid)
                except (ValueError, TypeError, AttributeError):
                    continue
                for r, a, b in found:
                    n = int((b - c0) / ratio) - int((a - c0) / ratio) + 1
                    out.append((x.candidate_id, x.scene_id, r, a, b, c0, ratio, n))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _SPANS.split(", ")])

    return wanted.mapInPandas(work, _SPANS)


def sampled(spark: SparkSession, archive: str, wanted: DataFrame, chunk: int = CHUNK, least: float = P.season_min_valid, scale: float = 10000.0, offset: float = 0.0) -> DataFrame:
    """(candidate_id, scene_id, ndvi): the mean NDVI over each detection's samples in a scene; null where the scene isn't
    clear there: of its samples under `least` have data and a valid class. wanted: see spans."""
    rows = kept(spans(wanted))
    pieces = rows.withColumn("cc", F.explode(F.sequence(F.floor(F.col("first") / chunk), F.floor(F.col("last") / chunk)))).withColumn("cr", F.floor(F.col("r") / chunk))
    named = kept(pieces.select("scene_id", "cr", "cc").distinct())
    px = spark.read.parquet(archive)
    px = px.select(F.col("scene_id").cast("long"), F.col("cr").cast("long"), F.col("cc").cast("long"), "r", "c", "b04", "b08", *(["scl"] if "scl" in px.columns else []))
    if named.count() <= MOST_NAMED:  # the chunks' folders are picked by them before the scan
        px = px.join(F.broadcast(named.where("cr >= 0 and cc >= 0")), ["scene_id", "cr", "cc"], "left_semi")
    at = F.floor((F.col("c") - F.col("c0")) / F.col("ratio"))
    # A sample's column, or those beside it where rounding moves its number by one.
    hit = F.exists(F.array(at - 1, at, at + 1), lambda j: F.col("c") == F.col("c0") + F.floor((j + 0.5) * F.col("ratio")))
    both = pieces.join(px, ["scene_id", "cr", "cc", "r"]).where(F.col("c").between(F.col("first"), F.col("last")) & hit)
    valid = (F.col("b04") != 0) & (F.col("b08") != 0) & (S.valid_scl(F.col("scl")) if "scl" in px.columns else F.lit(True))
    ndvi = F.when(F.coalesce(valid, F.lit(False)), S.ratio((F.col("b08") + offset) / scale, (F.col("b04") + offset) / scale))
    sums = both.groupBy("candidate_id", "scene_id").agg(F.count_if(valid).alias("valid"), F.sum(ndvi).alias("total"), F.count(ndvi).alias("has"))
    asked = rows.groupBy("candidate_id", "scene_id").agg(F.sum("n").alias("n"))
    clear = (F.col("valid") / F.col("n") >= least) & (F.col("has") > 0)
    return asked.join(sums, ["candidate_id", "scene_id"], "left").select("candidate_id", "scene_id", F.when(clear, F.col("total") / F.col("has")).alias("ndvi"))


def verdicts(spark: SparkSession, candidates: DataFrame, scenes: DataFrame, archive: str, chunk: int = CHUNK, cell: float = 1.0, scale: float = 10000.0, offset: float = 0.0) -> DataFrame:
    """J10, F29 from pixels: (candidate_id, priors, n_clear, prior_mean, prior_std, current, drop_in_std, status, factor).

    candidates: candidate_id, after_scene, sensor, acquired (of the after scene), geometry (GeoJSON, may be null), min_lon,
    min_lat, max_lon, max_lat, centroid_lon, centroid_lat (null: the box's centre). scenes: scene_id, sensor, acquired,
    min_x, min_y, max_x, max_y (their footprints in degrees), crs, width, height, transform. Priors are other scenes of
    the sensor and season of earlier years whose footprint holds the centre. Where there are too few of them nothing is
    read, and the after scene is only read where enough of them are clear."""
    centre = {"x": F.coalesce("centroid_lon", (F.col("min_lon") + F.col("max_lon")) / 2), "y": F.coalesce("centroid_lat", (F.col("min_lat") + F.col("max_lat")) / 2)}
    points = candidates.select("candidate_id", "after_scene", "sensor", "acquired", *[centre[c[-1]].alias(c) for c in S.BOX])
    on = S.same_season(F.col("r.acquired"), F.col("l.acquired")) & (F.col("l.after_scene") != F.col("r.scene_id"))
    near = box_join(points, scenes.select("scene_id", "sensor", "acquired", *S.BOX), cell, on, ("sensor",)).select("l.candidate_id", "r.scene_id")
    near = kept(near)
    n = near.groupBy("candidate_id").agg(F.count("*").alias("priors"))
    enough = n.where(F.col("priors") >= P.season_priors).select("candidate_id")
    grids = scenes.select("scene_id", "crs", "width", "height", "transform")
    shapes = candidates.select("candidate_id", "geometry", "min_lon", "min_lat", "max_lon", "max_lat")

    def looked_up(pairs: DataFrame) -> DataFrame:
        return sampled(spark, archive, pairs.join(shapes, "candidate_id").join(grids, "scene_id"), chunk, scale=scale, offset=offset)

    history = kept(looked_up(near.join(enough, "candidate_id", "left_semi")).groupBy("candidate_id").agg(F.count("ndvi").alias("n_clear"), F.avg("ndvi").alias("prior_mean"), F.stddev_samp("ndvi").alias("prior_std")))
    now = looked_up(history.where(F.col("n_clear") >= P.season_priors).select("candidate_id").join(candidates.select("candidate_id", F.col("after_scene").alias("scene_id")), "candidate_id")).select("candidate_id", F.col("ndvi").alias("current"))
    out = candidates.select("candidate_id").join(n, "candidate_id", "left").join(history, "candidate_id", "left").join(now, "candidate_id", "left")
    clear = F.coalesce("n_clear", F.lit(0))
    spread = F.greatest(F.coalesce("prior_std", F.lit(0.0)), F.lit(P.season_min_std))
    status, factor = S.seasonal_verdict(clear, F.col("prior_mean"), F.coalesce("prior_std", F.lit(0.0)), F.col("current"))
    known = status != "unverified"
    figures = {"prior_mean": F.col("prior_mean"), "prior_std": spread, "current": F.col("current"), "drop_in_std": (F.col("prior_mean") - F.col("current")) / spread}
    return out.select("candidate_id", F.coalesce("priors", F.lit(0)).alias("priors"), clear.alias("n_clear"), *[F.when(known, v).alias(k) for k, v in figures.items()], status.alias("status"), factor.alias("factor"))
