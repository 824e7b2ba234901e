"""Headers of TIFF rasters as rows: size, bands, type, grid and bounds, without a pixel read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import tiff

#: Centre of the box that stands for a raster of unknown place.
UNKNOWN_LON, UNKNOWN_LAT = 78.9629, 20.5937

def _with_lonlat_bounds(rows: DataFrame) -> DataFrame:
    """The box in degrees: of the corners for a UTM zone, the bounds where they are degrees (or could be), else a box of
    one degree at a fixed place."""
    zone, south = F.col("epsg") % 100, F.col("epsg") >= 32700
    utm = F.col("epsg").between(32601, 32660) | F.col("epsg").between(32701, 32760)
    ends = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x in ("min_x", "max_x") for y in ("min_y", "max_y")])
    placed = F.transform(ends, lambda p: F.struct(*[v.alias(k) for k, v in S.lonlat(zone, p["x"], p["y"], south).items()]))
    degrees = (F.col("epsg") == 4326) | ((F.col("min_x") >= -180) & (F.col("max_x") <= 180) & (F.col("min_y") >= -90) & (F.col("max_y") <= 90))
    out = {}
    for side, of, pick, at in (("west", "lon", F.array_min, "min_x"), ("south", "lat", F.array_min, "min_y"), ("east", "lon", F.array_max, "max_x"), ("north", "lat", F.array_max, "max_y")):
        away = (UNKNOWN_LON if of == "lon" else UNKNOWN_LAT) + (-0.5 if pick is F.array_min else 0.5)
        out[side] = F.when(F.col("width").isNotNull(), F.when(utm, pick(F.col("_corners")[of])).when(degrees, F.col(at)).otherwise(F.lit(away)))
    return rows.withColumn("_corners", F.when(utm, placed)).withColumns(out).drop("_corners")


def raster_headers(spark: SparkSession, root: str, digest: bool = True) -> DataFrame:
    """A row for each TIFF under root: what the header says, bounds in degrees, id, sensor and date by name, and unless
    it isn't asked for the digest, which alone reads a file whole.

    Files that are no TIFF or are cut off have a `problem` and no header. Projections other than UTM have no bounds in
    degrees of their own (see _with_lonlat_bounds)."""
    out = _with_lonlat_bounds(tiff.read_headers(spark, root, digest).withColumn("name", F.regexp_extract("path", r"([^/\\]+)$", 1)))
    by_name, by_grid = S.detect_sensor(F.col("name")), S.infer_sensor(F.col("bands"), F.col("projected"), F.col("res_x"))
    sensor = F.when(by_name != "unknown", by_name).otherwise(F.coalesce(by_grid, F.lit("unknown")))
    return out.withColumns({"scene_id": S.safe_id(F.regexp_replace("name", r"\.[^.]*$", "")), "sensor": sensor, "acquired": S.acquisition_date(F.col("name"))})


def raster_bounds(spark: SparkSession, root: str) -> DataFrame:
    """Bounds alone, in the raster's own units and in degrees."""
    return raster_headers(spark, root, digest=False).select("path", "min_x", "min_y", "max_x", "max_y", "west", "south", "east", "north")
