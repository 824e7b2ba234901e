"""Rasters written with all their levels, and pictures of crops.

A raster is written under a version of its own, a folder for each level and chunk; one row in its manifest then names the
version, its grid and its levels. Readers go by the manifest's last row, so a write that stopped isn't seen, and what
was there before it stays until the new one is whole.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Factors of the levels, and pixels of a crop's side.
LEVELS = (2, 4, 8, 16)
CROP = 224
#: Rows and columns of a chunk at full size; a level's chunks are of as many pixels of its own.
CHUNK = 512
MANIFEST = "seq long, version string, height long, width long, bands array<string>, classes array<string>, levels array<int>, crs string, transform array<double>"


def pyramid(pixels: DataFrame, bands: list[str], classes: list[str] = (), levels: tuple[int, ...] = LEVELS, chunk: int = CHUNK) -> DataFrame:
    """(level, r, c, bands, classes): pixels (r, c, ...) at each level, 1 being the pixels themselves, all in one pass. Bands
    are means of a block's pixels that have a value, classes the value of the block's first pixel."""
    if chunk % max(levels, default=1) or any(k < 2 for k in levels):
        raise ValueError("each level's factor must be over 1 and divide the chunk")
    names = [*bands, *classes]
    kinds = dict(pixels.dtypes)
    placed = pixels.select("r", "c", *names, F.floor(F.col("r") / chunk).alias("cr"), F.floor(F.col("c") / chunk).alias("cc"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["cr"].iloc[0]) * chunk, int(pdf["cc"].iloc[0]) * chunk
        y, x = pdf["r"].to_numpy() - r0, pdf["c"].to_numpy() - c0
        dense = {}
        for n in names:
            dense[n] = np.full((chunk, chunk), np.nan)
            dense[n][y, x] = pdf[n].to_numpy(dtype=float)
        there = np.zeros((chunk, chunk), dtype=bool)
        there[y, x] = True
        out = []
        for k in (1, *levels):
            m = chunk // k
            block = lambda a, k=k, m=m: a.reshape(m, k, m, k)
            some = block(there).any(axis=(1, 3))
            own = {}
            for n in bands:
                has = ~np.isnan(dense[n])
                count = block(has).sum(axis=(1, 3))
                total = block(np.where(has, dense[n], 0.0)).sum(axis=(1, 3))
                own[n] = np.where(count > 0, total / np.maximum(count, 1), np.nan)
            for n in classes:
                own[n] = dense[n][::k, ::k]
            i, j = np.nonzero(some)
            out.append(pd.DataFrame({"level": k, "r": i + r0 // k, "c": j + c0 // k, **{n: v[i, j] for n, v in own.items()}}))
        found = pd.concat(out)
        return found.astype({n: object for n in classes}).where(found.notna(), None) if len(classes) else found

    schema = ", ".join(["level int, r long, c long", *[f"`{n}` double" for n in names]])
    made = placed.groupBy("cr", "cc").applyInPandas(work, schema)
    return made.select("level", "r", "c", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in bands], *[F.col(n).cast(kinds[n]).alias(n) for n in classes])


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)


def manifest(spark: SparkSession, path: str):
    """The last row of a raster's manifest; None where nothing was ever published."""
    return _manifest(spark, path).orderBy(F.desc("seq"), F.desc("version")).first()


def write_raster(pixels: DataFrame, path: str, bands: list[str], height: int, width: int, classes: list[str] = (), levels: tuple[int, ...] = LEVELS, crs: str | None = None, transform: list[float] | None = None, chunk: int = CHUNK) -> str:
    """Writes a raster with its levels and publishes it, in place of what its manifest named before. Returns the version."""
    spark = pixels.sparkSession
    version = uuid.uuid4().hex
    made = pyramid(pixels, bands, classes, levels, chunk).withColumns({"cr": F.floor(F.col("r") / chunk), "cc": F.floor(F.col("c") / chunk)})
    made.repartition("level", "cr", "cc").sortWithinPartitions("level", "cr", "cc", "r", "c").write.partitionBy("level", "cr", "cc").parquet(f"{path}/v={version}")
    last = manifest(spark, path)
    row = ((last["seq"] if last else 0) + 1, version, height, width, list(bands), list(classes), [1, *levels], crs, transform)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def read_raster(spark: SparkSession, path: str, level: int = 1, window: tuple[int, int, int, int] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(r, c, bands, classes) of a published raster at a level, of a window (first row, row after the last, first column,
    column after the last) in that level's pixels: only its chunks' files are opened."""
    last = manifest(spark, path)
    if last is None:
        raise FileNotFoundError(f"no raster was published at {path}")
    if level not in last["levels"]:
        raise ValueError(f"level: one of {last['levels']}")
    rows = spark.read.parquet(f"{path}/v={last['version']}").where(F.col("level") == level)
    if window:
        r0, r1, c0, c1 = window
        rows = rows.where(F.col("cr").between(r0 // chunk, (r1 - 1) // chunk) & F.col("cc").between(c0 // chunk, (c1 - 1) // chunk))
        rows = rows.where(F.col("r").between(r0, r1 - 1) & F.col("c").between(c0, c1 - 1))
    return rows.select("r", "c", *last["bands"], *last["classes"])


def png(image: np.ndarray) -> bytes:
    """An image (rows, columns, 3) of bytes as PNG: rows without a filter, packed by zlib."""
    h, w, _ = image.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def picture(red: np.ndarray, green: np.ndarray, blue: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bands with NaN for no data as bytes (rows, columns, 3), and which pixels are valid: those with all bands, not all
    of them 0. Numbers over 255 are stretched between the 2nd and 98th percentile of all bands' valid pixels, or of a fixed
    3500 where there are ten at most, or they are alike; others are clipped. Invalid pixels are black."""
    rgb = np.stack([red, green, blue]).astype(float)
    valid = ~np.isnan(rgb).any(axis=0) & ~(np.nan_to_num(rgb) == 0).all(axis=0)
    if valid.any() and np.nanmax(rgb) > 255:
        low, high = np.percentile(rgb[:, valid], [2, 98]) if valid.sum() > 10 else (0.0, 0.0)
        rgb = (rgb - low) / (high - low) * 255 if high > low else rgb / 3500.0 * 255
    rgb = np.where(valid, np.clip(np.nan_to_num(rgb), 0, 255), 0)
    return rgb.astype(np.uint8).transpose(1, 2, 0), valid


def crops(pixels: DataFrame, bands: tuple[str, str, str], height: int, width: int, size: int = CROP, least: float = 0.5) -> DataFrame:
    """(row_off, col_off, valid, png binary) of the whole windows of size x size pixels of which at least
    `least` are valid (see picture); bands are red, green and blue. Windows that go over the edge are none."""
    whole = (F.col("r") < height // size * size) & (F.col("c") < width // size * size)
    placed = pixels.where(whole).select("r", "c", *bands, F.floor(F.col("r") / size).alias("i"), F.floor(F.col("c") / size).alias("j"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        dense = []
        for b in bands:
            own = np.full((size, size), np.nan)
            own[pdf["r"].to_numpy() - i * size, pdf["c"].to_numpy() - j * size] = pdf[b].to_numpy(dtype=float)
            dense.append(own)
        image, valid = picture(*dense)
        share = float(valid.mean())
        rows = [(i * size, j * size, share, png(image))] if share >= least else []
        return pd.DataFrame(rows, columns=["row_off", "col_off", "valid", "png"])

    return placed.groupBy("i", "j").applyInPandas(work, "row_off long, col_off long, valid double, png binary")
