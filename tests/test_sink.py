"""Levels against plain means, writes that stop, windows that open their own chunks, and pictures read back."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geochange.operators import raster
from geochange.sources import sink


def _pixels(spark, h=75, w=90):
    px = spark.range(h * w).select(F.floor(F.col("id") / w).alias("r"), (F.col("id") % w).alias("c"))
    v = F.pmod(F.xxhash64("r", "c"), F.lit(5000))
    return px.withColumns({"b04": F.when(v % 11 != 0, v).cast("int"), "b08": (v * 2).cast("int"), "scl": (v % 12).cast("int")})


@pytest.mark.parametrize("chunk", [16, 64])
def test_levels_are_block_means(spark, chunk):
    px = _pixels(spark)
    got = sink.pyramid(px, ["b04", "b08"], ["scl"], chunk=chunk)
    assert dict(got.dtypes)["scl"] == "int"
    rows = {(r.level, r.r, r.c): (r.b04, r.b08, r.scl) for r in got.collect()}
    assert {(k[1], k[2]): v for k, v in rows.items() if k[0] == 1} == {(r.r, r.c): (r.b04, float(r.b08), r.scl) for r in px.collect()}
    for k in (2, 4, 8, 16):
        want = {(r.r, r.c): [r.b04, r.b08, None] for r in raster.overview(px, "b04", k).join(raster.overview(px, "b08", k), ["r", "c"]).collect()}
        for r in raster.overview(px, "scl", k, categorical=True).collect():
            want[r.r, r.c][2] = r.scl
        own = {(a, b): v for (level, a, b), v in rows.items() if level == k}
        assert own.keys() == want.keys()
        for at, v in own.items():
            assert v == tuple(pytest.approx(x, abs=1e-6) if isinstance(x, float) else x for x in want[at])
    with pytest.raises(ValueError):
        sink.pyramid(px, ["b04"], levels=(3,), chunk=16)


def test_a_stopped_write_is_not_seen(spark, tmp_path):
    path, px = str(tmp_path / "raster"), _pixels(spark)
    with pytest.raises(FileNotFoundError):
        sink.read_raster(spark, path)
    with pytest.raises(Exception, match="stopped"):
        sink.write_raster(px.withColumn("b04", F.raise_error(F.lit("stopped")).cast("int")), path, ["b04"], 75, 90, chunk=16)
    with pytest.raises(FileNotFoundError):
        sink.read_raster(spark, path)
    sink.write_raster(px, path, ["b04", "b08"], 75, 90, ["scl"], crs="EPSG:32643", transform=[10.0, 0.0, 6e5, 0.0, -10.0, 3e6], chunk=16)
    first = sorted(map(tuple, sink.read_raster(spark, path).collect()), key=repr)
    assert len(first) == 75 * 90
    with pytest.raises(Exception, match="stopped"):
        sink.write_raster(px.where("r < 30").withColumn("b04", F.when(F.col("r") < 20, F.raise_error(F.lit("stopped")).cast("int"))), path, ["b04"], 30, 90, chunk=16)
    assert sorted(map(tuple, sink.read_raster(spark, path).collect()), key=repr) == first
    own = sink.read_raster(spark, path, 4, (3, 9, 2, 20), chunk=16)
    assert own.count() == 6 * 18 and len([f for f in own.inputFiles()]) >= 1
    assert "PartitionFilters" in own._jdf.queryExecution().executedPlan().toString()
    last = sink.manifest(spark, path)
    assert (last["seq"], last["levels"], last["crs"], last["height"]) == (1, [1, 2, 4, 8, 16], "EPSG:32643", 75)
    sink.write_raster(px.where("r < 32"), path, ["b04"], 32, 90, levels=(2,), chunk=16)
    assert sink.read_raster(spark, path).count() == 32 * 90 and sink.read_raster(spark, path, 2).count() == 16 * 45
    with pytest.raises(ValueError):
        sink.read_raster(spark, path, 16)


def _decoded(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, packed, size = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        packed += body if kind == b"IDAT" else b""
        at += 12 + n
    w, h = size[:2]
    assert size[2:] == (8, 2, 0, 0, 0)
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + 3 * w)
    assert (rows[:, 0] == 0).all()
    return rows[:, 1:].reshape(h, w, 3)


def test_crops_as_pictures(spark):
    rng = np.random.default_rng(4)
    h, w, size = 70, 101, 32
    v = rng.integers(1, 4000, size=(h, w, 3)).astype(float)
    v[:32, 64:96] = rng.integers(1, 200, size=(32, 32, 3))  # bytes already
    v[32:64, :32][rng.random((32, 32)) < 0.6] = 0  # mostly black: no crop
    v[32:64, 32:64][rng.random((32, 32)) < 0.3] = np.nan
    rows = [(i, j, *[None if np.isnan(x) else float(x) for x in v[i, j]]) for i in range(h) for j in range(w) if (i, j) != (40, 70)]
    v[40, 70] = np.nan
    df = spark.createDataFrame(rows, "r long, c long, red double, green double, blue double")
    got = {(r.row_off, r.col_off): r for r in sink.crops(df, ("red", "green", "blue"), h, w, size).collect()}
    assert got.keys() == {(0, 0), (0, 32), (0, 64), (32, 32), (32, 64)}
    for (y, x), r in got.items():
        own = v[y : y + size, x : x + size]
        valid = ~np.isnan(own).any(axis=2) & ~(np.nan_to_num(own) == 0).all(axis=2)
        assert r.valid == pytest.approx(valid.mean()) and r.valid >= 0.5
        want = own
        if np.nanmax(own) > 255:
            low, high = np.percentile(own[valid], [2, 98])
            want = (own - low) / (high - low) * 255
        want = np.where(valid[:, :, None], np.clip(np.nan_to_num(want), 0, 255), 0).astype(np.uint8)
        assert (_decoded(bytes(r.png)) == want).all()
    few = np.full((4, 4), np.nan)
    few[0, :2] = [700.0, 7000.0]
    image, valid = sink.picture(few, few, few)
    assert image[0, 0, 0] == 51 and image[0, 1, 0] == 255 and valid.sum() == 2 and image[1].max() == 0
