"""TIFF headers on files made here, the index of lists against exact search, import steps by a small case."""

import struct

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from geochange import queries as engine
from geochange.operators import catalog, vector
from geochange.sources import rasters

D = "/root/testdata/sf0.01"


def tiff(order: str, width: int, height: int, bands: int, grid: tuple | None, keys: tuple, nodata: bytes = b"", late: bool = False) -> bytes:
    """A TIFF of a header alone; late: its directory behind 100,000 other bytes."""
    fields = [(256, "H", (width,)), (257, "H", (height,)), (258, "H", (16,) * bands), (277, "H", (bands,)), (339, "H", (1,) * bands)]
    if grid:
        fields += [(33550, "d", (grid[0], grid[0], 0.0)), (33922, "d", (0.0, 0.0, 0.0, grid[1], grid[2], 0.0))]
    if keys:
        fields.append((34735, "H", (1, 1, 0, len(keys), *[x for k, v in keys for x in (k, 0, 1, v)])))
    if nodata:
        fields.append((42113, "c", tuple(bytes([b]) for b in nodata + b"\0")))
    kinds = {"H": 3, "d": 12, "c": 2}
    at = 8 + (100_000 if late else 0)
    behind, rest, entries = at + 2 + 12 * len(fields) + 4, b"", b""
    for tag, code, values in fields:
        raw = struct.pack(f"{order}{len(values)}{code}", *values)
        entries += struct.pack(order + "HHI", tag, kinds[code], len(values))
        if len(raw) <= 4:
            entries += raw.ljust(4, b"\0")
        else:
            entries += struct.pack(order + "I", behind + len(rest))
            rest += raw
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", at)
    return head + b"\0" * (at - 8) + struct.pack(order + "H", len(fields)) + entries + b"\0" * 4 + rest


def test_raster_headers(spark, tmp_path):
    utm = ((1024, 1), (3072, 32643))
    (tmp_path / "scene 2024-01-15.tif").write_bytes(tiff("<", 100, 50, 3, (24.0, 300000.0, 3100000.0), utm, b"0"))
    (tmp_path / "late_LISS3.TIF").write_bytes(tiff(">", 10, 20, 4, (10.0, 500000.0, 0.0), utm, late=True))
    (tmp_path / "degrees.tif").write_bytes(tiff("<", 10, 10, 1, (0.5, 70.0, 20.0), ((1024, 2), (2048, 4326))))
    (tmp_path / "plain.tif").write_bytes(tiff("<", 400, 300, 4, None, ()))
    (tmp_path / "large.tif").write_bytes(b"II+\0" + b"\0" * 20)
    (tmp_path / "empty.tif").write_bytes(b"")
    (tmp_path / "cut.tif").write_bytes(tiff("<", 10, 10, 1, None, ())[:20])
    got = {r.name: r for r in rasters.raster_headers(spark, str(tmp_path)).collect()}
    assert len(got) == 7
    a = got["scene 2024-01-15.tif"]
    assert (a.width, a.height, a.bands, a.dtype, a.nodata, a.epsg, a.projected, a.res_x) == (100, 50, 3, "uint16", 0.0, 32643, True, 24.0)
    assert (a.min_x, a.min_y, a.max_x, a.max_y) == (300000.0, 3098800.0, 302400.0, 3100000.0)
    assert (a.scene_id, a.sensor, str(a.acquired)) == ("scene_2024-01-15", "liss3", "2024-01-15")
    assert 72.9 < a.west < a.east < 73.1 and 27.9 < a.south < a.north < 28.1 and len(a.sha256) == 64
    b = got["late_LISS3.TIF"]
    assert (b.width, b.height, b.sensor, b.nodata) == (10, 20, "liss3", None) and b.west == pytest.approx(75.0) and b.north == pytest.approx(0.0)
    assert (got["degrees.tif"].west, got["degrees.tif"].south, got["degrees.tif"].east, got["degrees.tif"].north) == (70.0, 15.0, 75.0, 20.0)
    p = got["plain.tif"]
    assert (p.min_x, p.min_y, p.max_x, p.max_y, p.epsg, p.projected) == (0.0, 0.0, 400.0, 300.0, None, False)
    assert (p.west, p.north) == (78.9629 - 0.5, 20.5937 + 0.5)
    for bad in ("large.tif", "cut.tif", "empty.tif"):
        assert got[bad].problem and got[bad].width is None and got[bad].west is None
    assert rasters.raster_bounds(spark, str(tmp_path)).columns == ["path", "min_x", "min_y", "max_x", "max_y", "west", "south", "east", "north"]


def test_index_recall(spark):
    exact = {(r.query_id, r.tile_id) for r in engine.knn_exact(spark, D).collect()}
    found = {(r.query_id, r.tile_id) for r in engine.knn_indexed(spark, D).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_index_reads_few_lists_of_clumped_vectors_and_is_kept(spark, tmp_path):
    x = F.pmod("id", F.lit(8))
    v = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i == x, 1.0).otherwise(F.pmod(F.xxhash64("id", i), F.lit(100)) / 2000.0))
    tiles = spark.range(400).select(F.col("id").alias("tile_id"), F.lit(0).cast("long").alias("scene_id"), v.alias("embedding"))
    odd = spark.createDataFrame([(900, 0, None), (901, 0, [float("nan")] * 8)], "tile_id long, scene_id long, embedding array<double>")
    model = vector.fit_lists(tiles.unionByName(odd), 8)
    index = vector.indexed(tiles.unionByName(odd), model)
    assert index.count() == 400
    q = vector.with_lists(tiles.where("tile_id % 20 = 0").select(F.col("tile_id").alias("query_id"), F.col("embedding").alias("query")), model)
    assert vector.probes_for(index, q, 5) <= 2
    vector.save_index(index, model, str(tmp_path / "index"))
    again, centres = vector.load_index(spark, str(tmp_path / "index"))
    assert again.count() == 400 and len(centres.clusterCenters()) == 8
    got = vector.top_k(vector.similarities_in_lists(again, q, 2), 5)
    assert got.count() == 20 * 5 and got.where("rank = 1 and tile_id <> query_id").count() <= 20
    with pytest.raises(AnalysisException):
        vector.save_index(index, model, str(tmp_path / "index"))


def test_step_progress(spark):
    rows = [
        ("a", 1, "bands", "active", None, None), ("a", 2, "crops", "pending", None, None), ("a", 3, "bands", "done", None, None), ("a", 4, "crops", "active", 3, 9),
        ("a", 5, "embed", "active", None, None), ("a", 6, None, "failed", None, None), ("a", 7, None, "done", None, None), ("a", 8, "crops", "done", None, None),
        ("b", 1, "bands", "active", None, None), ("b", 2, "index", "pending", None, None), ("b", 3, "bands", "done", None, None), ("b", 4, None, "done", None, None),
        ("c", 1, "bands", "active", None, None),
    ]
    events = spark.createDataFrame(rows, "pipeline_id string, seq int, step string, state string, done int, total int").withColumn("noted_at", F.timestamp_seconds(F.col("seq") * 10))
    got = {(r.pipeline_id, r.step): (r.pipeline_state, r.place, r.state, r.done, r.total, r.seconds) for r in catalog.step_progress(events).collect()}
    assert got == {
        ("a", "bands"): ("failed", 1, "done", None, None, 20.0), ("a", "crops"): ("failed", 2, "failed", 3, 9, None), ("a", "embed"): ("failed", 3, "active", None, None, None),
        ("b", "bands"): ("done", 1, "done", None, None, 20.0), ("b", "index"): ("done", 2, "skipped", None, None, None),
        ("c", "bands"): ("running", 1, "active", None, None, None),
    }
    assert catalog.step_progress(events.limit(0)).count() == 0
