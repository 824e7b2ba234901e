"""The TIFF source on files made here: layouts, compressions and predictors, windows, bytes read, and what can't be read."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql.types import StructType

from geochange.sources import tiff


def make(values, order="<", tile=None, rows=4, planar=False, deflate=False, predictor=1, big=False, late=0, grid=(10.0, 600000.0, 3000000.0), keys=((1024, 1), (3072, 32643)), nodata=b"0"):
    """A TIFF of values (rows, columns, bands); late: bytes of nothing before the directory."""
    h, w, bands = values.shape
    dt = values.dtype.newbyteorder(order)
    bh, bw = tile or (rows, w)
    blocks = []
    for b in range(bands) if planar else [slice(None)]:
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                part = values[y : y + bh, x : x + bw, b]
                part = part[:, :, None] if part.ndim == 2 else part
                if tile:
                    part = np.pad(part, [(0, bh - part.shape[0]), (0, bw - part.shape[1]), (0, 0)])
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                raw = part.astype(dt).tobytes()
                if predictor == 3:
                    n, depth = part.shape[0], part.shape[2]
                    line = np.frombuffer(part.astype(dt.newbyteorder(">")).tobytes(), np.uint8).reshape(n, -1, dt.itemsize).transpose(0, 2, 1).reshape(n, -1, depth)
                    raw = np.concatenate([line[:, :1], line[:, 1:] - line[:, :-1]], axis=1).astype(np.uint8).tobytes()
                blocks.append(zlib.compress(raw) if deflate else raw)
    word, entry, kind_word = ("Q", 20, 16) if big else ("I", 12, 4)
    inline = 8 if big else 4
    start = 16 if big else 8
    spots, body, at = [], b"", start
    for raw in blocks:
        spots.append(at)
        body += raw
        at += len(raw)
    fields = [(256, 4, (w,)), (257, 4, (h,)), (258, 3, (8 * dt.itemsize,) * bands), (259, 3, (8 if deflate else 1,)), (277, 3, (bands,)), (284, 3, (2 if planar else 1,)), (317, 3, (predictor,)), (339, 3, ({"u": 1, "i": 2, "f": 3}[dt.kind],) * bands)]
    fields += [(322, 3, (bw,)), (323, 3, (bh,)), (324, kind_word, tuple(spots)), (325, 4, tuple(map(len, blocks)))] if tile else [(273, kind_word, tuple(spots)), (278, 3, (bh,)), (279, 4, tuple(map(len, blocks)))]
    if grid:
        fields += [(33550, 12, (grid[0], grid[0], 0.0)), (33922, 12, (0.0, 0.0, 0.0, grid[1], grid[2], 0.0))]
    if keys:
        fields.append((34735, 3, (1, 1, 0, len(keys), *[x for k, v in keys for x in (k, 0, 1, v)])))
    if nodata:
        fields.append((42113, 2, tuple(bytes([b]) for b in nodata + b"\0")))
    at += late
    body += b"\0" * late
    code = {2: "c", 3: "H", 4: "I", 12: "d", 16: "Q"}
    behind, entries, rest = at + (8 if big else 2) + entry * len(fields) + (8 if big else 4), b"", b""
    for tag, kind, v in sorted(fields):
        raw = struct.pack(f"{order}{len(v)}{code[kind]}", *v)
        entries += struct.pack(order + "HH" + word, tag, kind, len(v))
        if len(raw) <= inline:
            entries += raw.ljust(inline, b"\0")
        else:
            entries += struct.pack(order + word, behind + len(rest))
            rest += raw
    mark = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    return mark + body + struct.pack(order + ("Q" if big else "H"), len(fields)) + entries + b"\0" * (8 if big else 4) + rest


def image(h=37, w=45, bands=3, dtype=np.uint16, seed=1):
    v = np.random.default_rng(seed).integers(0, 4000, size=(h, w, bands))
    return (v / 7 if np.dtype(dtype).kind == "f" else v % 250 if np.dtype(dtype).itemsize == 1 else v).astype(dtype)


WAYS = [
    {}, {"order": ">"}, {"rows": 10, "deflate": True}, {"tile": (16, 16)}, {"tile": (16, 32), "deflate": True, "predictor": 2}, {"planar": True, "rows": 9}, {"planar": True, "tile": (16, 16), "order": ">", "deflate": True},
    {"big": True, "tile": (16, 16)}, {"big": True, "order": ">", "late": 100_000}, {"late": 70_000, "deflate": True, "predictor": 2, "order": ">"},
]


@pytest.mark.parametrize("way", range(len(WAYS)))
@pytest.mark.parametrize("dtype", [np.uint16, np.uint8, np.float32])
def test_pixels_are_those_that_were_written(spark, tmp_path, way, dtype):
    v, how = image(dtype=dtype), WAYS[way]
    if np.dtype(dtype).kind == "f" and how.get("predictor") == 2:
        how = how | {"predictor": 3}
    (tmp_path / "a.tif").write_bytes(make(v, **how))
    got = {(r.r, r.c): (r.b1, r.b2, r.b3) for r in tiff.read_pixels(spark, str(tmp_path)).collect()}
    assert got == {(i, j): tuple(float(x) for x in v[i, j]) for i, j in np.ndindex(37, 45)}


def test_windows_bands_steps_and_pushed_conditions(spark, tmp_path):
    v = image(64, 80, 4)
    (tmp_path / "one.tif").write_bytes(make(v, tile=(16, 16)))
    (tmp_path / "two.TIFF").write_bytes(make(v + 1, rows=7))
    px = tiff.read_pixels(spark, str(tmp_path), bands=[4, 2], window=(10, 31, 5, 77), step=3)
    assert px.columns == ["path", "r", "c", "b4", "b2"]
    got = {(r.path[-8:], r.r, r.c): (r.b4, r.b2) for r in px.collect()}
    assert got == {(n, i, j): (float(v[i, j, 3] + k), float(v[i, j, 1] + k)) for n, k in (("/one.tif", 0), ("two.TIFF", 1)) for i in range(10, 31, 3) for j in range(5, 77, 3)}
    own = tiff.read_pixels(spark, str(tmp_path / "one.tif")).where("r >= 20 and r < 30 and c = 70")
    assert sorted((r.r, r.c, r.b1) for r in own.collect()) == [(i, 70, float(v[i, 70, 0])) for i in range(20, 30)]
    reader = tiff.TiffReader(str(tmp_path / "one.tif"), {}, StructType.fromDDL(tiff.TiffSource({"path": str(tmp_path / "one.tif")}).schema()))
    list(reader.pushFilters([tiff.GreaterThanOrEqual(("r",), 20), tiff.LessThan(("r",), 30), tiff.EqualTo(("c",), 70)]))
    assert [b for p in reader.partitions() for b in p.blocks] == [(1, 4)]  # of 20 tiles


def test_bounds_of_a_large_file_read_little(tmp_path, spark):
    """A file of 1 GB, most of it holes on disk: its bounds take its directory, a window one tile."""
    rows, w = 16384, 32768
    lead = make(np.zeros((16, 16, 1), np.uint16), tile=(16, 16), grid=(10.0, 500000.0, 100.0))
    path = tmp_path / "large.tif"
    side = 512
    n = (rows // side) * (w // side)
    spots = [1 << 20] * n
    sizes = [side * side * 2] * n
    fields = [(256, 4, (w,)), (257, 4, (rows,)), (258, 3, (16,)), (259, 3, (1,)), (277, 3, (1,)), (322, 3, (side,)), (323, 3, (side,)), (324, 4, tuple(s + i * side * side * 2 for i, s in enumerate(spots))), (325, 4, tuple(sizes)), (339, 3, (1,)), (33550, 12, (10.0, 10.0, 0.0)), (33922, 12, (0.0, 0.0, 0.0, 500000.0, 100.0, 0.0))]
    entries, rest, behind = b"", b"", 8 + 2 + 12 * len(fields) + 4
    for tag, kind, v in fields:
        raw = struct.pack(f"<{len(v)}{ {3: 'H', 4: 'I', 12: 'd'}[kind]}", *v)
        entries += struct.pack("<HHI", tag, kind, len(v)) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", behind + len(rest)))
        rest += raw if len(raw) > 4 else b""
    with open(path, "wb") as f:
        f.write(b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(fields)) + entries + b"\0" * 4 + rest)
        f.seek((1 << 20) + 5 * side * side * 2)
        f.write(np.arange(side * side, dtype="<u2").tobytes())
        f.truncate((1 << 20) + n * side * side * 2)
    assert path.stat().st_size > 1e9 and lead
    fs, ((at, length),) = tiff._found(str(path))
    with tiff._File(fs, at) as f:
        own = tiff.header(tiff.read_layout(f.read, length))
        assert f.bytes < 1 << 20
    assert (own["min_x"], own["max_y"], own["max_x"], own["min_y"]) == (500000.0, 100.0, 500000.0 + 10 * w, 100.0 - 10 * rows)
    (got,) = tiff.read_headers(spark, str(path)).collect()
    assert (got.width, got.height, got.min_x, got.problem) == (w, rows, 500000.0, None)
    px = tiff.read_pixels(spark, str(path), window=(3, 5, 5 * side, 5 * side + 2)).collect()
    assert sorted((r.r, r.c - 5 * side, r.b1) for r in px) == [(i, j, float((i * side + j) % 65536)) for i in (3, 4) for j in (0, 1)]


def test_headers_and_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.tif").write_bytes(make(image(), nodata=b"-9999", late=200_000))
    (tmp_path / "b.tif").write_bytes(make(image(bands=1, dtype=np.int16), grid=None, keys=(), nodata=b"", order=">"))
    (tmp_path / "cut.tif").write_bytes(make(image())[:60])
    (tmp_path / "empty.tif").write_bytes(b"")
    (tmp_path / "other.tif").write_bytes(b"GIF89a" + b"\0" * 90)
    (tmp_path / "note.txt").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: r for r in tiff.read_headers(spark, str(tmp_path)).collect()}
    assert got.keys() == {"a.tif", "b.tif", "cut.tif", "empty.tif", "other.tif"}
    a, b = got["a.tif"], got["b.tif"]
    assert (a.width, a.height, a.bands, a.dtype, a.nodata, a.epsg, a.projected, a.min_x, a.max_y, a.max_x, a.min_y) == (45, 37, 3, "uint16", -9999.0, 32643, True, 600000.0, 3000000.0, 600450.0, 2999630.0)
    assert (b.dtype, b.nodata, b.epsg, b.min_x, b.min_y, b.max_x, b.max_y, b.problem) == ("int16", None, None, 0.0, 0.0, 45.0, 37.0, None)
    assert all(got[k].problem and got[k].width is None for k in ("cut.tif", "empty.tif", "other.tif"))
    with pytest.raises(Exception, match="TIFF"):
        tiff.read_pixels(spark, str(tmp_path / "other.tif"), bands=[1]).collect()
    odd = bytearray(make(image(), tile=(16, 16)))
    at = bytes(odd).index(struct.pack("<HHI", 259, 3, 1)) + 8
    odd[at : at + 2] = struct.pack("<H", 5)
    (tmp_path / "lzw.tif").write_bytes(bytes(odd))
    with pytest.raises(Exception, match="compression 5"):
        tiff.read_pixels(spark, str(tmp_path / "lzw.tif")).collect()
