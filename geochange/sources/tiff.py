"""TIFF rasters as a Spark data source: headers, and pixels of a window, by the byte ranges that hold them.

    spark.dataSource.register(tiff.TiffSource)
    spark.read.format("geotiff").option("what", "headers").load(folder)
    spark.read.format("geotiff").option("bands", "3,4").option("window", "0,512,0,512").load(folder)

The driver lists the files (pyarrow's file systems: local paths, and URIs of the stores that it knows) and reads their first
64 KB and directories. A partition is some strips or tiles of one file, and a task reads no other bytes. Conditions on r and
c that Spark pushes down leave strips and tiles out, and so does the option window; bands that aren't asked for are not
read where the file keeps bands apart, and not turned into columns in any case.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

#: Bytes of a file's start that are read for its header; directories behind them are read by their own range.
LEAD = 1 << 16
#: Bytes of pixels, as they are in the file, that a partition is to hold about.
PART = 8 << 20

#: Formats and sizes of TIFF's field types, compressions, and numpy's kinds of its sample formats.
_TYPES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8), 17: ("q", 8)}
NONE, DEFLATE, OLD_DEFLATE = 1, 8, 32946
_KIND = {1: "u", 2: "i", 3: "f"}

HEADER = "path string, length long, width long, height long, bands int, dtype string, nodata double, epsg int, projected boolean, res_x double, res_y double, min_x double, min_y double, max_x double, max_y double, block_width long, block_height long, tiled boolean, compression int, sha256 string, problem string"


class NotTiff(ValueError):
    """The file can't be read; the message says why."""


@dataclass(frozen=True)
class Layout:
    """What a header says of where the pixels lie. order: < or >; planar: whether bands are kept apart; blocks: (offset,
    bytes) in order of band (if apart), row and column of blocks."""

    order: str
    width: int
    height: int
    bands: int
    kind: str
    size: int
    compression: int
    predictor: int
    planar: bool
    block: tuple[int, int]
    tiled: bool
    blocks: tuple[tuple[int, int], ...]
    tags: dict

    @property
    def across(self) -> int:
        return -(-self.width // self.block[1])

    @property
    def down(self) -> int:
        return -(-self.height // self.block[0])

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(f"{self.order}{self.kind}{self.size}")


def read_layout(read, length: int) -> Layout:
    """read(offset, n): bytes of the file. Classic TIFF and BigTIFF; only the first image of a file."""
    lead = read(0, min(LEAD, length))
    order = {b"II": "<", b"MM": ">"}.get(lead[:2])
    if not order or len(lead) < 8:
        raise NotTiff("no TIFF header that can be read")
    version = struct.unpack_from(order + "H", lead, 2)[0]
    if version not in (42, 43):
        raise NotTiff("no TIFF header that can be read")
    big = version == 43
    word, entry, count = ("Q", 20, "Q") if big else ("I", 12, "H")
    inline = 8 if big else 4

    def part(at: int, n: int) -> bytes:
        if at < 0 or at + n > length:
            raise NotTiff("the file ends before what its header names")
        return lead[at : at + n] if at + n <= len(lead) else read(at, n)

    try:
        at = struct.unpack_from(order + word, lead, 8 if big else 4)[0]
        head = struct.calcsize(order + count)
        n = struct.unpack(order + count, part(at, head))[0]
        directory, tags = part(at + head, n * entry), {}
        for i in range(n):
            tag, kind, number = struct.unpack_from(order + "HH" + word, directory, i * entry)
            if kind not in _TYPES:
                continue
            code, size = _TYPES[kind]
            place = i * entry + entry - inline
            raw = directory[place : place + number * size] if number * size <= inline else part(struct.unpack_from(order + word, directory, place)[0], number * size)
            tags[tag] = struct.unpack(f"{order}{number}{code}", raw)
        width, height, bands = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
        bits = set(tags.get(258, (8,)))
        formats = set(tags.get(339, (1,)))
        if len(bits) > 1 or len(formats) > 1 or not bits <= {8, 16, 32, 64} or not formats <= set(_KIND):
            raise NotTiff("bands of other types than whole bytes of one kind")
        tiled = 322 in tags
        block = (tags[323][0], tags[322][0]) if tiled else (min(tags.get(278, (height,))[0], height), width)
        spots, sizes = (tags[324], tags[325]) if tiled else (tags.get(273, ()), tags.get(279, ()))
    except (struct.error, KeyError, IndexError) as e:
        raise NotTiff("no TIFF header that can be read") from e
    return Layout(order, width, height, bands, _KIND[formats.pop()], bits.pop() // 8, tags.get(259, (1,))[0], tags.get(317, (1,))[0], tags.get(284, (1,))[0] == 2, block, tiled, tuple(zip(spots, sizes, strict=False)), tags)


def header(layout: Layout) -> dict:
    """The row of a header: size, type, grid and bounds. Without a grid it is one of pixels from (0, 0) on."""
    tags = layout.tags
    (sx, sy), (i, j, x, y) = (1.0, 1.0), (0.0, float(layout.height), 0.0, 0.0)
    if 33550 in tags and 33922 in tags:
        (sx, sy), (i, j, _, x, y) = tags[33550][:2], tags[33922][:5]
    left, top = x - i * sx, y + j * sy
    codes = tags.get(34735, ())
    keys = {codes[k]: codes[k + 3] for k in range(4, len(codes) - 3, 4) if codes[k + 1] == 0}
    projected = keys.get(1024) == 1
    text = b"".join(tags.get(42113, ())).split(b"\0")[0].strip()
    return {
        "width": layout.width, "height": layout.height, "bands": layout.bands, "dtype": f"{ {'u': 'uint', 'i': 'int', 'f': 'float'}[layout.kind]}{8 * layout.size}", "nodata": float(text) if text else None,
        "epsg": keys.get(3072 if projected else 2048), "projected": projected, "res_x": float(sx), "res_y": float(sy),
        "min_x": float(left), "min_y": float(top - layout.height * sy), "max_x": float(left + layout.width * sx), "max_y": float(top),
        "block_width": layout.block[1], "block_height": layout.block[0], "tiled": layout.tiled, "compression": layout.compression,
    }


def block_values(layout: Layout, raw: bytes, row: int) -> np.ndarray:
    """(rows, columns, bands) of a block, or (rows, columns, 1) where bands are apart."""
    if layout.compression in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompress(raw)
    elif layout.compression != NONE:
        raise NotTiff(f"compression {layout.compression} is not read")
    depth = 1 if layout.planar else layout.bands
    rows = layout.block[0] if layout.tiled else min(layout.block[0], layout.height - row * layout.block[0])
    shape = (rows, layout.block[1], depth)
    if layout.predictor == 1:
        return np.frombuffer(raw, layout.dtype, int(np.prod(shape))).reshape(shape)
    if layout.predictor == 2 and layout.kind != "f":  # each value is what it adds to the one on its left
        return np.frombuffer(raw, layout.dtype, int(np.prod(shape))).reshape(shape).cumsum(axis=1, dtype=layout.dtype.newbyteorder("="))
    if layout.predictor == 3 and layout.kind == "f":  # bytes of a row apart by weight, and each added to the one before
        line = np.frombuffer(raw, np.uint8, rows * layout.block[1] * depth * layout.size).reshape(rows, -1)
        line = line.reshape(rows, -1, depth).cumsum(axis=1, dtype=np.uint8).reshape(rows, layout.size, -1)
        return np.ascontiguousarray(line.transpose(0, 2, 1)).view(f">f{layout.size}").reshape(shape)
    raise NotTiff(f"predictor {layout.predictor} is not read")


def _found(path: str) -> tuple[pafs.FileSystem, list[tuple[str, int]]]:
    """The TIFF files at a path or URI, with their lengths."""
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return fs, [(at, info.size)]
    held = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    return fs, sorted((f.path, f.size) for f in held if f.type == pafs.FileType.File and f.path.lower().endswith((".tif", ".tiff")))


class _File:
    """Ranges of a file, and how many bytes were read."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.held, self.bytes = fs.open_input_file(path), 0

    def read(self, at: int, n: int) -> bytes:
        self.held.seek(at)
        out = self.held.read(n)
        self.bytes += len(out)
        return out

    def __enter__(self) -> _File:
        return self

    def __exit__(self, *why: object) -> None:
        self.held.close()


@dataclass
class Part(InputPartition):
    """Blocks (row, column) of a file; header rows have none."""

    path: str
    length: int
    layout: Layout | None
    blocks: list[tuple[int, int]]
    problem: str | None = None


class TiffReader(DataSourceReader):
    def __init__(self, path: str, options: dict, schema: StructType):
        self.path, self.schema = path, schema
        self.headers = options.get("what", "pixels") == "headers"
        self.digest = options.get("digest", "false") == "true"
        window = [int(x) for x in options["window"].split(",")] if "window" in options else [0, 2**62, 0, 2**62]
        if len(window) != 4:
            raise ValueError("window: first row, row after the last, first column, column after the last")
        self.window = window
        self.step = int(options.get("step", 1))
        self.bands = [f for f in schema.fieldNames() if f.startswith("b")]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of r and c narrow the window; Spark still tests every condition."""
        ends = {"r": 0, "c": 2}
        for f in filters:
            own = getattr(f, "attribute", ())
            if not self.headers and len(own) == 1 and own[0] in ends and isinstance(getattr(f, "value", None), int):
                k, v = ends[own[0]], f.value
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.window[k] = max(self.window[k], v + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.window[k + 1] = min(self.window[k + 1], v + (not isinstance(f, LessThan)))
            yield f

    def partitions(self) -> list[Part]:
        fs, files = _found(self.path)
        if self.headers:
            return [Part(p, n, None, []) for p, n in files]
        out = []
        for path, length in files:
            with _File(fs, path) as f:
                own = read_layout(f.read, length)  # a file that can't be read ends the job
            r0, r1, c0, c1 = self.window
            h, w = own.block
            held, size = [], 0
            for y in range(max(r0, 0) // h, min(-(-min(r1, own.height) // h), own.down)):
                for x in range(max(c0, 0) // w, min(-(-min(c1, own.width) // w), own.across)):
                    held.append((y, x))
                    size += own.blocks[y * own.across + x][1] * (own.bands if own.planar else 1)
                    if size >= PART:
                        out.append(Part(path, length, own, held))
                        held, size = [], 0
            if held:
                out.append(Part(path, length, own, held))
        return out

    def read(self, part: Part) -> Iterator:
        fs, _ = pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), "")
        with _File(fs, part.path) as f:
            if self.headers:
                row = dict.fromkeys(self.schema.fieldNames()) | {"path": part.path, "length": part.length}
                try:
                    row |= header(read_layout(f.read, part.length))
                except NotTiff as e:
                    row["problem"] = str(e)
                if self.digest:  # S7: the only thing that needs all bytes, a block at a time
                    whole = hashlib.sha256()
                    for at in range(0, part.length, PART):
                        whole.update(f.read(at, min(PART, part.length - at)))
                    row["sha256"] = whole.hexdigest()
                yield tuple(row[k] for k in self.schema.fieldNames())
                return
            own = part.layout
            r0, r1, c0, c1 = self.window
            for y, x in part.blocks:
                spots = {b: own.blocks[((b - 1) * own.down * own.across if own.planar else 0) + y * own.across + x] for b in (int(n[1:]) for n in self.bands)}
                raw = {s: block_values(own, f.read(*s), y) for s in dict.fromkeys(spots.values())}
                some = next(iter(raw.values()))
                r, c = np.meshgrid(np.arange(some.shape[0]) + y * own.block[0], np.arange(some.shape[1]) + x * own.block[1], indexing="ij")
                keep = (r >= r0) & (r < min(r1, own.height)) & (c >= c0) & (c < min(c1, own.width)) & ((r - max(r0, 0)) % self.step == 0) & ((c - max(c0, 0)) % self.step == 0)
                columns = {"path": pa.array([part.path] * int(keep.sum()), pa.string()), "r": pa.array(r[keep]), "c": pa.array(c[keep])}
                for b, s in spots.items():
                    columns[f"b{b}"] = pa.array(raw[s][:, :, 0 if own.planar else b - 1][keep].astype(np.float64))
                yield pa.RecordBatch.from_arrays([columns[k] for k in self.schema.fieldNames()], names=self.schema.fieldNames())


class TiffSource(DataSource):
    """Options: what (pixels or headers), bands (numbers from 1, by default those of the first file), window (first row,
    row after the last, first column, column after the last), step (every so-many-th row and column of the window), digest
    (whether header rows have the file's sha256, for which it is read whole)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        if self.options.get("what", "pixels") == "headers":
            return HEADER
        if "bands" in self.options:
            bands = [int(b) for b in self.options["bands"].split(",")]
        else:
            fs, files = _found(self.options["path"])
            if not files:
                raise FileNotFoundError(f"no TIFF under {self.options['path']}")
            with _File(fs, files[0][0]) as f:
                bands = range(1, read_layout(f.read, files[0][1]).bands + 1)
        return ", ".join(["path string, r long, c long", *[f"b{b} double" for b in bands]])

    def reader(self, schema: StructType) -> TiffReader:
        return TiffReader(self.options["path"], dict(self.options), schema)


def read_headers(spark, path: str, digest: bool = False):
    """A row for each TIFF under path (see HEADER): the header alone is read, unless a digest is asked for."""
    spark.dataSource.register(TiffSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("geotiff").option("what", "headers").option("digest", str(digest).lower()).load(path)


def read_pixels(spark, path: str, bands: list[int] | None = None, window: tuple[int, int, int, int] | None = None, step: int = 1):
    """(path, r, c, b1, ...) of the rasters under path: of a window of rows and columns, whole by default."""
    spark.dataSource.register(TiffSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("geotiff").option("step", step)
    if bands:
        reader = reader.option("bands", ",".join(map(str, bands)))
    if window:
        reader = reader.option("window", ",".join(map(str, window)))
    return reader.load(path)
