"""Rasters in GeoTIFF files as a data source: one row a cell, one partition for each run of tiles or strips.

Only the header is read on the driver; tasks read the bytes of their own blocks. Files hold one band of 32- or 64-bit
floats or of whole numbers, in either byte order, in strips or tiles, plain or deflated, with the floating-point or the
horizontal predictor or none. Others are refused with what they hold. Cells with the file's no-data value, or without a
number, have no row. Rows are numbered from north to south, columns from west to east.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from strataflow.operators import spatial

#: Fixed values of the TIFF format: letters and sizes of types of entries by number, and numbers of entries.
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8)}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, BANDS, STRIP_ROWS, STRIP_SIZES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339
SCALE, TIE, KEYS, NO_DATA, RASTER_TYPE = 33550, 33922, 34735, 42113, 1025
#: Cells of a partition at least, as far as blocks allow.
CELLS = 1 << 20


@dataclass
class Raster:
    """What a header says. west and north are the centre of the first cell; blocks are (offset, bytes)."""

    order: str
    width: int
    height: int
    kind: str
    deflated: bool
    predictor: int
    across: int
    block_width: int
    block_height: int
    west: float
    north: float
    step_x: float
    step_y: float
    nodata: float | None
    blocks: list[tuple[int, int]] = field(repr=False)


def _open(path: str) -> pa.NativeFile:
    fs, inner = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return fs.open_input_file(inner)


def header(path: str) -> Raster:
    """The header of a file."""
    with _open(path) as f:
        first = f.read_at(8, 0)
        order = {b"II": "<", b"MM": ">"}.get(first[:2])
        if order is None or struct.unpack(order + "H", first[2:4])[0] != 42:
            raise ValueError(f"{path} is no classic TIFF file")
        (at,) = struct.unpack(order + "I", first[4:8])
        (n,) = struct.unpack(order + "H", f.read_at(2, at))
        entries = f.read_at(12 * n, at + 2)
        tags: dict[int, tuple] = {}
        for i in range(n):
            tag, kind, count = struct.unpack(order + "HHI", entries[12 * i : 12 * i + 8])
            if kind not in TYPES:
                continue
            letter, size = TYPES[kind]
            raw = entries[12 * i + 8 : 12 * i + 12]
            if size * count > 4:
                raw = f.read_at(size * count, struct.unpack(order + "I", raw)[0])
            tags[tag] = (raw[:count].rstrip(b"\0").decode("latin-1"),) if letter == "s" else struct.unpack(f"{order}{count * len(letter)}{letter[0]}", raw[: size * count])
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    kind = {(3, 32): "f4", (3, 64): "f8", (1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4"}.get((one(FORMAT, 1), one(BITS, 1)))
    wrong = [
        f"{what} {v}"
        for what, v, ok in (("samples", (one(FORMAT, 1), one(BITS, 1)), kind is not None), ("bands", one(BANDS, 1), one(BANDS, 1) == 1), ("compression", one(COMPRESSION, 1), one(COMPRESSION, 1) in (1, 8, 32946)), ("predictor", one(PREDICTOR, 1), one(PREDICTOR, 1) in ((1, 3) if one(FORMAT, 1) == 3 else (1, 2))), ("place", None, SCALE in tags and TIE in tags))
        if not ok
    ]
    if wrong:
        raise ValueError(f"{path} can't be read: {', '.join(wrong)}")
    width, height, tiled = one(WIDTH), one(HEIGHT), TILES in tags
    block_width, block_height = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    sx, sy = tags[SCALE][:2]
    column, row, _, x, y = tags[TIE][:5]
    keys = tags.get(KEYS, ())
    points = any(keys[k] == RASTER_TYPE and keys[k + 3] == 2 for k in range(4, len(keys) - 3, 4))
    half = 0.0 if points else 0.5  # else the tie point is a cell's corner
    nodata = one(NO_DATA, "").strip()
    return Raster(
        order, width, height, kind, one(COMPRESSION, 1) != 1, one(PREDICTOR, 1), -(-width // block_width), block_width, block_height, x + (half - column) * sx, y - (half - row) * sy, sx, sy, float(nodata) if nodata else None,
        list(zip(*((tags[TILES], tags[TILE_SIZES]) if tiled else (tags[STRIPS], tags[STRIP_SIZES])), strict=True)),
    )


def decoded(raw: bytes, r: Raster, rows: int) -> np.ndarray:
    """A block's cells, row by row."""
    raw = zlib.decompress(raw) if r.deflated else raw
    size = np.dtype(r.kind).itemsize
    if r.predictor == 3:  # each byte is the difference to the one before; first come all highest bytes of a row
        mixed = np.frombuffer(raw, np.uint8, rows * r.block_width * size).reshape(rows, -1).cumsum(1, dtype=np.uint8)
        return np.ascontiguousarray(mixed.reshape(rows, size, r.block_width).transpose(0, 2, 1)).view(">" + r.kind)[:, :, 0].astype(r.kind)
    cells = np.frombuffer(raw, r.order + r.kind, rows * r.block_width).reshape(rows, r.block_width).astype(r.kind)
    return cells.cumsum(1, dtype=r.kind) if r.predictor == 2 else cells


class Run(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        super().__init__(first)
        self.first, self.last = first, last


class RasterReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Run]:
        r = header(self.path)
        step = max(1, CELLS // (r.block_width * r.block_height))
        return [Run(i, min(i + step, len(r.blocks))) for i in range(0, len(r.blocks), step)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        r = header(self.path)
        with _open(self.path) as f:
            for k in range(partition.first, partition.last):
                top, left = k // r.across * r.block_height, k % r.across * r.block_width
                offset, size = r.blocks[k]
                tiled = r.across > 1 or r.block_width != r.width
                cells = decoded(f.read_at(size, offset), r, r.block_height if tiled else min(r.block_height, r.height - top))
                cells = cells[: r.height - top, : r.width - left].astype(float)
                there = ~np.isnan(cells) if r.nodata is None or np.isnan(r.nodata) else ~np.isnan(cells) & (cells != np.dtype(r.kind).type(r.nodata))
                row, column = np.nonzero(there)
                yield pa.RecordBatch.from_arrays([pa.array((row + top).astype(np.int32)), pa.array((column + left).astype(np.int32)), pa.array(cells[there])], names=["r", "c", "v"])


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "r int, c int, v double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RasterReader(self.options["path"])


def cells(spark: SparkSession, path: str) -> DataFrame:
    """r, c and v of the cells of a file that hold a value."""
    spark.dataSource.register(GeoTiff)
    return spark.read.format("geotiff").load(path)


def shifted(points: DataFrame, path: str, x: str, y: str) -> DataFrame:
    """points with shift, the bilinear value of a file's raster (of square cells) at each; null outside and beside cells
    without a value. Longitudes of a raster from 0 to 360 degrees are met by those from -180 on."""
    r = header(path)
    if abs(r.step_x - r.step_y) > 1e-9 * r.step_x:
        raise ValueError(f"{path} has cells of {r.step_x} by {r.step_y}")
    west = r.west - 360 if r.west > 180 else r.west
    return spatial.bilinear(points, cells(points.sparkSession, path), x, y, west, r.north, r.step_x, r.width, r.height)
