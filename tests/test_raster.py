"""GeoTIFF files written here in every layout against the numbers they were made from."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataflow.sources import raster


def written(path, cells, order="<", tile=None, rows=7, deflate=True, predictor=1, point=False, nodata=None, west=-81.0, north=34.0, step=0.25, extra=()):
    """A file of one band."""
    kind, (h, w) = cells.dtype, cells.shape
    blocks = []
    spans = [(t, left, tile, tile) for t in range(0, h, tile) for left in range(0, w, tile)] if tile else [(t, 0, min(rows, h - t), w) for t in range(0, h, rows)]
    for top, left, bh, bw in spans:
        block = np.zeros((bh, bw), kind)
        part = cells[top : top + bh, left : left + bw]
        block[: part.shape[0], : part.shape[1]] = part
        if predictor == 3:
            mixed = block.astype(">" + kind.str[1:]).view(np.uint8).reshape(bh, bw, kind.itemsize).transpose(0, 2, 1).reshape(bh, -1)
            raw = np.diff(mixed, axis=1, prepend=np.zeros((bh, 1), np.uint8)).astype(np.uint8).tobytes()
        else:
            block = np.diff(block, axis=1, prepend=np.zeros((bh, 1), kind)).astype(kind) if predictor == 2 else block
            raw = block.astype(order + kind.str[1:]).tobytes()
        blocks.append(zlib.compress(raw) if deflate else raw)
    offsets = np.cumsum([8, *map(len, blocks)])
    form = {"f": 3, "i": 2, "u": 1}[kind.kind]
    tags = [(256, "H", [w]), (257, "H", [h]), (258, "H", [8 * kind.itemsize]), (259, "H", [8 if deflate else 1]), (277, "H", [1]), (317, "H", [predictor]), (339, "H", [form]), *extra]
    tags += [(322, "H", [tile]), (323, "H", [tile]), (324, "I", offsets[:-1].tolist()), (325, "I", [len(b) for b in blocks])] if tile else [(273, "I", offsets[:-1].tolist()), (278, "H", [rows]), (279, "I", [len(b) for b in blocks])]
    corner = 0 if point else step / 2
    tags += [(33550, "d", [step, step, 0.0]), (33922, "d", [0.0, 0.0, 0.0, west - corner, north + corner, 0.0])]
    tags += [(34735, "H", [1, 1, 0, 1, 1025, 0, 1, 2 if point else 1])]
    if nodata is not None:
        tags.append((42113, "s", nodata.encode() + b"\0"))
    tags = sorted({t[0]: t for t in tags}.values())
    at, later = int(offsets[-1]), b""
    after = at + 2 + 12 * len(tags) + 4
    out = struct.pack(order + "H", len(tags))
    for tag, letter, v in tags:
        raw = v if letter == "s" else struct.pack(f"{order}{len(v)}{letter}", *v)
        number = {"H": 3, "I": 4, "d": 12, "s": 2}[letter]
        value = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", after + len(later))
        later += raw if len(raw) > 4 else b""
        out += struct.pack(order + "HHI", tag, number, len(v)) + value
    path.write_bytes((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + b"".join(blocks) + out + b"\0" * 4 + later)
    return str(path)


LAYOUTS = [dict(), dict(order=">", rows=1), dict(tile=16), dict(tile=16, order=">", predictor=3), dict(predictor=3), dict(deflate=False, tile=16), dict(kind="f8", predictor=3, tile=16), dict(kind="i2", predictor=2), dict(kind="u1", deflate=False)]


@pytest.mark.parametrize("layout", LAYOUTS, ids=[str(x) for x in LAYOUTS])
def test_cells_of_every_layout(spark, tmp_path, layout, monkeypatch):
    layout = dict(layout)
    kind = np.dtype(layout.pop("kind", "f4"))
    made = np.random.default_rng(1).normal(20, 30, (37, 45))
    cells = np.clip(made, 0, 200).astype(kind) if kind.kind in "iu" else made.astype(kind)
    if kind.kind == "f":
        cells[3, 4] = np.nan
    cells[5, 6] = 99
    path = written(tmp_path / "r.tif", cells, nodata="99", **layout)
    got = {(x.r, x.c): x.v for x in raster.cells(spark, path).collect()}
    want = {(r, c): float(cells[r, c]) for r in range(37) for c in range(45) if cells[r, c] == cells[r, c] and cells[r, c] != 99}
    assert got == want
    head = raster.header(path)
    assert (head.west, head.north, head.step_x, head.nodata) == (pytest.approx(-81.0), pytest.approx(34.0), 0.25, 99.0)


def test_blocks_are_partitions(spark, tmp_path):
    path = written(tmp_path / "r.tif", np.ones((64, 64), "f4"), tile=16)
    reader = raster.RasterReader(path)
    assert [(p.first, p.last) for p in reader.partitions()] == [(0, 16)]
    raster.CELLS, before = 4 * 256, raster.CELLS
    try:
        assert [(p.first, p.last) for p in reader.partitions()] == [(0, 4), (4, 8), (8, 12), (12, 16)]
    finally:
        raster.CELLS = before


def test_shifts_from_a_file(spark, tmp_path):
    field = lambda x, y: 0.5 + 0.25 * (x + 81) - 0.125 * (34 - y)
    cells = np.array([[field(-81 + 0.25 * c, 34 - 0.25 * r) for c in range(9)] for r in range(9)], "f4")
    cells[8, 8] = -9999
    for west, point in ((-81.0, False), (279.0, True)):
        path = written(tmp_path / f"{point}.tif", cells, nodata="-9999", west=west, point=point)
        rows = [(1, -80.3, 33.3), (2, -81.0, 34.0), (3, -79.05, 32.05), (4, -82.0, 33.0), (5, None, 33.0)]
        got = {r.i: r.shift for r in raster.shifted(spark.createDataFrame(rows, "i int, x double, y double"), path, "x", "y").collect()}
        assert got == {1: pytest.approx(field(-80.3, 33.3), abs=1e-6), 2: pytest.approx(0.5, abs=1e-6), 3: None, 4: None, 5: None}


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "x.tif").write_bytes(b"no raster at all")
    with pytest.raises(ValueError, match="no classic TIFF"):
        raster.header(str(tmp_path / "x.tif"))
    for extra, what in (((277, "H", [3]), "bands 3"), ((259, "H", [5]), "compression 5"), ((317, "H", [2]), "predictor 2")):
        with pytest.raises(ValueError, match=what):
            raster.header(written(tmp_path / "y.tif", np.ones((3, 3), "f4"), extra=[extra]) if extra[0] not in (259, 317) else patched(tmp_path, extra))
    assert raster.cells(spark, written(tmp_path / "n.tif", np.full((3, 3), np.nan, "f4"))).select(F.count("*")).first()[0] == 0


def patched(folder, tag):
    """A file with one of its own entries changed."""
    path = folder / "p.tif"
    raw = bytearray(open(written(path, np.ones((3, 3), "f4")), "rb").read())
    at = raw.find(struct.pack("<HHI", tag[0], 3, 1))
    raw[at + 8 : at + 10] = struct.pack("<H", tag[2][0])
    path.write_bytes(raw)
    return str(path)
