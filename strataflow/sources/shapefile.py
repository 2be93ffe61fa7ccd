"""Shapefiles: geometry (.shp) with attributes (.dbf), one row a record, read in tasks from binary files.

Points, polylines and polygons (also with z or m) are read; rings of polygons are told apart by their sense: outer ones
run with the clock, and a hole belongs to the first outer ring that holds its first point. A record that ends early, or
a file that does not begin as one, gives no further rows. Numbers that can't be read are null; text is UTF-8, else
Latin-1. A file is read whole in its task: its size is bounded by the format (2 GB).
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _area(ring: list) -> float:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, [*ring[1:], ring[0]], strict=True)) / 2


def _holds(ring: list, x: float, y: float) -> bool:
    crossed = False
    for p, q in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0]:
            crossed = not crossed
    return crossed


def polygon(rings: list) -> dict:
    """A GeoJSON polygon, or several, from rings."""
    parts = [[r] for r in rings if _area(r) <= 0] or [[r] for r in rings]
    for hole in (r for r in rings if _area(r) > 0 and [r] not in parts):
        home = next((p for p in parts if _holds(p[0], *hole[0])), None)
        home.append(hole) if home else parts.append([hole])
    return {"type": "Polygon", "coordinates": parts[0]} if len(parts) == 1 else {"type": "MultiPolygon", "coordinates": parts}


def shapes(data: bytes) -> Iterator[dict | None]:
    """The geometries of a .shp file, None for null shapes."""
    if len(data) < 100 or struct.unpack(">i", data[:4])[0] != 9994:
        return
    at = 100
    while at + 12 <= len(data):
        size = 2 * struct.unpack(">i", data[at + 4 : at + 8])[0]
        body, at = data[at + 8 : at + 8 + size], at + 8 + size
        if len(body) < size or size < 4:
            return
        kind = struct.unpack("<i", body[:4])[0] % 10
        if kind == 1:
            yield {"type": "Point", "coordinates": list(struct.unpack("<2d", body[4:20]))}
        elif kind in (3, 5):
            parts, points = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            lines = [[[flat[2 * i], flat[2 * i + 1]] for i in range(a, b)] for a, b in zip(starts, starts[1:], strict=False)]
            yield polygon(lines) if kind == 5 else {"type": "MultiLineString", "coordinates": lines}
        else:
            yield None


def attributes(data: bytes) -> Iterator[dict]:
    """The records of a .dbf file in order, deleted ones too, so that places agree with those of shapes."""
    if len(data) < 32:
        return
    count, head, width = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while at < head - 1 and data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    for i in range(count):
        row, place, made = data[head + i * width : head + (i + 1) * width], 1, {}
        if len(row) < width:
            return
        for name, kind, size, decimals in fields:
            raw, place = row[place : place + size].strip(b" \0"), place + size
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                text = raw.decode("latin-1")
            if kind in "NF":
                try:
                    made[name] = float(text) if decimals or kind == "F" else int(text)
                except ValueError:
                    made[name] = None
            else:
                made[name] = text or None
        yield made


def read(spark: SparkSession, folder: str) -> DataFrame:
    """layer, number (from 1), geometry and properties (JSON text) of the shapefiles of a folder; geometry and attributes
    meet by the files' common name, one task a layer."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content").where(F.lower("path").rlike(r"\.(shp|dbf)$"))
    layers = files.select(F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("layer"), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("part"), "content")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = {r.part: r.content for r in group.itertuples()}
        found, told = list(shapes(parts.get("shp", b""))), list(attributes(parts.get("dbf", b"")))
        rows = [(group["layer"].iloc[0], i + 1, json.dumps(g) if g else None, json.dumps(told[i]) if i < len(told) else None) for i, g in enumerate(found)]
        return pd.DataFrame(rows, columns=["layer", "number", "geometry", "properties"])

    return layers.groupBy("layer").applyInPandas(run, "layer string, number long, geometry string, properties string")
