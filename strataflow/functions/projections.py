"""Texts that name a map projection, and columns that go from it to degrees in the datum of 1983.

Two forms are read: bracketed trees (`PROJCS["...",GEOGCS[...],...]`) and lines of a key and a value. A text is one value of
a file, so it is read on the driver; the projection it gives is made of columns. Places in the datum of 1927 are
approximate and have to be allowed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataflow.functions import geodesy
from strataflow.operators import nested

SURVEY_FOOT, FOOT = 1200 / 3937, 0.3048
GRS80 = (geodesy.A, geodesy.E2)
#: Plane zones by number and datum: central meridian, latitude of origin, two parallels, metres of the false
#: easting.
ZONES = {
    ("3900", 1983): (-81.0, 31 + 50 / 60, 32.5, 34 + 50 / 60, 609600.0),
    ("3901", 1927): (-81.0, 33.0, 33 + 46 / 60, 34 + 58 / 60, 2_000_000 * SURVEY_FOOT),
    ("3902", 1927): (-81.0, 31 + 50 / 60, 32 + 20 / 60, 33 + 40 / 60, 2_000_000 * SURVEY_FOOT),
}
UNITS = {"METERS": 1.0, "FEET": SURVEY_FOOT, "INTERNATIONAL_FEET": FOOT, "DD": 1.0}
#: What data without a text may lie in, the likeliest first.
GUESSES = ["GEOGRAPHIC 1983 DD", "UTM 17 1983 METERS", "STATEPLANE 3900 1983 INTERNATIONAL_FEET", "STATEPLANE 3900 1983 METERS", "STATEPLANE 3902 1927 FEET", "STATEPLANE 3901 1927 FEET"]


@dataclass
class Projection:
    """kind: geographic, transverse or conic; numbers in degrees and metres; metres: of the unit of x and y."""

    kind: str
    year: int
    metres: float = 1.0
    ellipsoid: tuple[float, float] = GRS80
    numbers: dict[str, float] = field(default_factory=dict)

    def degrees(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Longitude and latitude in the datum of 1983."""
        a, e2 = self.ellipsoid
        n, u, v = self.numbers, x * self.metres, y * self.metres
        if self.kind == "geographic":
            lon, lat = x, y
        elif self.kind == "transverse":
            lon, lat = geodesy.transverse_mercator_inverse(u, v, n["lon0"], n["scale"], n["east"], n["north"], n["lat0"], a, e2)
        else:
            lon, lat = geodesy.lcc_inverse(u, v, n["lon0"], n["lat0"], n["lat1"], n["lat2"], n["east"], n["north"], a, e2)
        return geodesy.later_datum(lon, lat) if self.year == 1927 else (lon, lat)


Node = tuple[str, list]


def tree(text: str) -> Node:
    """The name of a bracketed text and its parts: texts, numbers and further nodes."""
    tokens = re.findall(r'"[^"]*"|[\[\](),]|[^\s\[\](),"]+', text)
    at = 0

    def node() -> Node:
        nonlocal at
        name, parts = tokens[at], []
        at += 2  # and the bracket
        while tokens[at] not in ("]", ")"):
            if tokens[at] == ",":
                at += 1
            elif at + 1 < len(tokens) and tokens[at + 1] in ("[", "("):
                parts.append(node())
            else:
                t = tokens[at]
                parts.append(t[1:-1] if t[0] == '"' else float(t) if re.fullmatch(r"[-+]?[\d.]+(?:[eE][-+]?\d+)?", t) else t)
                at += 1
        at += 1
        return name.upper(), parts

    try:
        return node()
    except IndexError as e:
        raise ValueError(f"no projection text: {text[:60]!r}") from e


def _inner(node: Node, name: str) -> list[list]:
    """The parts of all nodes of a name inside a node, itself included, in order."""
    return ([node[1]] if node[0] == name else []) + [p for x in node[1] if isinstance(x, tuple) for p in _inner(x, name)]


def datum_year(name: str) -> int:
    digits = re.sub(r"[\s_]", "", name.upper())
    for year, forms in ((1983, ("NORTHAMERICAN1983", "NAD1983", "NAD83", "WGS1984", "WGS84")), (1927, ("NORTHAMERICAN1927", "NAD1927", "NAD27"))):
        if any(f in digits for f in forms):
            return year
    raise ValueError(f"datum {name or 'unknown'} is not supported")


def _from_tree(text: str) -> Projection:
    root = tree(text)
    datum = next(iter(_inner(root, "DATUM")), [""])
    year = datum_year(str(datum[0]))
    ellipsoid = geodesy.CLARKE if year == 1927 else GRS80
    for _, a, inverse, *_ in _inner(root, "SPHEROID"):
        ellipsoid = (a, (1 / inverse) * (2 - 1 / inverse) if inverse else 0.0)
    if root[0] != "PROJCS":
        return Projection("geographic", year, 1.0, ellipsoid)
    name = str(next(iter(_inner(root, "PROJECTION")), [""])[0]).lower()
    p = {str(k).lower(): v for k, v, *_ in _inner(root, "PARAMETER")}
    metres = next((x[1][1] for x in root[1] if isinstance(x, tuple) and x[0] == "UNIT"), 1.0)
    lat0 = p.get("latitude_of_origin", p.get("latitude_of_center", 0.0))
    n = {"lon0": p.get("central_meridian", p.get("longitude_of_center", 0.0)), "lat0": lat0, "east": p.get("false_easting", 0.0) * metres, "north": p.get("false_northing", 0.0) * metres}
    if "transverse_mercator" in name:
        return Projection("transverse", year, metres, ellipsoid, n | {"scale": p.get("scale_factor", 1.0)})
    if "lambert_conformal_conic" in name:
        lat1 = p.get("standard_parallel_1", lat0)
        return Projection("conic", year, metres, ellipsoid, n | {"lat1": lat1, "lat2": p.get("standard_parallel_2", lat1)})
    raise ValueError(f"projection {name} is not supported")


def _from_lines(text: str) -> Projection:
    said = {k.lower(): v.strip() for k, v in (line.split(None, 1) for line in text.splitlines() if len(line.split(None, 1)) == 2)}
    spheroid = said.get("spheroid", "").lower()
    datum = said.get("datum", "")
    try:
        year = datum_year(datum)
    except ValueError:
        if "clarke" not in spheroid and "grs" not in spheroid:
            raise
        year = 1927 if "clarke" in spheroid else 1983
    ellipsoid = geodesy.CLARKE if year == 1927 else GRS80
    kind, metres = said.get("projection", "").upper(), UNITS.get(said.get("units", "METERS").upper())
    if kind == "GEOGRAPHIC":
        return Projection("geographic", year, 1.0, ellipsoid)
    if kind == "UTM" and metres and said.get("zone", "").isdigit():
        return Projection("transverse", year, metres, ellipsoid, {"lon0": 6.0 * int(said["zone"]) - 183, "lat0": 0.0, "scale": 0.9996, "east": 500000.0, "north": 0.0})
    if kind == "STATEPLANE" and metres and (said.get("fipszone"), year) in ZONES:
        lon0, lat0, lat1, lat2, east = ZONES[said["fipszone"], year]
        return Projection("conic", year, metres, ellipsoid, {"lon0": lon0, "lat0": lat0, "lat1": lat1, "lat2": lat2, "east": east, "north": 0.0})
    raise ValueError(f"projection {kind} {said.get('fipszone', said.get('zone', ''))} {said.get('units', '')} is not supported")


def read(text: str, approximate: bool = False) -> Projection:
    """The projection that a text names. Texts with the datum of 1927 need approximate."""
    found = _from_lines(text) if re.match(r"\s*projection\s", text, re.IGNORECASE) else _from_tree(text)
    if found.year == 1927 and not approximate:
        raise ValueError("datum of 1927: its places can only be approximate")
    return found


def guessed(spark: SparkSession, extent: tuple[float, float, float, float], region: tuple[float, float, float, float], margin: float = 0.05) -> tuple[str, Projection]:
    """Of GUESSES the one that puts an extent (x and y of its corners) into a region (west, south, east, north) with a
    margin, and nearest to it; of equally near ones (to a thousandth of a degree) the first. An error if none does."""
    made = []
    for guess in GUESSES:
        kind, *zone, year, unit = guess.split()
        made.append((guess, read(f"Projection {kind}\n{'Fipszone' if kind == 'STATEPLANE' else 'Zone'} {''.join(zone) or '-'}\nDatum NAD{year[2:]}\nUnits {unit}\n", True)))
    corners = spark.createDataFrame([(float(extent[i]), float(extent[j])) for i in (0, 2) for j in (1, 3)], "x double, y double")
    ends = corners.agg(*(f(c).alias(f"{i}{n}") for i, (_, p) in enumerate(made) for c, (n, f) in zip((p.degrees(F.col("x"), F.col("y")) * 2), (("w", F.min), ("s", F.min), ("e", F.max), ("n", F.max)), strict=True))).first()
    best = None
    for i, (guess, p) in enumerate(made):
        w, s, e, n = (ends[f"{i}{c}"] for c in "wsen")
        if None not in (w, s, e, n) and w >= region[0] - margin and s >= region[1] - margin and e <= region[2] + margin and n <= region[3] + margin:
            off = round(max(abs(a - b) for a, b in zip((w, s, e, n), region, strict=True)), 3)
            if best is None or (off, i) < best[0]:
                best = (off, i), guess, p
    if best is None:
        raise ValueError(f"no known projection puts {extent} into {region}")
    return best[1], best[2]


def placed(coordinates: Column, kind: T.DataType, projection: Projection) -> Column:
    """Coordinates, arrays [x, y] at any depth, in degrees."""
    to: Callable[[Column], Column] = lambda p: F.array(*projection.degrees(F.get(p, 0), F.get(p, 1)))
    return nested.mapped(coordinates, kind, to)
