"""Readers on files made here; broken files and null answers give no rows."""

import json
import struct

from pyspark.sql import functions as F

from strataflow.sources import features, shapefile


def test_documents_and_geojson(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"source_id": "s2"}')
    (tmp_path / "a.json").write_text('{"source_id": "s1"}')
    (tmp_path / "bad.json").write_text("{")
    allowed = spark.createDataFrame([("s1",), ("s9",)], "source_id string")
    assert [r.name for r in features.documents(spark, str(tmp_path), allowed).collect()] == ["a.json"]
    assert features.documents(spark, str(tmp_path)).count() == 2
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"n": 5}}, {"type": "Feature", "geometry": None, "properties": {}}]}))
    (tmp_path / "d.geojson").write_text("no json")
    rows = features.geojson(spark, str(tmp_path / "*.geojson")).collect()
    assert sorted((r.kind, r.properties) for r in rows if r.kind) == [("Point", '{"n":5}')] and len(rows) == 2
    names = [r.name for r in features.manifest(spark, str(tmp_path)).collect()]
    assert names == sorted(names) and len(names) == 5


def test_answers_of_services(spark):
    own = {"features": [{"attributes": {"a": 1}, "geometry": {"x": 1.5, "y": 2.5}}, {"attributes": {"a": 2}, "geometry": {"rings": [[[0, 0], [0, 1], [1, 1], [0, 0]]]}}], "exceededTransferLimit": True}
    other = {"type": "FeatureCollection", "features": [{"properties": {"a": 3}, "geometry": {"type": "Point", "coordinates": [7, 8]}}]}
    df = spark.createDataFrame([(1, json.dumps(own)), (2, json.dumps(other)), (3, None), (4, "x"), (5, "{}")], "id int, j string").withColumn("x0", F.lit(0))
    got = {(r.id, r.properties): (r.x, r.y, r.rings is not None, r.more) for r in features.esri_features(df, "j").collect()}
    assert got == {(1, '{"a":1}'): (1.5, 2.5, False, True), (1, '{"a":2}'): (None, None, True, True), (2, '{"a":3}'): (7.0, 8.0, False, False)}
    tables = spark.createDataFrame([(1, '{"Table": [["a","b"],["1","2"],["3",null],["4"]]}'), (2, "{}"), (3, None)], "id int, j string")
    assert [(r.id, r.record) for r in features.matrix_records(tables, "j").collect()] == [(1, {"a": "1", "b": "2"}), (1, {"a": "3", "b": None})]
    heights = spark.createDataFrame([('{"value": "12.5"}',), ('{"value": -1000000}',), (None,)], "j string")
    assert [r.v for r in heights.select(features.elevation(F.col("j")).alias("v")).collect()] == [12.5, None, None]
    points = spark.createDataFrame([(1.0, 2.0, "n", None), (None, 2.0, "m", "q")], "x double, y double, name string, note string")
    assert [json.loads(r.json) for r in features.feature_collection(points, "x", "y").collect()] == [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "properties": {"name": "n"}}]


def shp(bodies):
    data = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 0) + b"\0" * 72
    for i, body in enumerate(bodies):
        data += struct.pack(">2i", i + 1, len(body) // 2) + body
    return data


def rings(*parts):
    points = [p for r in parts for p in r]
    starts, n = [], 0
    for r in parts:
        starts.append(n)
        n += len(r)
    return struct.pack("<i4d2i", 5, 0, 0, 1, 1, len(parts), n) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)


def test_shapefiles(spark, tmp_path):
    outer, hole, far = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)], [(9, 9), (9, 10), (10, 10), (9, 9)]
    (tmp_path / "u.shp").write_bytes(shp([rings(outer, hole), rings(outer, far), struct.pack("<i2d", 1, 5.0, 6.0), struct.pack("<i", 0)]))
    fields = [(b"NAME", b"C", 6, 0), (b"N", b"N", 4, 0), (b"V", b"N", 6, 2)]
    head = struct.pack("<4BIHH", 3, 0, 0, 0, 3, 32 + 32 * 3 + 1, 17) + b"\0" * 20
    head += b"".join(n.ljust(11, b"\0") + k + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, k, w, d in fields) + b"\r"
    rows = [" " + "Sand  " + "  12" + "  1.50", " " + "Ton   " + "****" + "      ", " " + "      " + "   7" + " -2.00"]
    (tmp_path / "u.dbf").write_bytes(head + "".join(rows).encode())
    (tmp_path / "v.shp").write_bytes(b"no shapes")
    got = sorted((r.layer, r.number, json.loads(r.geometry)["type"] if r.geometry else None, json.loads(r.properties) if r.properties else None) for r in shapefile.read(spark, str(tmp_path)).collect())
    assert got == [("u", 1, "Polygon", {"NAME": "Sand", "N": 12, "V": 1.5}), ("u", 2, "MultiPolygon", {"NAME": "Ton", "N": None, "V": None}), ("u", 3, "Point", {"NAME": None, "N": 7, "V": -2.0}), ("u", 4, None, None)]
    first = json.loads(shapefile.read(spark, str(tmp_path)).where("number = 1").first().geometry)
    assert len(first["coordinates"]) == 2
