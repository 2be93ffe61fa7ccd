"""Texts of projections, round trips, and the shift between datums against its plain formula."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strataflow.functions import geodesy, projections

ZONE17 = 'PROJCS["Zone 17N, 1983",GEOGCS["GCS",DATUM["D_North_American_1983",SPHEROID["GRS_1980",6378137.0,298.257222101]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",-81.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'
PLANE = 'PROJCS["Plane zone",GEOGCS["G",DATUM["North_American_Datum_1983 (NAD83)",SPHEROID["GRS 1980",6378137,298.257222101]],UNIT["degree",0.0174532925199433]],PROJECTION["Lambert_Conformal_Conic_2SP"],PARAMETER["standard_parallel_1",34.833333333333336],PARAMETER["standard_parallel_2",32.5],PARAMETER["latitude_of_origin",31.833333333333332],PARAMETER["central_meridian",-81],PARAMETER["false_easting",2000000],PARAMETER["false_northing",0],UNIT["foot",0.3048]]'
GEOGRAPHIC = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],UNIT["Degree",0.0174532925199433]]'


def spots(spark, n=200):
    r = random.Random(1)
    return spark.createDataFrame([(i, r.uniform(-84, -78), r.uniform(31, 36)) for i in range(n)], "i int, lon double, lat double")


@pytest.mark.parametrize("ellipsoid", [projections.GRS80, geodesy.CLARKE])
def test_round_trips_within_a_millimetre(spark, ellipsoid):
    df = spots(spark)
    for there, back in (
        (lambda x, y: geodesy.transverse_mercator(x, y, -81.0, a=ellipsoid[0], e2=ellipsoid[1]), lambda x, y: geodesy.transverse_mercator_inverse(x, y, -81.0, a=ellipsoid[0], e2=ellipsoid[1])),
        (lambda x, y: geodesy.lcc(x, y, -81.0, 31.8, 32.5, 34.8, 609600.0, 0.0, *ellipsoid), lambda x, y: geodesy.lcc_inverse(x, y, -81.0, 31.8, 32.5, 34.8, 609600.0, 0.0, *ellipsoid)),
    ):
        x, y = there(F.col("lon"), F.col("lat"))
        rows = df.select("*", x.alias("x"), y.alias("y"))
        lon, lat = back(F.col("x"), F.col("y"))
        off = rows.select(F.max(F.abs(lon - F.col("lon"))).alias("u"), F.max(F.abs(lat - F.col("lat"))).alias("v")).first()
        assert off.u * 111_320 < 1e-3 and off.v * 111_320 < 1e-3


def degrees(spark, projection, x, y):
    lon, lat = projection.degrees(F.col("x"), F.col("y"))
    return tuple(spark.createDataFrame([(float(x), float(y))], "x double, y double").select(lon.alias("a"), lat.alias("b")).first())


def test_texts(spark):
    assert degrees(spark, projections.read(ZONE17), 500_000, 3_500_000)[0] == pytest.approx(-81.0, abs=1e-9)
    assert degrees(spark, projections.read(PLANE), 2_000_000, 0) == (pytest.approx(-81.0, abs=1e-9), pytest.approx(31 + 50 / 60, abs=1e-9))
    assert degrees(spark, projections.read(GEOGRAPHIC), -80, 33) == (-80.0, 33.0)
    lines = "Projection STATEPLANE\nFipszone 3900\nDatum NAD83\nZunits NO\nUnits INTERNATIONAL_FEET\nSpheroid GRS1980\n"
    for at in ((2_300_000, 700_000), (1_700_000, 300_000)):
        assert degrees(spark, projections.read(lines), *at) == pytest.approx(degrees(spark, projections.read(PLANE), *at), abs=1e-9)
        assert degrees(spark, projections.read("  projection utm\nzone 17\nspheroid GRS1980\n"), *at) == pytest.approx(degrees(spark, projections.read(ZONE17), *at), abs=1e-9)


@pytest.mark.parametrize(
    ("text", "what"),
    [("", "no projection"), ("PROJCS[", "no projection"), (GEOGRAPHIC.replace("WGS_1984", "Elsewhere"), "datum"), (ZONE17.replace("Transverse_Mercator", "Bonne"), "bonne"), ("Projection UTM\nDatum NAD83\n", "UTM"), ("Projection STATEPLANE\nFipszone 1\nDatum NAD83\n", "STATEPLANE 1"), ("Projection GEOGRAPHIC\nDatum NAD27\n", "1927"), ("Projection GEOGRAPHIC\nUnits DD\n", "unknown")],
)
def test_other_texts_are_refused(text, what):
    with pytest.raises(ValueError, match=what):
        projections.read(text)


def test_shift_between_datums(spark):
    a, e2 = geodesy.CLARKE
    lon, lat = geodesy.later_datum(F.col("lon"), F.col("lat"))
    for r in spots(spark, 20).select("lon", "lat", lon.alias("u"), lat.alias("v")).collect():
        p, q = math.radians(r.lat), math.radians(r.lon)
        nu = a / math.sqrt(1 - e2 * math.sin(p) ** 2)
        x, y, z = nu * math.cos(p) * math.cos(q) - 8, nu * math.cos(p) * math.sin(q) + 160, nu * (1 - e2) * math.sin(p) + 176
        b, f2 = projections.GRS80
        phi = math.atan2(z, math.hypot(x, y))
        for _ in range(50):  # to rest
            n = b / math.sqrt(1 - f2 * math.sin(phi) ** 2)
            phi = math.atan2(z + f2 * n * math.sin(phi), math.hypot(x, y))
        assert (r.u, r.v) == (pytest.approx(math.degrees(math.atan2(y, x)), abs=1e-9), pytest.approx(math.degrees(phi), abs=1e-9))
        assert 5 < math.hypot((r.u - r.lon) * 93_000, (r.v - r.lat) * 111_000) < 60
    early = projections.read("Projection STATEPLANE\nFipszone 3902\nDatum NAD27\nUnits FEET\n", approximate=True)
    assert degrees(spark, early, 2_000_000, 300_000)[0] == pytest.approx(-81.0, abs=1e-3)


def test_guesses_and_rings(spark):
    region = (-81.0, 32.5, -80.0, 33.5)
    for name, projection in (("UTM 17 1983 METERS", projections.read(ZONE17)), ("STATEPLANE 3900 1983 INTERNATIONAL_FEET", projections.read(PLANE))):
        n = projection.numbers
        forward = (lambda x, y: geodesy.transverse_mercator(x, y, -81.0)) if projection.kind == "transverse" else (lambda x, y: geodesy.lcc(x, y, -81.0, n["lat0"], n["lat1"], n["lat2"], n["east"], n["north"]))  # noqa: B023
        corners = spark.createDataFrame([(x, y) for x in (-80.99, -80.01) for y in (32.51, 33.49)], "x double, y double")
        px, py = forward(F.col("x"), F.col("y"))
        e = corners.select(*(f(c / projection.metres) for c, f in ((px, F.min), (py, F.min), (px, F.max), (py, F.max)))).first()
        assert projections.guessed(spark, tuple(e), region)[0] == name
    assert projections.guessed(spark, (-80.9, 32.6, -80.1, 33.4), region)[0] == "GEOGRAPHIC 1983 DD"
    with pytest.raises(ValueError, match="no known projection"):
        projections.guessed(spark, (1e7, 1e7, 2e7, 2e7), region)
    rings = spark.createDataFrame([([[[2_000_000.0, 0.0], [2_100_000.0, 5e5]]],)], "r array<array<array<double>>>")
    (made,) = rings.select(projections.placed(F.col("r"), rings.schema["r"].dataType, projections.read(PLANE)).alias("r")).first()
    assert made[0][0] == [pytest.approx(-81.0), pytest.approx(31 + 50 / 60)] and -81 < made[0][1][0] < -80


def test_tiles(spark):
    df = spots(spark, 50)
    x, y = geodesy.tile(F.col("lon"), F.col("lat"), 12)
    w, s, e, n = geodesy.tile_bounds(x, y, 12)
    assert df.where((F.col("lon") >= w) & (F.col("lon") <= e) & (F.col("lat") >= s) & (F.col("lat") <= n)).count() == 50
    box = geodesy.snapped(F.col("lon"), F.col("lat"), F.col("lon") + 0.2, F.col("lat") + 0.1, 11)
    assert df.where((box[0] <= F.col("lon")) & (box[1] <= F.col("lat")) & (box[2] >= F.col("lon") + 0.2) & (box[3] >= F.col("lat") + 0.1) & (box[2] - box[0] < 0.2 + 3 * 360 / 2048)).count() == 50
    mx, my = geodesy.web_mercator(F.lit(180.0), F.lit(89.0))
    assert tuple(df.select(mx, my).first()) == (pytest.approx(20037508.342789), pytest.approx(20037508.342789))
