import math
import random

import pytest
from pyspark.sql import functions as F

from strataflow.operators import geostat, kriging, modelling


def test_direction_of_a_field(spark):
    """A field that changes slowly to the north-east (45 degrees) and fast across."""
    rng = random.Random(5)
    places = [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(70)]
    rows = [("s", i, x, y, math.sin((x - y) * 0.9)) for i, (x, y) in enumerate(places)]
    rows += [("few", 100, 0.0, 0.0, 1.0), ("few", 101, 1.0, 0.0, 2.0), (None, 102, 0.0, 0.0, 1.0), ("s", 103, None, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, i int, x double, y double, z double")
    got = {r.k: r for r in modelling.anisotropy(df, "k", "i", "x", "y", "z", (0, 45, 90, 135), (1.0, 4.0)).collect()}
    assert set(got) == {"s"} and (got["s"].azimuth, got["s"].ratio) == (45.0, 4.0)
    assert modelling.anisotropy(df.where("false"), "k", "i", "x", "y", "z").count() == 0


def test_contact_points(spark):
    holes = spark.createDataFrame([("a", 0.0, 0.0, 100.0, None), ("b", 1.0, 0.0, 50.0, "Datum"), ("c", None, 0.0, 1.0, None)], "hole string, x double, y double, land double, reference string")
    logs = [("a", "Sand", 0.0), ("a", "sand ", 3.0), ("a", "Clay", 5.0), ("a", "Sand", 9.0), ("a", None, 10.0), ("a", "Marl", None), ("b", "Sand", 0.0), ("b", "Clay", 2.0), ("c", "Clay", 2.0), (None, "Clay", 2.0)]
    intervals = spark.createDataFrame(logs, "hole string, unit string, top double")
    got = sorted(map(tuple, modelling.contact_points(holes, intervals, "hole", "unit", "top").collect()))
    assert got == [("clay", 0.0, 0.0, 95.0), ("land surface", 0.0, 0.0, 100.0), ("land surface", 1.0, 0.0, 50.0)]
    assert modelling.contact_points(holes, intervals.where("false"), "hole", "unit", "top").count() == 2


def test_direction_of_a_field_of_many_points(spark):
    """Surfaces beyond what one matrix holds: kriged from the nearest points, as without() does."""
    rng = random.Random(6)
    rows = [("s", i, x := rng.uniform(0, 10), y := rng.uniform(0, 10), math.sin((x - y) * 0.9)) for i in range(260)]
    df = spark.createDataFrame(rows, "k string, i int, x double, y double, z double")
    (got,) = modelling.anisotropy(df, "k", "i", "x", "y", "z", (0, 45, 90, 135), (1.0, 4.0), most=100).collect()
    assert (got.azimuth, got.ratio) == (45.0, 4.0)
    u, v = modelling.stretched(F.col("x"), F.col("y"), F.lit(45.0), F.lit(4.0))
    flat = df.select("k", "i", u.alias("u"), v.alias("v"), "z")
    models = geostat.fits(geostat.lags(flat, "k", "i", "u", "v", "z"), "k")
    want = {r.i: (r.error, r.variance) for r in kriging.without(flat, models, "i", "k", "u", "v", "z").collect()}
    for size in (40, 8192):
        found = {r.i: (r.error, r.variance) for r in kriging.passed(flat, models, "i", "k", "u", "v", "z", size=size).collect()}
        assert found.keys() == want.keys() and all(found[i] == pytest.approx(want[i], rel=1e-6, abs=1e-9) for i in want)
    assert got.rmse == pytest.approx(math.sqrt(sum(e * e for e, _ in want.values()) / len(want)), rel=1e-6)
