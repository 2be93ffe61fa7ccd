import csv
import io
import zipfile

from pyspark.sql import functions as F

from strataflow.sources import archives


def test_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/Map_poly.csv", "a,b\n1,2\n")
        z.writestr("x/other.csv", "a,b\n1,2\n3,4\n")
        z.writestr("x/read.txt", "no")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("small.CSV", "a\n")
        z.writestr("large.csv", "a\n1\n2\n")
    (tmp_path / "c.zip").write_bytes(b"not an archive")
    found = archives.members(spark, str(tmp_path), r".*\.csv")
    assert sorted(r.member for r in found.collect()) == ["large.csv", "small.CSV", "x/Map_poly.csv", "x/other.csv"]
    assert sorted(r.member for r in archives.preferred(found, ["_poly", "_line"]).collect()) == ["large.csv", "x/Map_poly.csv"]
    assert archives.members(spark, str(tmp_path), "nothing").count() == 0


def test_repaired_csv(spark):
    texts = {
        'id,name\r\n1,""Made"" or other land\r\n2,plain\r\n': [["id", "name"], ["1", '"Made" or other land'], ["2", "plain"]],
        '"quoted ""x"", and\nmore",""loose""\n"",z\n': [['quoted "x", and\nmore', '"loose"'], ["", "z"]],
        '""a"" b,c': [['"a" b', "c"]],
        "a,,b\n\n": [["a", "", "b"], []],
        "": [],
    }
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for r in df.select("t", archives.repaired_csv(F.col("t")).alias("v")).collect():
        assert r.v is None if r.t is None else list(csv.reader(io.StringIO(r.v, newline=""))) == texts[r.t], r.t
