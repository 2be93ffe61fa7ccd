"""Predicates of wanted records and the table of methods, with nulls, ties and empty tables."""

import math

from pyspark.sql import functions as F

from strataflow.functions import choices
from strataflow.operators import surfaces


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first().asDict()


def test_predicates_are_never_null(spark):
    null = lambda kind: F.lit(None).cast(kind)
    got = one(
        spark,
        site=choices.is_site(null("string")), spring=choices.is_site(F.lit("spring")), near=choices.within(null("boolean"), null("double")), read=choices.within(F.lit(False), null("double")), mile=choices.within(F.lit(True), F.lit(1609.0)), far=choices.within(F.lit(True), F.lit(1609.5)),
        none=choices.allowed(null("string"), "x"), http=choices.allowed(F.lit("http://a.example"), "shadow"), ftp=choices.allowed(F.lit("ftp://a.example"), "shadow"), denied=choices.allowed(F.lit("https://shadow.example"), "shadow"),
        bare=choices.record_kind(null("array<string>"), null("array<string>"), null("string")), words=choices.record_kind(F.array(), F.array(), F.lit("MAPS of wells")), mapped=choices.record_kind(F.array(), F.array(), F.lit("Mapped wells")), themed=choices.record_kind(F.array(F.lit("t")), F.array(), null("string")),
        new=choices.stale(null("int"), null("boolean"), null("boolean"), null("string"), null("int"), 2, False), done=choices.stale(F.lit(1), F.lit(True), F.lit(False), F.lit("text"), F.lit(1), 2, False), asked=choices.stale(F.lit(1), F.lit(True), F.lit(False), F.lit("text"), F.lit(1), 2, True), old=choices.stale(F.lit(1), F.lit(False), F.lit(False), F.lit("none"), F.lit(1), 2, True),
        retry=choices.retry_due(F.lit("needs_ocr"), null("int"), null("int")), tired=choices.retry_due(F.lit("needs_ocr"), F.lit(1), F.lit(3)), whole=choices.retry_due(F.lit("text"), null("int"), F.lit(0)), blind=choices.retry_due(F.lit("needs_ocr"), F.lit(1), F.lit(0), engine=False),
        tag=choices.tag(F.lit("2024-03-05 07:08:09").cast("timestamp_ntz")),
    )
    assert got == {
        "site": False, "spring": True, "near": False, "read": True, "mile": True, "far": False, "none": False, "http": True, "ftp": False, "denied": False, "bare": "publication", "words": "map", "mapped": "publication", "themed": "map",
        "new": True, "done": False, "asked": True, "old": True, "retry": True, "tired": False, "whole": False, "blind": False, "tag": "data-20240305-0708",
    }


def test_features_with_tests(spark):
    df = spark.createDataFrame([(1, [("a", 2), ("b", 0), ("c", None)]), (2, []), (3, None)], "k int, f array<struct<name:string,wt:int>>")
    got = {r.k: r.f and [x.name for x in r.f] for r in df.select("k", choices.tested(F.col("f"), "wt").alias("f")).collect()}
    assert got == {1: ["a"], 2: [], 3: None}


def test_methods_are_compared(spark):
    rows = [("s", "idw", e) for e in (1.0, -1.0, None)] + [("s", "mean", e) for e in (0.95, -0.95, 0.95)] + [("t", "idw", 2.0), ("t", "mean", 1.0), ("u", "b", 1.0), ("u", "a", -1.0), (None, "idw", 3.0), ("v", "idw", None)]
    df = spark.createDataFrame(rows, "k string, m string, e double")
    got = {(r.k, r.m): r for r in surfaces.method_table(df, "k", "m", "e", "idw").collect()}
    assert {k: r.chosen for k, r in got.items()} == {("s", "idw"): True, ("s", "mean"): False, ("t", "idw"): False, ("t", "mean"): True, ("u", "a"): True, ("u", "b"): False, (None, "idw"): True}
    assert (got["s", "idw"].n, got["s", "idw"].bias) == (2, 0.0) and math.isclose(got["s", "mean"].mae, 0.95)
    assert surfaces.method_table(df.limit(0), "k", "m", "e").collect() == []
