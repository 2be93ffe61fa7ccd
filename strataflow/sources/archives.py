"""Members of zip archives as rows, the best one of each archive, and CSV texts whose quotes need repair."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def members(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, member, bytes and content of the members of zip archives whose whole name an expression fits, letters in
    either case. An archive is read in one task and yields a member at a time; what is no archive, and members that fail
    their checksum, give no rows."""
    import re

    fits = re.compile(pattern, re.IGNORECASE)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch.path, batch.content):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                for info in archive.infolist():
                    if not info.is_dir() and fits.fullmatch(info.filename):
                        try:
                            data = archive.read(info)
                        except (zipfile.BadZipFile, EOFError, RuntimeError, NotImplementedError):
                            continue
                        yield pd.DataFrame({"path": [p], "member": [info.filename], "bytes": [len(data)], "content": [data]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(unpack, "path string, member string, bytes long, content binary")


def preferred(found: DataFrame, order: list[str]) -> DataFrame:
    """One member of each archive: of the first expression that occurs in its name, then the largest, then by name."""
    place = F.lit(len(order))
    for i, pattern in reversed(list(enumerate(order))):
        place = F.when(F.col("member").rlike(f"(?i){pattern}"), i).otherwise(place)
    best = found.groupBy("path").agg(F.min(F.struct(place.alias("p"), (-F.col("bytes")).alias("b"), "member")).alias("k")).select("path", "k.member")
    return found.join(best, ["path", "member"], "left_semi")


def repaired_csv(text: Column) -> Column:
    """A CSV text in which fields that start with doubled quotes, without quotes around them, get them. Fields in quotes,
    with commas and line ends, stay."""
    field = r'((?:^|,|\r\n|\r|\n)(?:""(?=[^",\r\n])[^,\r\n]*|"(?:[^"]|"")*"[^,\r\n]*|[^,\r\n]*))'
    loose = r'^([,\r\n]*)""([^",\r\n].*)$'
    inner = lambda t: F.replace(F.replace(F.regexp_replace(t, r"^[,\r\n]+", ""), F.lit('""'), F.lit('"')), F.lit('"'), F.lit('""'))
    fixed = lambda t: F.when(t.rlike(loose), F.concat(F.regexp_extract(t, r"^([,\r\n]*)", 1), F.lit('"'), inner(t), F.lit('"'))).otherwise(t)
    return F.when(text.rlike(r'(?:^|[,\r\n])""[^",\r\n]'), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(field), F.lit(1)), fixed), "")).otherwise(text)
