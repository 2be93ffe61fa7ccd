"""Services that give their records in pages, as a data source of Spark.

`scan(spark, url, ...)` reads a layer with typed columns from its own description (or a given schema). Filters of the
query become the service's `where` text; Spark evaluates again only what has no such text. Columns and a box are asked
for by name. The service is asked once for the number of records; each page then is a partition of its own, read by
whichever task gets it. A page's answer is kept in the shared folder before it is used, under a name made from the whole
request, so a lost task, or a later run, asks only for pages that are missing. A page with more or fewer records than it
must hold fails the read.

`chain(spark, url, ...)` reads services whose next page is known only from the last one (a flag that more records exist, a
link to the next page, a total that is told on the way): one partition, one page in memory at a time.

Values that do not fit their column's type are null, missing ones too; `geometry` is JSON text, and a field of that
name is given in its place. A service without records gives no rows. A service that answers
with an error fails the read after TRIES.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator
from datetime import date, datetime
from typing import Any

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringStartsWith
from pyspark.sql.types import StructType

PAGE, TRIES, SECONDS = 1000, 3, 60
#: Names of field types in layer descriptions.
KINDS = {
    "esriFieldTypeOID": "long", "esriFieldTypeInteger": "long", "esriFieldTypeSmallInteger": "int", "esriFieldTypeBigInteger": "long", "esriFieldTypeDouble": "double", "esriFieldTypeSingle": "double",
    "esriFieldTypeString": "string", "esriFieldTypeDate": "long", "esriFieldTypeGUID": "string", "esriFieldTypeGlobalID": "string",
}


class ServiceError(RuntimeError):
    """The service answers with an error, or not with what was asked for."""


def asked(url: str, params: dict[str, Any]) -> Any:
    """A service's JSON answer; failures and errors it reports are tried again."""
    full = f"{url}{'&' if '?' in url else '?'}{urllib.parse.urlencode(params)}" if params else url
    for left in reversed(range(TRIES)):
        try:
            with urllib.request.urlopen(full, timeout=SECONDS) as r:
                found = json.loads(r.read())
            if isinstance(found, dict) and "error" in found:
                raise ServiceError(f"{full}: {found['error']}")
            return found
        except (OSError, ValueError, ServiceError) as e:
            if not left:
                raise e if isinstance(e, ServiceError) else ServiceError(f"{full}: {e}") from e
            time.sleep(0.2 * (TRIES - left))
    raise AssertionError


def literal(v: Any) -> str | None:
    """A value in the text of a condition; null where it has no such text."""
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, (int, float)):
        return repr(v) if v == v and abs(v) != float("inf") else None
    if isinstance(v, datetime):
        return f"TIMESTAMP '{v:%Y-%m-%d %H:%M:%S}'" if not v.microsecond and v.tzinfo is None else None
    if isinstance(v, date):
        return f"DATE '{v:%Y-%m-%d}'"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else None


def condition(f: Filter, names: set[str]) -> str | None:
    """A filter as the text of a condition on the service's fields; null where it has none."""
    if isinstance(f, Not):
        inner = condition(f.child, names)
        return f"NOT ({inner})" if inner else None
    if len(f.attribute) != 1 or f.attribute[0] not in names:
        return None
    name = f.attribute[0]
    signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
    if type(f) in signs:
        v = literal(f.value)
        return f"{name} {signs[type(f)]} {v}" if v else None
    if isinstance(f, In):
        made = [literal(v) for v in f.value if v is not None]
        return f"{name} IN ({', '.join(made)})" if made and all(made) else None
    if isinstance(f, (IsNull, IsNotNull)):
        return f"{name} IS {'NOT ' * isinstance(f, IsNotNull)}NULL"
    if isinstance(f, StringStartsWith) and not set(f.value) & set("%_\\"):
        return f"{name} LIKE {literal(f.value + '%')}"
    return None


def records(answer: Any) -> list[tuple[dict, Any]]:
    """Attributes and geometry of an answer's records: features in either form, or plain records of the first list."""
    found = answer.get("features") if isinstance(answer, dict) else answer
    if found is None:
        found = next((v for v in answer.values() if isinstance(v, list)), None) or next((records(v) for v in answer.values() if isinstance(v, dict)), [])
    return [r if isinstance(r, tuple) else (r.get("attributes", r.get("properties", r)) or {}, r.get("geometry")) for r in found]


def fitted(v: Any, kind: str) -> Any:
    """A JSON value as a column's type, or null."""
    try:
        if v is None or isinstance(v, bool) and kind != "boolean":
            return None
        if kind in ("int", "bigint"):
            n = int(v)
            return n if n == float(v) and abs(n) < 2 ** (31 if kind == "int" else 63) else None
        if kind == "double":
            return float(v)
        if kind == "boolean":
            return v if isinstance(v, bool) else None
        return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    except (TypeError, ValueError, OverflowError):
        return None


def rows(answer: Any, schema: StructType) -> Iterator[tuple]:
    kinds = [(f.name, f.dataType.simpleString()) for f in schema.fields]
    for attributes, geometry in records(answer):
        yield tuple(fitted(attributes[n] if n in attributes else geometry if n == "geometry" else None, k) for n, k in kinds)


class Page(InputPartition):
    def __init__(self, offset: int, size: int, count: int) -> None:
        super().__init__(offset)
        self.offset, self.size, self.count = offset, size, count


class PagedReader(DataSourceReader):
    """offset and count of each page are known from the number of records."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.table, self.url, self.pages = schema, options["url"].rstrip("/"), options["pages"]
        self.where, self.columns, self.bbox, self.size = options.get("where") or "1=1", options.get("columns") or "*", options.get("bbox"), int(options.get("page") or PAGE)
        self.key = options.get("key") or "OBJECTID"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        names = {f.name for f in self.table.fields if f.name != "geometry"}
        for f in filters:
            text = condition(f, names)
            if text:
                self.where = text if self.where == "1=1" else f"{self.where} AND {text}" if self.where.startswith("(") else f"({self.where}) AND {text}"
            else:
                yield f

    def request(self, **more: Any) -> dict[str, Any]:
        box = {"geometry": self.bbox, "geometryType": "esriGeometryEnvelope", "inSR": "4326", "spatialRel": "esriSpatialRelIntersects"} if self.bbox else {}
        return {"where": self.where, **box, **more, "f": "json"}

    def partitions(self) -> list[Page]:
        n = int(asked(f"{self.url}/query", self.request(returnCountOnly="true"))["count"])
        return [Page(o, min(self.size, n - o), n) for o in range(0, n, self.size)] or [Page(0, 0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        if not partition.size:
            return
        request = self.request(outFields=self.columns, orderByFields=self.key, resultOffset=partition.offset, resultRecordCount=partition.size, outSR="4326")
        name = hashlib.sha256(json.dumps([self.url, request, partition.count]).encode()).hexdigest()
        answer = kept(f"{self.pages}/{name}.json", lambda: self.whole(asked(f"{self.url}/query", request), partition))
        yield from rows(answer, self.table)

    def whole(self, answer: Any, page: Page) -> Any:
        n = len(records(answer))
        if n != page.size:
            raise ServiceError(f"{self.url}: page at {page.offset} has {n} records, expected {page.size}")
        return answer


def kept(path: str, make: Any) -> Any:
    """A file's JSON, or what make gives, written there in one move."""
    fs, inner = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    if fs.get_file_info(inner).type == pyarrow.fs.FileType.File:
        with fs.open_input_stream(inner) as f:
            return json.loads(f.read())
    answer = make()
    fs.create_dir(inner.rpartition("/")[0], recursive=True)
    new = f"{inner}.{uuid.uuid4().hex}"
    with fs.open_output_stream(new) as f:
        f.write(json.dumps(answer).encode())
    fs.move(new, inner)
    return answer


class ChainReader(DataSourceReader):
    """Pages that lead to each other. style: `more` (a flag exceededTransferLimit), `total` (a place in the answer holds
    the number of records) or `next` (links of relation next)."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.table, self.options = schema, options

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        style, url, params = self.options["style"], self.options["url"], json.loads(self.options.get("params") or "{}")
        at = int(self.options.get("first") or 0)
        got = 0
        while url:
            here = {**params, self.options.get("offset") or "resultOffset": at + got} if style != "next" else params
            answer = asked(url, here)
            found = len(records(answer))
            yield from rows(answer, self.table)
            got += found
            if style == "next":
                url, params = next((x["href"] for x in answer.get("links", ()) if x.get("rel") == "next"), None), {}
            elif not found or style == "more" and not (answer.get("exceededTransferLimit") or answer.get("properties", {}).get("exceededTransferLimit")):
                url = None
            elif style == "total":
                total: Any = answer
                for step in self.options["total"].split("."):
                    total = total[step]
                if got >= int(total):
                    url = None


class PagedService(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_service"

    def schema(self) -> str:
        layer = asked(self.options["url"].rstrip("/"), {"f": "json"})
        wanted = None if (self.options.get("columns") or "*") == "*" else self.options["columns"].split(",")
        kinds = {f["name"]: KINDS.get(f["type"], "string") for f in layer["fields"] if wanted is None or f["name"] in wanted}
        return ", ".join(f"`{name}` {kind}" for name, kind in ({"geometry": "string"} | kinds).items() if name != "geometry") + (f", geometry {kinds.get('geometry', 'string')}")

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, dict(self.options))


class ChainedService(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chained_service"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ChainReader(schema, dict(self.options))


def _pages(spark: SparkSession) -> str:
    """Where answers are kept: in the shared folder that the session names."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{folder.rstrip('/')}/pages"


def scan(spark: SparkSession, url: str, schema: str | None = None, where: str = "1=1", columns: list[str] | None = None, bbox: tuple[float, float, float, float] | None = None, page: int = PAGE, key: str = "OBJECTID", pages: str | None = None) -> DataFrame:
    """The records of a layer that meet `where` and touch the box (west, south, east, north), with the wanted columns."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedService)
    reader = spark.read.format("paged_service").option("url", url).option("where", where).option("page", page).option("key", key).option("pages", pages or _pages(spark))
    if columns:
        reader = reader.option("columns", ",".join(columns))
    if bbox:
        reader = reader.option("bbox", ",".join(f"{v:.6f}" for v in bbox))
    return (reader.schema(schema) if schema else reader).load()


def chain(spark: SparkSession, url: str, schema: str, style: str = "more", params: dict[str, Any] | None = None, offset: str = "resultOffset", first: int = 0, total: str = "") -> DataFrame:
    """The records of pages that lead to each other, see ChainReader."""
    spark.dataSource.register(ChainedService)
    options = {"url": url, "style": style, "params": json.dumps(params or {}), "offset": offset, "first": str(first), "total": total}
    return spark.read.format("chained_service").schema(schema).options(**options).load()
