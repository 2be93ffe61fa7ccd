"""WARC archives: a distributed writer and a salvage reader.

Each task writes gzip archives (one member a record) into the shared folder and reports their paths; only what a
task that succeeded reports is read again, so files of lost or repeated attempts do no harm. The reader checks each
member (header, CRC, record length, block and payload digests). After a failed check it searches for the next valid
member, or in plain files the next version line, goes on from there, and logs the bytes between as a quarantined gap.
In a member of several records, damage costs only the records that it meets: those before it are read from what can be
inflated, those after it, where the member is whole, from the next version line on. Records may be of any size; one
that claims more bytes than its archive has left is damaged.

Null html counts as an empty payload. Rows with equal page_id are records of their own. Of records with equal
payloads of MIN_REVISIT bytes or more, those with the largest page_id are responses and others revisit it.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import broadcast_if_small, materialise, new_path, slices

MIN_REVISIT = 1000
#: Rows of repeated digests (about 80 bytes each) up to which they are broadcast.
MOST_BROADCAST = 200_000
ARCHIVE_BYTES = 32 << 20
READ_BYTES, STEP = 1 << 20, 1 << 14
VERSION = b"WARC/1.1\r\n"
#: What a version line, a record id of ours and a gzip member begin with.
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
RECORD_ID = "<urn:page:{}>"
GZIP_MAGIC = b"\x1f\x8b\x08"

RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary, archive string, offset bigint"
GAPS = "archive string, offset bigint, length bigint, reason string"


def _sha1(data: bytes) -> str:
    return "sha1:" + b32encode(hashlib.sha1(data).digest()).decode()


def serialise(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: an HTTP response with the payload, or a revisit without it that names size and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", RECORD_ID.format("" if page_id is None else page_id)),
        ("WARC-Target-URI", re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", _sha1(block)),
        ("WARC-Payload-Digest", _sha1(payload)),
    ]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", RECORD_ID.format(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


class BadRecord(ValueError):
    """A record that fails a check; short if more bytes might mend it."""

    def __init__(self, reason: str, short: int | None = None):
        super().__init__(reason)
        self.short = short


def parse(data: bytes, start: int = 0) -> tuple[dict, int]:
    """The record at start and where it ends; raises BadRecord if a check fails."""
    if not (line := VERSION_LINE.match(data, start)):
        raise BadRecord("no version line")
    if (end := data.find(b"\r\n\r\n", line.end() - 2)) < 0:
        raise BadRecord("header without end", 0)
    head = {}
    for x in data[line.end() : end].split(b"\r\n"):
        name, colon, value = x.partition(b":")
        if x and not colon:
            raise BadRecord("header line without colon")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not (length := head.get("content-length", "")).isascii() or not length.isdigit():
        raise BadRecord("no content length")
    block = data[end + 4 : (stop := end + 4 + int(length))]
    if len(block) < int(length):
        raise BadRecord("cut short", stop + 4 - start)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise BadRecord("no end of record")
    if (digest := head.get("warc-block-digest")) and digest != _sha1(block):
        raise BadRecord("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(m[1]) if (m := re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)) else len(payload)
    revisit = head.get("warc-type") == "revisit"
    if not revisit and (len(payload) != size or (d := head.get("warc-payload-digest")) and d != _sha1(payload)):
        raise BadRecord("payload differs")
    key = lambda name: int(m[1]) if (m := re.search(r":page:(-?\d+)>", head.get(name, ""))) else None
    try:
        digest = b32decode(head.get("warc-payload-digest", "").removeprefix("sha1:")).hex()
    except ValueError:
        raise BadRecord("payload digest can't be read") from None
    found = {"page_id": key("warc-record-id"), "url": head.get("warc-target-uri"), "record_type": head.get("warc-type"), "refers_to": key("warc-refers-to"), "payload_digest": digest, "payload_bytes": size, "payload": None if revisit else payload}
    return found, stop + 4


def _inflate(data: bytes, start: int) -> tuple[bytes, int, BadRecord | None]:
    """What can be inflated of the gzip member at start, where it ends, and what is wrong with it."""
    z, view, out, at = zlib.decompressobj(31), memoryview(data), [], start
    try:
        while not z.eof and at < len(data):
            out.append(z.decompress(view[at : at + STEP]))
            at += STEP
    except zlib.error as e:
        return b"".join(out), at, BadRecord(f"gzip: {e}")
    if not z.eof:
        return b"".join(out), at, BadRecord("gzip: cut short", 0)
    return b"".join(out), min(at, len(data)) - len(z.unused_data), None


def records_of(data: bytes) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """The records of a member's bytes, and the stretches between them that hold none (start, end, reason)."""
    found, lost, pos = [], [], 0
    while pos < len(data):
        try:
            record, pos = parse(data, pos)
            found.append(record)
        except BadRecord as e:
            line = VERSION_LINE.search(data, pos + 1)
            end = line.start() if line else len(data)
            if lost and lost[-1][1] == pos:  # a false start inside the damaged stretch
                lost[-1] = (lost[-1][0], end, lost[-1][2])
            else:
                lost.append((pos, end, str(e)))
            pos = end
    return found, lost


class _Window:
    """The bytes of a file from some offset on, read as needed and let go when done with."""

    def __init__(self, stream):
        self.stream, self.data, self.base, self.over = stream, b"", 0, False

    def more(self) -> bool:
        if not self.over:
            piece = self.stream.read(max(READ_BYTES, len(self.data)))
            self.over = not piece
            self.data += piece
        return not self.over

    def drop(self, n: int) -> None:
        self.data, self.base = self.data[n:], self.base + n


def salvage(stream, size: int | None = None) -> Iterator[tuple[str, dict]]:
    """("record", record) and ("gap", offset, length, reason) of an archive, in order of offset. size is that of the
    archive, where known. A gap inside a whole member has the member's offset and length, and its reason the place.

    A member or record is read with as many bytes as it turns out to need. A false start inside a damaged stretch is
    only taken if all its checks hold.
    """
    w = _Window(stream)

    def attempt(at: int) -> tuple[list[dict], int | None, list[tuple[int, int, str]], str]:
        """Records, where they end (None in a damaged stretch), stretches lost inside a member, and what is wrong."""
        while True:
            if w.data.startswith(GZIP_MAGIC, at):
                data, end, bad = _inflate(w.data, at)
                if bad is None:
                    found, lost = records_of(data)
                    return (found, end, lost, "") if found or not data else (found, None, [], lost[0][2])
                if bad.short is None or not w.more():
                    return records_of(data)[0], None, [], str(bad)
                continue
            try:
                record, end = parse(w.data, at)
                return [record], end, [], ""
            except BadRecord as e:
                few = len(w.data) - at <= 16 or w.data.startswith(VERSION[:5], at) and e.short is not None
                beyond = size is not None and e.short and w.base + at + e.short > size
                if not few or beyond or not w.more():
                    return [], None, [], str(e)

    def following(at: int) -> int:
        """The next place that looks like a member or a version line, or the end; lets go of the bytes before."""
        while True:
            line = VERSION_LINE.search(w.data, at)
            places = [p for p in (w.data.find(GZIP_MAGIC, at), line.start() if line else -1) if p >= 0]
            if places:
                return min(places)
            w.drop(max(at, len(w.data) - 16))
            if not w.more():
                return len(w.data)
            at = 0

    gap, reason, at = None, "", 0
    while at < len(w.data) or w.more():
        found, end, lost, why = attempt(at)
        if gap is not None and (end is not None or found):
            yield "gap", {"offset": gap, "length": w.base + at - gap, "reason": reason}
            gap = None
        for record in found:
            yield "record", record | {"offset": w.base + at}
        if end is None:
            if gap is None:
                gap, reason = w.base + at, why
            at = following(at + 1)
            continue
        for start, stop, said in lost:
            yield "gap", {"offset": w.base + at, "length": end - at, "reason": f"bytes {start} to {stop} of the member: {said}"}
        at = end
        if at >= READ_BYTES:
            w.drop(at)
            at = 0
    if gap is not None:
        yield "gap", {"offset": gap, "length": w.base + len(w.data) - gap, "reason": reason}


def _open(path: str, mode: str):
    fs, inner = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    if mode == "w":
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        return fs.open_output_stream(inner, compression=None)
    return fs.open_input_file(inner)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes archives of pages (page_id, url, html, refers_to) below folder; returns the table of their paths.

    Paths are recorded only when their task has ended well. The table has one row per archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, n, size, done = "", None, 0, 0, []
        for batch in batches:
            for part in slices(batch, "html"):
                for x in part.to_pylist():
                    if out is None:
                        out = _open(path := f"{folder}/{uuid.uuid4().hex}.warc.gz", "w")
                    payload = (x["html"] or "").encode("utf-8", "surrogatepass")
                    data = member(serialise(x["page_id"], x["url"], payload, x["refers_to"], x["refers_to"] is not None))
                    out.write(data)
                    n, size = n + 1, size + len(data)
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        done.append((path, n, size))
                        out, n, size = None, 0, 0
        if out is not None:
            out.close()
            done.append((path, n, size))
        names = ["archive", "records", "bytes"]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=names)

    return materialise(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string, records bigint, bytes bigint"), "warc-manifest")


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives, one row each: kind says which; the other kind's columns are null."""
    schema = f"kind string, {RECORDS}, gap_length bigint, gap_reason string"
    types = pa.schema([("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("archive", pa.string()), ("offset", pa.int64()), ("gap_length", pa.int64()), ("gap_reason", pa.string())])

    def rows(path: str) -> Iterator[dict]:
        with _open(path, "r") as stream:
            for kind, x in salvage(stream, stream.size()):
                if kind == "gap":
                    yield {"kind": kind, "archive": path, "offset": x["offset"], "gap_length": x["length"], "gap_reason": x["reason"]}
                else:
                    yield x | {"kind": kind, "archive": path, "payload": x["payload"] if payloads else None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                held, size = [], 0
                for x in rows(path):
                    held.append(x)
                    size += 500 + len(x.get("payload") or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, types)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, types)

    return archives.select("archive").mapInArrow(run, schema)


def records(found: DataFrame) -> DataFrame:
    return found.where("kind = 'record'").drop("kind", "gap_length", "gap_reason")


def gaps(found: DataFrame) -> DataFrame:
    return found.where("kind = 'gap'").select("archive", "offset", F.col("gap_length").alias("length"), F.col("gap_reason").alias("reason"))


def with_revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html and refers_to: the largest page_id among equal payloads of at least so many bytes, or null
    where that is the row's own or the payload is shorter. Payloads are compared by SHA-256 and length; only digests
    are shuffled with the ids, and the largest id is found before any row is joined to it."""
    html = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", "html", F.when(F.length(html) >= least, F.sha2(html, 256)).alias("__digest"))
    equal = rows.where("__digest is not null").groupBy("__digest").agg(F.max("page_id").alias("__last"), F.count("*").alias("__n"))
    equal = broadcast_if_small(materialise(equal.where("__n > 1").drop("__n"), "warc-equal"), MOST_BROADCAST)
    # Short payloads get a key each, so that a shuffled join does not send them all to one task.
    joined = rows.withColumn("__digest", F.coalesce("__digest", F.concat(F.lit("-"), "page_id"), F.lit("-"))).join(equal, "__digest", "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("__last").eqNullSafe(F.col("page_id")), F.col("__last")).alias("refers_to"))


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    archives = write(with_revisits(pages), new_path(spark, "warc"))
    return records(read(archives, payloads=False)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
