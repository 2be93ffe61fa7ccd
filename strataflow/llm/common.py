"""What the operators of this subpackage share: table access, shared-folder tables and column helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that end a word: space and \t \n \v \f \r. Everything else belongs to words.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session without one (tests) gets a temporary folder; on a
    cluster a machine's own folder would not be seen by the others."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not folder:
        folder = tempfile.mkdtemp(prefix="strataflow-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            fs, inner = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
            fs.delete_dir(inner)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most this many rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a table of at most so many rows; beyond that Spark picks a shuffled join."""
    return F.broadcast(df) if small_enough(df, rows) else df


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20, most_rows: int = 512) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows whose column holds few bytes together, so that memory follows single texts."""
    values = batch.column(column)
    start = held = 0
    for i in range(batch.num_rows):
        size = values[i].as_buffer().size if pa.types.is_string(values.type) and values[i].is_valid else 0
        if i > start and (held + size > most_bytes or i - start >= most_rows):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


#: Each byte with A-Z in lower case.
LOWER = bytes(range(256)).lower()


def split_words(texts: pa.Array, gaps: bytes) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in order (binary, A-Z in lower case) and how many each text has (null: none). gaps: the bytes
    that belong to no word."""
    texts = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if data else b""
    offsets = offsets - offsets[0]
    within = np.frombuffer(data.translate(bytes(b not in gaps for b in range(256))), bool)
    first, last = within.copy(), within.copy()
    first[1:] &= ~within[:-1]
    last[:-1] &= ~within[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]  # words end where texts do
    first[edges], last[edges - 1] = within[edges], within[edges - 1]
    starts = np.flatnonzero(first)
    ends = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(np.flatnonzero(last) + 1 - starts, out=ends[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data.translate(LOWER, gaps))])
    return words, np.diff(np.searchsorted(starts, offsets))


def with_made_column(df: DataFrame, new: str, ddl: str, column: str, each: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """df and a column made from another one in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                made = each(part.column(column))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, `{new}` {ddl}")
