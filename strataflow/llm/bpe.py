"""Byte-level BPE encoding and decoding through a sentencepiece model serialised straight from a rank file.

Each byte is mapped to one letter of its own, each vocabulary entry becomes a piece spelled in those letters with its
negative rank as score, and normalisation is the identity; sentencepiece's BPE then merges in rank order. Texts are
split by the pre-token pattern first, each match is encoded separately, and decoding maps ids back to bytes.

Null texts count as empty (no ids); ids are those that the rank file gives, special tokens are never produced.
"""

from __future__ import annotations

import base64
import struct
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import with_made_column

#: Byte b is spelled as this code point plus b: letters that no normaliser changes and that are no white space.
FIRST_LETTER = 0x100
_SPELL = {b: chr(FIRST_LETTER + b) for b in range(256)}
#: Encoded pre-tokens that a worker remembers, and the longest that it does.
CACHED, CACHED_LENGTH = 300_000, 48


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file, by id; ids must run from 0 without gaps."""
    with open(path, "rb") as f:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f)]
    vocabulary = [b""] * len(pairs)
    for rank, token in pairs:
        vocabulary[rank] = token
    return vocabulary


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protocol-buffer field: varint, 32-bit float or length-delimited bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def spell(token: bytes) -> str:
    return token.decode("latin-1").translate(_SPELL)


def serialise_model(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: pieces by id and one unknown piece after them, BPE, identity normalisation."""
    pieces = [_field(1, spell(t).encode()) + _field(2, -float(i)) + _field(3, 1) for i, t in enumerate(vocabulary)]
    unknown = _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in (*pieces, unknown)) + _field(2, trainer) + _field(3, normaliser)


def latin_pattern(pattern: str) -> str:
    """The pattern with its Unicode classes spelled out for code points under 256, for the standard library's engine."""
    members = {k: "".join(re.escape(chr(c)) for c in range(256) if regex.match(k, chr(c))) for k in (r"\p{L}", r"\p{N}", r"\s")}

    parts = re.split(r"(\[[^\]]*\])", pattern)
    for i, part in enumerate(parts):
        shape = "{}" if part.startswith("[") else "[{}]"
        for k, chars in members.items():
            part = part.replace(k, shape.format(chars))
        parts[i] = part.replace(r"\S", f"[^{members[r'\s']}]")
    return "".join(parts)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern in a text; texts of code points under 256 take a faster engine with equal results."""
    every, latin = regex.compile(pattern).findall, re.compile(latin_pattern(pattern)).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return every(text)
        return latin(text)

    return split


class Codec:
    """Encodes lists of texts; a worker keeps one. Ids are held as packed 32-bit integers."""

    def __init__(self, vocabulary: list[bytes], pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(vocabulary))
        self.whole = {t: struct.pack("=i", i) for i, t in enumerate(vocabulary)}
        self.split = splitter(pattern)
        self.known: dict[str, bytes] = {}

    def _learn(self, pre_tokens: set[str]) -> dict[str, bytes]:
        """Encodes pre-tokens; remembers those that aren't too long."""
        found, rest, spelled = {}, [], []
        for w in pre_tokens:
            b = w.encode("utf-8", "surrogatepass")
            if (packed := self.whole.get(b)) is None:
                rest.append(w)
                spelled.append(spell(b))
            else:
                found[w] = packed
        for w, ids in zip(rest, self.model.encode(spelled, num_threads=1), strict=True):
            found[w] = struct.pack(f"={len(ids)}i", *ids)
        if len(self.known) + len(found) > CACHED:
            self.known = {}
        self.known |= {w: ids for w, ids in found.items() if len(w) <= CACHED_LENGTH}
        return found

    def encode(self, texts: list[str]) -> pa.ListArray:
        split = [self.split(t) for t in texts]
        words = set().union(*split)
        known = {w: self.known[w] for w in words if w in self.known}
        known |= self._learn(words - known.keys())
        packed = [b"".join(map(known.__getitem__, x)) for x in split]
        ends = np.cumsum([0, *map(len, packed)]) // 4
        flat = pa.array(np.frombuffer(b"".join(packed), np.int32))
        return pa.LargeListArray.from_arrays(pa.array(ends), flat).cast(pa.list_(pa.int32()))


def decoded(tokens: pa.LargeBinaryArray, ids: pa.ListArray) -> list[bytes]:
    """The bytes of each list of ids, taken from the vocabulary's tokens."""
    out = []
    for x in ids:
        taken = tokens.take(x.values) if x.is_valid and len(x.values) else None
        out.append(taken.buffers()[2].to_pybytes()[: len_of(taken)] if taken else b"")
    return out


def len_of(tokens: pa.LargeBinaryArray) -> int:
    return int(np.frombuffer(tokens.buffers()[1], np.int64)[len(tokens)])


@lru_cache(maxsize=2)
def _codec(vocabulary: tuple[bytes, ...], pattern: str) -> Codec:
    return Codec(list(vocabulary), pattern)


@lru_cache(maxsize=2)
def _tokens(vocabulary: tuple[bytes, ...]) -> pa.LargeBinaryArray:
    return pa.array(vocabulary, pa.large_binary())


def encode(docs: DataFrame, vocabulary: list[bytes], pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with ids array<int>: the token ids of each whole text. The vocabulary is broadcast; its size is fixed."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vocabulary))

    def each(column: pa.Array) -> pa.Array:
        return _codec(shared.value, pattern).encode([t or "" for t in column.to_pylist()])

    return with_made_column(docs, ids, "array<int>", text, each)


def decode(df: DataFrame, vocabulary: list[bytes], ids: str = "ids", data: str = "decoded") -> DataFrame:
    """df with the bytes that ids stand for (null ids: no bytes)."""
    shared = df.sparkSession.sparkContext.broadcast(tuple(vocabulary))

    def each(column: pa.Array) -> pa.Array:
        return pa.array(decoded(_tokens(shared.value), column), pa.binary())

    return with_made_column(df, data, "binary", ids, each)


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of decoded bytes, one row per row of docs."""
    vocabulary = read_ranks(rank_file)
    both = decode(encode(docs.select("doc_id", "text"), vocabulary, pattern).drop("text"), vocabulary)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
