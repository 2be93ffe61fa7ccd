"""Language-model scores from a probabilistic suffix tree over words.

Symbols are the frequent words of the training texts, one class for all rarer words, and an end; a start mark may only
stand in contexts, as their first symbol. States are contexts of up to DEPTH symbols whose next-symbol distribution
diverges from that of their longest proper suffix: count * KL divergence must reach a likelihood-ratio threshold.
Distributions are smoothed by absolute discounting into the suffix's distribution, down to the add-0.1 unigram of the
root; a rare word takes its class's probability times its share of the class under the root. A text is scored symbol
by symbol in the state of the longest suffix that the tree holds.

All counts come from all training rows. Frequent means at least LEAST_COUNT, at every size: words, contexts and
(context, symbol) pairs kept grow with the input. Only the HEAD most frequent words are broadcast, which saves joins
and changes no result; other words get their numbers in a join. Numbers follow the counts, so the root's
distribution is a table of different counts (their number grows with the square root of the tokens).

Every context ends in some symbol, so the tree falls apart by last symbols. Tokens go, packed, to the bucket of the
last symbol of their context; there the part of the tree with that suffix is counted, pruned and used, with one
shuffle for both. Symbols that follow a hot word are dealt over several buckets by the word before it, those after a hot
pair by their texts; counts of hot contexts are pre-aggregated and sent to all their buckets. Held-out rows are those
whose crc32(doc_id as text) is a multiple of ten (a null id counts as the empty text). Null texts hold the end only.
Repeated rows count and are scored each; an empty table gives no rows; texts are read whole, at any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import discard, materialise, slices, split_words

LEAST_COUNT = 4
DISCOUNT, THRESHOLD = 0.75, 8.0
SMOOTHING = 0.1
#: Symbols in the longest contexts.
DEPTH = 3
#: Symbols: 0 is the class of rare words, 1 the end, 2 the start; frequent words follow by falling count.
RARE, END, START, FIRST = 0, 1, 2, 3
#: In columns of contexts: no symbol there, or none before the class of rare words; a context's total in place of a symbol.
NONE, TOTAL = -1, -2
#: Bytes of words that a task counts before it hands their counts on, bytes and texts that it encodes at once, and tokens
#: that it deals at once.
HELD, ENCODED, TEXTS, DEALT = 24 << 20, 8 << 20, 4096, 1_000_000
#: Words that are broadcast with their numbers; tokens a bucket should hold, and the fewest buckets.
HEAD, BUCKET, BUCKETS = 200_000, 700_000, 128
#: Hot pairs are told from one in so many texts; that decides where tokens go, not what is counted.
GLIMPSE = 16
#: Symbols fit into so many bits, two of them into a key.
BITS = 31


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10 == 0


#: Bytes between words.
SPACE = b" \t\n\v\f\r"


def word_counts(rows: DataFrame) -> DataFrame:
    """word (empty for the end) and c over all rows of text. Each task counts in runs of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0

        def out() -> pa.RecordBatch:
            counts = pa.chunked_array(held, pa.binary()).value_counts()
            made = [pa.concat_arrays([counts.field("values"), pa.array([b""])]).cast(pa.string()), pa.concat_arrays([counts.field("counts"), pa.array([ends], pa.int64())])]
            return pa.RecordBatch.from_arrays(made, names=["word", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                found, _ = split_words(part.column("text"), SPACE)
                held.append(found)
                size += found.nbytes
                ends += part.num_rows
                if size > HELD:
                    yield out()
                    held, size, ends = [], 0, 0
        yield out()

    return rows.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("c")).where("c > 0")


def numbered(counts: DataFrame) -> DataFrame:
    """word, c and symbol of all words: frequent ones are numbered without gaps by falling count, others are rare."""
    frequent = counts.where((F.col("word") != "") & (F.col("c") >= LEAST_COUNT)).orderBy(F.desc("c"), "word")
    rows = materialise(frequent.select("word", "c", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "frequent-words")
    start, offsets = FIRST, []
    for r in rows.groupBy("part").count().orderBy("part").collect():
        offsets += [F.lit(r["part"]), F.lit(start).cast("bigint")]
        start += r["count"]
    if start >= 1 << BITS:
        raise OverflowError(f"{start} symbols need more than {BITS} bits")
    first = F.element_at(F.create_map(*offsets), F.col("part")) if offsets else F.lit(0).cast("bigint")
    others = counts.where((F.col("word") != "") & (F.col("c") < LEAST_COUNT)).select("word", "c", F.lit(RARE).cast("int").alias("symbol"))
    return rows.select("word", "c", (first + F.col("at")).cast("int").alias("symbol")).unionByName(others)


def pack(x: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes."""
    planes = np.ascontiguousarray(np.asarray(x, "<i4")).view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").ravel().astype(np.int64)


def encoded(docs: DataFrame, vocabulary: DataFrame, total: float, end: float) -> tuple[DataFrame, DataFrame]:
    """row (a number of its own, as ids may repeat), doc_id, held_out, n_tokens, n_known and base_score; and row,
    held_out, n and ids (packed, one symbol per token). Words out of the broadcast head are numbered for each text, and
    meet their counts in a join."""
    head = vocabulary.where(F.col("symbol").between(FIRST, FIRST + HEAD - 1)).toArrow()
    logs = np.log10((head.column("c").to_numpy() + SMOOTHING) / total)
    shared = docs.sparkSession.sparkContext.broadcast((head.column("word").combine_chunks().cast(pa.binary()), head.column("symbol").to_numpy().astype(np.int32), logs))
    end_log = float(np.log10((end + SMOOTHING) / total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, symbols, logs = shared.value
        for batch in batches:
            for part in slices(batch, "text", ENCODED, TEXTS):
                found, sizes = split_words(part.column("text"), SPACE)
                text = np.repeat(np.arange(len(sizes)), sizes)
                at = pc.index_in(found, value_set=frequent).fill_null(-1).to_numpy(zero_copy_only=False)
                known = at >= 0
                ids = np.empty(len(found), np.int32)
                ids[known] = symbols[at[known]]
                base = np.bincount(text[known], logs[at[known]], len(sizes)) + end_log
                others = np.flatnonzero(~known)
                coded = found.take(pa.array(others)).dictionary_encode()
                kinds = max(1, len(coded.dictionary))
                keys, place, times = np.unique(text[others] * kinds + coded.indices.to_numpy(), return_inverse=True, return_counts=True)
                tail_ends = np.searchsorted(keys // kinds, np.arange(len(sizes) + 1))
                ids[others] = (tail_ends[keys // kinds] - np.arange(len(keys)) - 1)[place]
                tail = coded.dictionary.take(pa.array(keys % kinds))
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                whole = np.full(len(found) + len(sizes), END, np.int32)
                whole[np.arange(len(found)) + text] = ids
                flat = [pack(whole[end - size : end]) for end, size in zip(ends.tolist(), sizes.tolist(), strict=True)]
                structs = pa.StructArray.from_arrays([tail.cast(pa.string()), pa.array(times, pa.int32())], ["word", "n"])
                made = [pa.array(sizes, pa.int32()), pa.array(flat, pa.binary()), pa.array(base, pa.float64()), pa.ListArray.from_arrays(pa.array(tail_ends, pa.int32()), structs)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *made], names=["doc_id", "held_out", "n", "ids", "base", "tail"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n int, ids binary, base double, tail array<struct<word:string,n:int>>")
    made = materialise(made.withColumn("row", F.monotonically_increasing_id()), "encoded-texts")
    tail = made.select("row", F.posexplode("tail").alias("k", "t")).select("row", "k", "t.word", "t.n")
    c = F.coalesce("c", F.lit(0))
    sums = tail.join(vocabulary, "word", "left").groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("k", F.coalesce("symbol", F.lit(RARE)).alias("symbol"))))["symbol"].alias("symbols"),
        F.sum(F.col("n") * F.log10((c + SMOOTHING) / F.lit(total))).alias("log"),
        F.sum(F.when(c > 0, 0).otherwise(F.col("n"))).alias("unknown"),
    )
    sums = materialise(sums, "tails-of-texts")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for n, packed, fixed in zip(*(batch.column(c).to_pylist() for c in ("n", "ids", "symbols")), strict=True):
                if fixed:
                    x = unpack(packed, n)
                    low = x < 0
                    x[low] = np.array(fixed, np.int64)[-1 - x[low]]
                    packed = pack(x)
                ids.append(packed)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "held_out", "n")), pa.array(ids, pa.binary())], names=["row", "held_out", "n", "ids"])

    symbols = made.select("row", "held_out", "n", "ids").join(sums.select("row", "symbols"), "row", "left").mapInArrow(settle, "row bigint, held_out boolean, n int, ids binary")
    symbols = materialise(symbols, "symbols-of-texts")
    known = F.col("n") - F.coalesce("unknown", F.lit(0)) - (0 if end else 1)
    scored = made.select("row", "doc_id", "held_out", "n", "base").join(sums.select("row", "log", "unknown"), "row", "left")
    scored = scored.select("row", "doc_id", "held_out", F.col("n").cast("long").alias("n_tokens"), known.cast("long").alias("n_known"), (F.col("base") + F.coalesce("log", F.lit(0.0))).alias("base_score"))
    scored = materialise(scored, "base-scores")
    discard(made, sums)
    return scored, symbols


class Tokens(NamedTuple):
    """Of some tokens: the row of the text, whether it is held out, the symbols before (the last one first) and the symbol."""

    row: np.ndarray
    held: np.ndarray
    context: list[np.ndarray]
    symbol: np.ndarray

    def where(self, on: np.ndarray) -> Tokens:
        return Tokens(self.row[on], self.held[on], [c[on] for c in self.context], self.symbol[on])


def tokens_of(batch: pa.RecordBatch) -> Tokens:
    """All tokens of a batch whose last symbol of context is no rare word. A context ends at its first rare word."""
    sizes = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
    ids = np.concatenate([unpack(b, n) for b, n in zip(batch.column("ids").to_pylist(), sizes.tolist(), strict=True)] or [np.empty(0, np.int64)])
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(ids)) - starts
    context, before = [], None
    for k in range(1, DEPTH + 1):
        c = np.full(len(ids), NONE, np.int64)
        c[k:] = ids[:-k]
        c = np.where(place >= k, c, np.where(place == k - 1, START, NONE))
        c[c == RARE] = NONE
        if before is not None:
            c[(before == NONE) | (before == START)] = NONE
        context.append(c)
        before = c
    row = np.repeat(batch.column("row").to_numpy(zero_copy_only=False), sizes)
    held = np.repeat(np.array(batch.column("held_out").to_pylist(), bool), sizes)
    return Tokens(row, held, context, ids).where(context[0] != NONE)


def _tokens(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Tokens]:
    """Tokens of batches, so many or few more at a time."""
    held, size = [], 0
    joined = lambda: Tokens(np.concatenate([h.row for h in held]), np.concatenate([h.held for h in held]), [np.concatenate(c) for c in zip(*(h.context for h in held), strict=True)], np.concatenate([h.symbol for h in held]))
    for batch in batches:
        for start in range(0, batch.num_rows, 200):
            held.append(tokens_of(batch.slice(start, 200)))
            size += len(held[-1].symbol)
            if size > most:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def in_order(columns: list[np.ndarray]) -> np.ndarray:
    """Places of rows of symbols (NONE may stand in all but the first column) in ascending order: each column is sorted
    with the rank of those before it as one number."""
    rank, order = columns[0], np.argsort(columns[0]) if len(columns) == 1 else None
    for k, column in enumerate(columns[1:], 2):
        keys = (rank << 32) + (column + 1)
        order = np.argsort(keys)
        if k < len(columns):
            keys = keys[order]
            rank = np.zeros(len(keys), np.int64)
            rank[order[1:]] = np.cumsum(keys[1:] != keys[:-1])
    return order


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted keys among sorted ones, and which of them are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Buckets(NamedTuple):
    """How tokens are dealt: hot last symbols and hot pairs (sorted keys) with the buckets that each may use."""

    n: int
    ones: np.ndarray
    ones_ways: np.ndarray
    pairs: np.ndarray
    pairs_ways: np.ndarray

    def hot_one(self, one: np.ndarray) -> np.ndarray:
        return _find(self.ones, one)[1]

    def hot_pair(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return _find(self.pairs, (two << BITS) + one)[1] & (two != NONE)

    def of(self, one: np.ndarray, two: np.ndarray, salt: np.ndarray) -> np.ndarray:
        mixed = lambda x: ((x * 2654435761) & 0xFFFFFFFF) >> 8
        at, hot = _find(self.ones, one)
        ways = np.where(hot, self.ones_ways[at] if len(self.ones) else 1, 1)
        pair, deep = _find(self.pairs, (two << BITS) + one)
        spread = np.where(two == NONE, salt, mixed(two) + np.where(deep & (two != NONE), salt % (self.pairs_ways[pair] if len(self.pairs) else 1), 0))
        return (mixed(one) + spread % ways) % self.n


COLUMNS = [f"c{k + 1}" for k in range(DEPTH)]


def counted(symbols: DataFrame, buckets: Buckets, levels: range) -> DataFrame:
    """Counts n of (context, symbol) in training texts, and of contexts (symbol TOTAL), for contexts of so many symbols
    that end in a hot symbol, or from two symbols on in a hot pair; pre-aggregated in each task in runs of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tokens(batches, DEALT):
            t = t.where(~t.held & buckets.hot_one(t.context[0]))
            for k in levels:
                if k == 2:
                    t = t.where(buckets.hot_pair(t.context[0], t.context[1]))
                u = t.where(t.context[k - 1] != NONE)
                if not len(u.symbol):
                    continue
                order = in_order([*u.context[:k], u.symbol])
                rows = [c[order] for c in (*u.context[:k], u.symbol)]
                new = np.zeros(len(order), bool)
                new[0] = True
                made = []
                for j, c in enumerate(rows):
                    new[1:] |= c[1:] != c[:-1]
                    if j >= k - 1:  # first the contexts, then with their symbols
                        first = np.flatnonzero(new)
                        none = np.full(len(first), NONE)
                        made.append(([*(r[first] for r in rows[:k]), *[none] * (DEPTH - k), c[first] if j == k else none + (TOTAL - NONE)], np.diff(np.append(first, len(order)))))
                for columns, n in made:
                    yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), pa.array(n.astype(np.int64))], names=[*COLUMNS, "symbol", "n"])

    schema = ", ".join(f"{c} int" for c in (*COLUMNS, "symbol")) + ", n bigint"
    return symbols.mapInArrow(run, schema).groupBy(*COLUMNS, "symbol").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Root(NamedTuple):
    """The distribution of the empty context: first symbol of each different count, falling, with their probabilities."""

    first: np.ndarray
    p: np.ndarray
    rare: float
    end: float

    def of(self, symbol: np.ndarray) -> np.ndarray:
        p = self.p[np.maximum(np.searchsorted(self.first, symbol, "right") - 1, 0)] if len(self.p) else np.full(len(symbol), self.rare)
        return np.where(symbol == RARE, self.rare, np.where(symbol == END, self.end, p))


class Level(NamedTuple):
    """Contexts of one length: which hold (sorted keys of the suffix's number and the symbol before), the suffix of each,
    keys of (context, symbol) with discounted shares, the weight of the suffix's distribution, and which are states."""

    keys: np.ndarray
    suffix: np.ndarray
    pairs: np.ndarray
    share: np.ndarray
    back: np.ndarray
    passed: np.ndarray

    def smooth(self, context: np.ndarray, symbol: np.ndarray, below: np.ndarray, states: np.ndarray) -> np.ndarray:
        """Probabilities in the states of context (numbers, NONE where there is none), else those below."""
        if not len(self.keys):
            return below
        pair, explicit = _find(self.pairs, (context << BITS) + symbol)
        mine = below * self.back[context] + np.where(explicit, self.share[pair] if len(self.share) else 0.0, 0.0)
        return np.where((context >= 0) & states[context], mine, below)


def grow(t: Tokens, given: np.ndarray, buckets: Buckets, root: Root, threshold: float) -> tuple[list[Level], list[np.ndarray]]:
    """The tree over the contexts of some tokens, and the number of each token's context in each level. Counts of hot
    contexts are given (rows of DEPTH symbols, symbol and n), those of others are made from the training tokens."""
    hot = [buckets.hot_one(t.context[0])]
    hot += [buckets.hot_pair(t.context[0], t.context[1])] * (DEPTH - 1) if DEPTH > 1 else []
    known = [buckets.hot_one(given[:, 0]), *[buckets.hot_pair(given[:, 0], given[:, 1])] * (DEPTH - 1)] if len(given) else []
    levels, numbers = [], []
    number, at = np.zeros(len(t.symbol), np.int64), np.zeros(len(given), np.int64)
    changes = np.zeros(len(t.symbol), bool)
    for k in range(DEPTH):
        # Tokens are in order of their contexts, so equal ones are neighbours.
        there = (number >= 0) & (t.context[k] != NONE)
        changes[1:] |= t.context[k][1:] != t.context[k][:-1]
        changes[:1] = True
        fresh = changes & there
        keys = (number[fresh] << BITS) + t.context[k][fresh]
        number = np.where(there, np.cumsum(fresh) - 1, NONE)
        mine = there & ~t.held & ~hot[k]
        total = np.bincount(number[mine], minlength=len(keys)).astype(float)
        pairs, n = np.unique((number[mine] << BITS) + t.symbol[mine], return_counts=True)
        pairs, n = pairs[n >= LEAST_COUNT], n[n >= LEAST_COUNT].astype(float)
        if len(given):
            place, found = _find(keys, (at << BITS) + given[:, k])
            at = np.where(found & (at >= 0) & (given[:, k] != NONE), place, NONE)
            exact = (at >= 0) & known[k] & ((given[:, k + 1] == NONE) if k + 1 < DEPTH else True)
            symbol, count = given[:, DEPTH], given[:, DEPTH + 1].astype(float)
            sums, own = exact & (symbol == TOTAL), exact & (symbol != TOTAL)
            total[at[sums]] = count[sums]
            pairs, n = np.append(pairs, (at[own] << BITS) + symbol[own]), np.append(n, count[own])
            order = np.argsort(pairs)
            pairs, n = pairs[order], n[order]
        context, symbol = pairs >> BITS, pairs & ((1 << BITS) - 1)
        suffix = keys >> BITS
        below, up = root.of(symbol), suffix[context] if len(context) else context
        chain = []
        for level in reversed(levels):
            chain.append((level, up))
            up = level.suffix[up]
        for level, number_of in reversed(chain):
            below = level.smooth(number_of, symbol, below, level.passed)
        share = (n - DISCOUNT) / total[context]
        back = 1 - np.bincount(context, share, len(keys))
        rest = np.maximum(1 - np.bincount(context, below, len(keys)), 0)
        p = share + back[context] * below
        gain = np.bincount(context, p * np.log(p / below), len(keys)) + back * rest * np.log(np.maximum(back, 1e-300))
        levels.append(Level(keys, suffix, pairs, share, back, total * gain >= threshold))
        numbers.append(number)
    return levels, numbers


def over_root(t: Tokens, given: np.ndarray, buckets: Buckets, root: Root, threshold: float) -> np.ndarray:
    """The logarithm of each token's probability in its state over that under the root."""
    levels, numbers = grow(t, given, buckets, root, threshold)
    states, longer = [], None
    for level in reversed(levels):  # a tree holds each suffix of its contexts
        kept = level.passed.copy()
        if longer is not None:
            kept[longer[0].suffix[longer[1]]] = True
        states.append(kept)
        longer = level, kept
    p = first = root.of(t.symbol)
    for level, number, kept in zip(levels, numbers, reversed(states), strict=True):
        p = level.smooth(number, t.symbol, p, kept)
    return np.log10(p / first)


def scored(symbols: DataFrame, root: Root, totals: dict[int, int], tokens: int, threshold: float) -> DataFrame:
    """row and gain: the sum of the logarithms of its symbols' probabilities over those under the root. totals: how often
    the hot symbols among contexts occur in training texts."""
    n = max(BUCKETS, -(-tokens // BUCKET))
    share = max(1, tokens // n)
    ways = lambda c: min(n, -(-c // share))
    limit = 2 * share
    ones = sorted(s for s, c in totals.items() if c > limit)
    none = np.empty(0, np.int64)
    buckets = Buckets(n, np.array(ones, np.int64), np.array([ways(totals[s]) for s in ones], np.int64), none, none)
    given = None
    if ones:
        # A hot pair is a hot symbol after a hot context; there are at most n of them.
        seen = counted(symbols.where(F.xxhash64("row") % GLIMPSE == 0), buckets, range(1, 2)).where((F.col("n") * GLIMPSE > limit) & F.col("symbol").isin(ones))
        keyed = sorted(((r["c1"] << BITS) + r["symbol"], min(ways(r["n"] * GLIMPSE), ways(totals[r["symbol"]]))) for r in seen.collect())
        buckets = buckets._replace(pairs=np.array([k for k, _ in keyed], np.int64), pairs_ways=np.array([w for _, w in keyed], np.int64))
        given = materialise(counted(symbols, buckets, range(1, DEPTH + 1)), "pst-hot-contexts")
    names = ["n", "rows", "held", "at", *COLUMNS, "symbol"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tokens(batches, DEALT):
            salt = ((t.row * 40503) & 0xFFFFF) >> 4
            bucket = buckets.of(t.context[0], t.context[1] if DEPTH > 1 else np.full(len(t.row), NONE), salt)
            # Order within a bucket only serves compression.
            order = np.argsort((bucket << 48) + ((t.context[0] & 0xFFFFFF) << 24) + (t.context[1 % DEPTH] & 0xFFFFFF))
            cut = np.searchsorted(bucket[order], np.arange(n + 1))
            new = np.append(True, t.row[1:] != t.row[:-1])  # tokens of a text are neighbours
            texts, held, number = t.row[new], t.held[new], (np.cumsum(new) - 1)[order]
            columns = [c[order] for c in (*t.context, t.symbol)]
            place = np.empty(len(texts), np.int64)
            for b in np.flatnonzero(np.diff(cut)):
                some = slice(cut[b], cut[b + 1])
                own = np.unique(number[some])
                place[own] = np.arange(len(own))
                made = [int(cut[b + 1] - cut[b]), texts[own].tobytes(), held[own].tobytes(), *map(pack, (place[number[some]], *(c[some] for c in columns)))]
                yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int32()), pa.array(made[:1], pa.int32()), *(pa.array([x], pa.binary()) for x in made[1:])], names=["bucket", *names])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            one, two = columns[0], columns[1] if DEPTH > 1 else np.full(batch.num_rows, NONE)
            at, _ = _find(buckets.ones, one)
            pair, deep = _find(buckets.pairs, (two << BITS) + one)
            times = np.where(two == NONE, buckets.ones_ways[at], np.where(deep, buckets.pairs_ways[pair] if len(buckets.pairs) else 1, 1))
            # A pair's buckets need the counts of its symbol too, and they are among those of the symbol.
            row = np.repeat(np.arange(len(one)), times)
            salt = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            to = buckets.of(one[row], two[row], salt)
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), *(c.take(pa.array(row)) for c in batch.columns)], names=["bucket", *batch.schema.names])

    def score(sent: pa.Table, given: pa.Table) -> pa.Table:
        if not sent.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "gain": pa.array([], pa.float64())})
        parts = []
        for m in sent.to_pylist():
            at, *context, symbol = (unpack(m[c], m["n"]) for c in ("at", *COLUMNS, "symbol"))
            parts.append(Tokens(np.frombuffer(m["rows"], np.int64)[at], np.frombuffer(m["held"], bool)[at], context, symbol))
        t = Tokens(np.concatenate([p.row for p in parts]), np.concatenate([p.held for p in parts]), [np.concatenate(c) for c in zip(*(p.context for p in parts), strict=True)], np.concatenate([p.symbol for p in parts]))
        t = t.where(in_order(t.context))
        known = np.stack([given.column(c).to_numpy().astype(np.int64) for c in (*COLUMNS, "symbol", "n")], 1) if given.num_rows else np.empty((0, DEPTH + 2), np.int64)
        logs = over_root(t, known, buckets, root, threshold)
        rows, at = np.unique(t.row, return_inverse=True)
        return pa.table({"row": rows, "gain": np.bincount(at, logs, len(rows)).astype(np.float64)})

    schema = "bucket int, n int, " + ", ".join(f"{c} binary" for c in names[1:])
    sent = symbols.mapInArrow(deal, schema)
    wide = "bucket int, " + ", ".join(f"{c} int" for c in (*COLUMNS, "symbol")) + ", n bigint"
    sides = given.mapInArrow(send, wide) if given is not None else symbols.sparkSession.createDataFrame([], wide)
    return sent.groupBy("bucket").cogroup(sides.groupBy("bucket")).applyInArrow(score, "row bigint, gain double").groupBy("row").agg(F.sum("gain").alias("gain"))


def scores(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs."""
    training = docs.select("doc_id", "text").where(~held_out())
    counts = materialise(word_counts(training), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = counts.where("word = ''").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    total = n + SMOOTHING * (v + 1)
    vocabulary = numbered(counts)
    rows, symbols = encoded(docs, vocabulary, total, ends)
    frequent = vocabulary.where(F.col("symbol") >= FIRST)
    steps = sorted(frequent.groupBy("c").agg(F.count("*").alias("n"), F.min("symbol").alias("first")).collect(), key=lambda r: r["first"])
    known, kinds = sum(r["c"] * r["n"] for r in steps), sum(r["n"] for r in steps)
    end = (ends + SMOOTHING) / total
    rare = max(1e-300, 1 - end - (known + SMOOTHING * kinds) / total)
    root = Root(np.array([r["first"] for r in steps], np.int64), (np.array([r["c"] for r in steps], float) + SMOOTHING) / total, rare, end)
    # Only symbols of over 1 / BUCKETS of the tokens, or of over BUCKET of them, can be hot.
    hot = frequent.where(F.col("c") > min(BUCKET, n / BUCKETS)).select("symbol", "c").collect()
    gains = scored(symbols, root, {r["symbol"]: r["c"] for r in hot} | {START: ends}, n, threshold)
    return rows.join(gains, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        "base_score",
        (F.col("base_score") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return scores(docs)
