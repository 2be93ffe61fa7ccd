"""Secret scans over a trigram inverted index. Spark functions only.

Each rule is a regular expression; its Boolean trigram query is derived from the expression itself (see trigrams.py): a
disjunction of sets of trigrams, one of which occurs in any match. Postings (trigram, document) are built for the
trigrams that some rule asks for, from lower-cased texts; they are intersected by grouping on the document, and only
documents that satisfy a rule's query are read again and verified with the expression itself. Rules without mandatory
trigrams scan all texts.

Spans are code points, end exclusive; matches are leftmost and do not overlap within a kind. Null texts count as
empty. Rows are told apart by doc_id and a digest of the text, so repeated rows keep a row each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm import trigrams
from strataflow.llm.common import broadcast_if_small, materialise

#: Documents (about 40 bytes each) up to which candidates are broadcast.
MOST_CANDIDATES = 500_000


@dataclass(frozen=True)
class Rule:
    """kind, expression, and the group whose length must reach least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    def query(self) -> list[list[str]]:
        """The trigram query: a disjunction of conjunctions; empty where a match needs no trigram."""
        return trigrams.query(self.pattern)


#: The first three are the base rules, in the order that breaks ties of equal starts.
RULES = (
    Rule("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")
SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """All matches of a rule as structs (start, rank, kind, end): the text between matches and the matches themselves
    are cut out by the same expression, and their lengths added up."""
    hits = F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(1))
    gaps = F.split(text, rule.pattern, -1)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(f"({rule.pattern})"), F.lit(rule.group + 1)), F.char_length) if rule.group else F.transform(hits, F.char_length)
    cut = F.zip_with(F.zip_with(gaps, hits, lambda g, h: F.struct(F.char_length(g).alias("g"), F.char_length(h).alias("h"))), sizes, lambda x, n: F.struct(x["g"].alias("g"), x["h"].alias("h"), n.alias("n")))
    none = F.array().cast(f"array<{SPAN}>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + F.coalesce(x["h"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        kept = F.when(x["h"].isNotNull() & (x["n"] >= rule.least), F.array_append(acc["found"], span)).otherwise(acc["found"])
        return F.struct(end.alias("at"), kept.alias("found"))

    made = F.aggregate(cut, F.struct(F.lit(0).alias("at"), none.alias("found")), add, lambda acc: acc["found"])
    return F.when(text.rlike(rule.pattern), made).otherwise(none)


def postings(rows: DataFrame, asked: list[str]) -> DataFrame:
    """The inverted index: trigram and __id, __digest of each row whose lower-cased text holds it."""
    low = rows.select("__id", "__digest", F.lower("__t").alias("__low"))
    present = F.filter(F.array(*(F.when(F.contains("__low", F.lit(t)), F.lit(t)) for t in asked)), lambda t: t.isNotNull())
    return low.select("__id", "__digest", F.explode_outer(present).alias("trigram")).where("trigram is not null")


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """__id, __digest and rules (the kinds whose trigram query the row satisfies), for rows that satisfy one."""
    asked = sorted({t for r in rules for a in r.query() for t in a})
    bit = {t: 1 << i for i, t in enumerate(asked)}
    number = F.lit(0).cast("bigint")
    for t in asked:
        number = F.when(F.col("trigram") == t, F.lit(bit[t]).cast("bigint")).otherwise(number)
    held = index.groupBy("__id", "__digest").agg(F.bit_or(number).alias("__held"))

    def holds(rule: Rule) -> Column:
        found = F.lit(False)
        for alternative in rule.query():
            mask = sum(bit[t] for t in alternative)
            found = found | (F.col("__held").bitwiseAND(F.lit(mask).cast("bigint")) == mask)
        return found

    kinds = F.filter(F.array(*(F.when(holds(r), F.lit(r.kind)) for r in rules)), lambda k: k.isNotNull())
    return held.select("__id", "__digest", kinds.alias("rules")).where(F.size("rules") > 0)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """__id, __digest and __spans (all spans by start, then rule) of each different row of doc_id and text that has
    one. At most 62 trigrams may be asked for."""
    rank = {r.kind: i for i, r in enumerate(rules)}
    indexed, full = [r for r in rules if r.query()], [r for r in rules if not r.query()]
    rows = keyed(docs)
    found = []
    if indexed:
        index = postings(rows, sorted({t for r in indexed for a in r.query() for t in a}))
        chosen = materialise(candidates(index, indexed), "secret-candidates")
        named = broadcast_if_small(chosen.select(F.col("__id").alias("__i"), F.col("__digest").alias("__d"), "rules"), MOST_CANDIDATES)
        again = rows.join(named, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__digest") == F.col("__d")))
        each = [F.when(F.array_contains("rules", r.kind), spans(F.col("__t"), r, rank[r.kind])) for r in indexed]
        found.append(again.select("__id", "__digest", F.concat(*(F.coalesce(x, F.array().cast(f"array<{SPAN}>")) for x in each)).alias("__s")))
    if full:
        found.append(rows.select("__id", "__digest", F.concat(*(spans(F.col("__t"), r, rank[r.kind]) for r in full)).alias("__s")))
    flat = [x.select("__id", "__digest", F.explode_outer("__s").alias("s")).where("s is not null") for x in found]
    every = flat[0] if len(flat) == 1 else flat[0].union(flat[1])
    # collect_set: the spans of repeated rows are found once for each.
    return materialise(every.groupBy("__id", "__digest").agg(F.sort_array(F.collect_set("s")).alias("__spans")), "secret-spans")


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").alias("__id"), text.alias("__t")).withColumn("__digest", F.xxhash64("__t"))


def digest_of(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, found: Column, mask: str = "[SECRET:{}]") -> Column:
    """text with each span replaced by a mask that names its kind; of overlapping spans the first one names it."""
    before, after = mask.split("{}")

    def add(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.when(fresh, F.concat(F.lit(before), s["kind"], F.lit(after))).otherwise(F.lit("")))
        return F.struct(piece.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(found, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with secrets masked in text (n_chars, if there, follows); all rows and columns stay."""
    found = broadcast_if_small(scan(docs, rules).withColumnRenamed("__id", "__i").withColumnRenamed("__digest", "__d"), MOST_CANDIDATES)
    keyed_rows = docs.withColumn("__digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed_rows.join(found, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("__digest") == F.col("__d")), "left")
    masked = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col("__spans")))
    out = joined.withColumn("text", masked)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text")
    ids = rows.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    found = scan(rows)
    joined = ids.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    every = F.coalesce("__spans", F.array().cast(f"array<{SPAN}>"))
    base = F.filter(every, lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter(every, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return joined.select("doc_id", *(count(k) for k in BASE), F.sha2(digest_of(base).cast("binary"), 256).alias("base_sha256"), digest_of(every).alias("spans"))
