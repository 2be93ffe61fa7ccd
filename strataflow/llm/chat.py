"""Tool-call linking in chats, by DataFrame functions only.

Messages may carry calls (call_id, tool, arguments as JSON text, after: identifiers of the calls whose results they
need) or be results (call_id). Results are joined to the first call of their conversation with that identifier,
arguments are checked against the tool's schema, and every message is serialised as canonical JSON: keys in order, no
white space, numbers in one form.

The order is topological, a pair (anchor, step): a result follows its call, a call follows the results of the calls it
names in after (or those calls, where they have none). step is the longest chain of such links before a message,
anchor the largest turn along it, so sorting by (anchor, step, turn) places each message after what it depends on and
moves no other. It is found in rounds over the table of links: each round places the calls all of whose needs are
placed. Calls in a cycle, or that depend on one, are never placed: they keep their turn and get the error "cyclic".
Conversations are never gathered in one task.

Duplicate calls of one identifier are flagged and the first one (smallest turn) is linked and ordered; the others and
results without a call keep their own place. Identifiers in after that no call has are left out. Null identifiers link
nothing. Null texts serialise as null. Repeated rows keep a row each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm.common import materialise

#: A tool's schema: parameter -> (type, required, smallest number or length, largest number or length or None).
Schema = dict[str, tuple[str, bool, float, float | None]]
SCHEMAS: dict[str, Schema] = {"reply": {"text": ("string", True, 1, None), "turn": ("bigint", True, 0, None), "style": ("string", False, 1, 40)}}


def canonical(json: Column) -> Column:
    """JSON text in canonical form (null if it isn't JSON): a variant's object keys are sorted."""
    return F.to_json(F.try_parse_json(json))


def problems(arguments: Column, schema: Schema) -> Column:
    """What is wrong with the arguments of one call, as an array of codes."""
    value = F.try_parse_json(arguments)
    kind = F.schema_of_variant(value)
    found = [F.when(value.isNull() | ~kind.startswith("OBJECT"), F.lit("no object"))]
    is_object = kind.startswith("OBJECT")
    keys = F.json_object_keys(arguments)
    for name, (of, required, least, most) in schema.items():
        got = F.try_variant_get(value, f"$.{name}", "variant")
        there = F.array_contains(keys, name)
        typed = F.try_variant_get(value, f"$.{name}", of)
        of_kind = F.schema_of_variant(got) == of.upper()
        size = F.char_length(typed) if of == "string" else typed
        if required:
            found.append(F.when(is_object & ~there, F.lit(f"{name}: missing")))
        found.append(F.when(is_object & there & ~F.coalesce(of_kind, F.lit(False)), F.lit(f"{name}: not {of}")))
        outside = size < least if most is None else (size < least) | (size > most)
        found.append(F.when(is_object & there & of_kind & outside, F.lit(f"{name}: out of range")))
    found.append(F.when(is_object & (F.size(F.array_except(keys, F.array(*map(F.lit, schema)))) > 0), F.lit("unknown parameter")))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def depths(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """conv_id, call_id, call_anchor and depth of the calls that can be placed, in as many rounds as the longest chain
    has calls. calls: conv_id, call_id, call_turn, last_result (turn or null); needs: conv_id, call_id, need."""
    ids = ["conv_id", "call_id"]
    known = calls.select("conv_id", F.col("call_id").alias("need"))
    edges = materialise(needs.where("call_id is not null and need is not null").distinct().join(known, ["conv_id", "need"], "left_semi").select(*ids, "need"), "call-needs")
    done = F.col("last_result").isNotNull().cast("long")
    first = calls.join(edges, ids, "left_anti").select(*ids, F.col("call_turn").alias("call_anchor"), F.lit(0).cast("long").alias("depth"), "last_result")
    placed = materialise(first, "placed-calls")
    count = edges.groupBy(*ids).agg(F.count("*").alias("n"))
    while True:
        waiting = edges.join(placed.select(*ids), ids, "left_anti")
        after = placed.select("conv_id", F.col("call_id").alias("need"), F.greatest("call_anchor", F.coalesce("last_result", "call_anchor")).alias("a"), (F.col("depth") + done + 1).alias("d"))
        met = waiting.join(after, ["conv_id", "need"]).groupBy(*ids).agg(F.count("*").alias("met"), F.max("a").alias("a"), F.max("d").alias("d"))
        ready = met.join(count, ids).where("met = n").join(calls, ids)
        fresh = materialise(ready.select(*ids, F.greatest("a", "call_turn").alias("call_anchor"), F.col("d").alias("depth"), "last_result"), "placed-calls")
        if fresh.isEmpty():
            return placed.drop("last_result")
        placed = materialise(placed.unionByName(fresh), "placed-calls")


def link(messages: DataFrame, schemas: dict[str, Schema] = SCHEMAS) -> DataFrame:
    """messages (conv_id, turn, role, kind call/result/message, call_id, tool, arguments, text) with linked (a call
    has a result, a result has a call), duplicate, errors (array), anchor and step (the order), and json."""
    named = messages.where("call_id is not null and conv_id is not null")
    calls = named.where("kind = 'call'").groupBy("conv_id", "call_id").agg(F.min("turn").alias("call_turn"), F.count("*").alias("n_calls"))
    results = named.where("kind = 'result'").groupBy("conv_id", "call_id").agg(F.count("*").alias("n_results"), F.max("turn").alias("last_result"))
    pairs = calls.join(results, ["conv_id", "call_id"], "full_outer")
    turn, depth, cyclic = F.col("call_turn"), F.lit(0).cast("long"), F.lit(False)
    if "after" in messages.columns:
        first = named.where("kind = 'call' and size(after) > 0").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "after")).alias("f"))
        needs = materialise(first.select("conv_id", "call_id", F.col("f.turn").alias("t"), F.explode("f.after").alias("need")), "named-needs")
        if not needs.isEmpty():
            # Only a first call's needs count, as it is the one that is linked.
            own = needs.join(calls.select("conv_id", "call_id", F.col("call_turn").alias("t")), ["conv_id", "call_id", "t"], "left_semi")
            placed = depths(pairs.where("n_calls is not null").select("conv_id", "call_id", "call_turn", "last_result"), own.drop("t"))
            pairs = pairs.join(placed, ["conv_id", "call_id"], "left")
            turn, depth, cyclic = F.coalesce("call_anchor", "call_turn"), F.coalesce("depth", F.lit(0)).cast("long"), F.col("n_calls").isNotNull() & F.col("depth").isNull()
    pairs = pairs.select(F.col("conv_id").alias("__c"), F.col("call_id").alias("__i"), "call_turn", "n_calls", "n_results", turn.alias("__anchor"), depth.alias("__depth"), cyclic.alias("__cyclic"))
    # Messages without an identifier get one that no pair has, so that they don't meet in one task.
    key = F.coalesce("call_id", F.concat_ws("-", F.lit("\u0000"), F.col("turn").cast("string")))
    joined = messages.withColumn("__key", key).join(pairs, (F.col("conv_id") == F.col("__c")) & (F.col("__key") == F.col("__i")), "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    linked = F.when(is_call, F.col("n_results").isNotNull()).when(is_result, F.col("n_calls").isNotNull()).otherwise(F.lit(None))
    after = is_result & F.col("call_turn").isNotNull()
    first_call = is_call & (F.col("turn") == F.col("call_turn"))
    errors = F.lit(None).cast("array<string>")
    for tool, schema in schemas.items():
        errors = F.when(is_call & (F.col("tool") == tool), problems(F.col("arguments"), schema)).otherwise(errors)
    errors = F.when(is_call & (F.col("tool").isNull() | ~F.col("tool").isin(*schemas)), F.array(F.lit("unknown tool"))).otherwise(errors)
    errors = F.when(first_call & F.col("__cyclic"), F.array_append(F.coalesce(errors, F.array().cast("array<string>")), F.lit("cyclic"))).otherwise(errors)
    # Keys in order; arguments that are no JSON stay as text.
    quoted = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.struct(c.alias("a"))), r'(?s)^\{"a":(.*)\}$', 1))
    given = F.coalesce(canonical(F.col("arguments")), quoted(F.col("arguments")))
    parts = [
        F.when(is_call, F.concat(F.lit('"arguments":'), given)),
        F.when(is_call | is_result, F.concat(F.lit('"call_id":'), quoted(F.col("call_id")))),
        F.when(~is_call, F.concat(F.lit('"content":'), quoted(F.col("text")))),
        F.concat(F.lit('"role":'), quoted(F.col("role"))),
        F.when(is_call, F.concat(F.lit('"tool":'), quoted(F.col("tool")))),
    ]
    json = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return joined.select(
        *messages.columns,
        linked.alias("linked"),
        (F.coalesce(F.when(is_call, F.col("n_calls") > 1), F.lit(False))).alias("duplicate"),
        errors.alias("errors"),
        F.when(after, F.greatest("turn", "__anchor")).when(first_call, F.col("__anchor")).otherwise(F.col("turn")).alias("anchor"),
        F.when(after, F.col("__depth") + 1).when(first_call, F.col("__depth")).otherwise(0).cast("long").alias("step"),
        json.alias("json"),
    )


def from_turns(conversations: DataFrame) -> DataFrame:
    """Conversations as messages: a user's turn calls the tool reply with its text, the assistant's next turn is the
    result; other turns are plain messages. Turns whose text is itself a call or result in JSON (tool, call_id,
    arguments, after; or call_id, content) are taken as such."""
    role = F.col("role")
    identifier = lambda turn: F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), turn.cast("string"))
    said = F.coalesce("text", F.lit(""))
    own = F.when(said.startswith("{"), F.try_parse_json("text"))
    get = lambda path, kind="string": F.try_variant_get(own, path, kind)
    own_call, own_result = get("$.tool").isNotNull(), get("$.call_id").isNotNull() & get("$.content").isNotNull()
    kind = F.when(own_call | (role == "user"), "call").when(own_result | (role == "assistant"), "result").otherwise("message")
    call_id = F.when(own_call | own_result, get("$.call_id")).when(role == "user", identifier(F.col("turn"))).when(role == "assistant", identifier(F.col("turn") - 1))
    arguments = F.when(own_call, F.to_json(get("$.arguments", "variant"))).when(role == "user", F.to_json(F.struct(F.col("turn"), F.col("text"))))
    tool = F.when(own_call, get("$.tool")).when(role == "user", F.lit("reply"))
    text = F.when(own_result, get("$.content")).otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", "role", kind.alias("kind"), call_id.alias("call_id"), tool.alias("tool"), arguments.alias("arguments"), F.when(own_call, get("$.after", "array<string>")).alias("after"), text.alias("text"))


def query(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    found = link(from_turns(conversations))
    return found.select("conv_id", "turn", "kind", "call_id", "linked", F.concat_ws(";", "errors").alias("errors"), "anchor", "step", "json")


#: conversations holds no JSON turns, so only the derived calls are needed here.
ORACLE = """
with m as (
  select *, case when role = 'user' then 'call' when role = 'assistant' then 'result' else 'message' end as kind,
    case when role = 'user' then concat_ws('-', 'c', conv_id::varchar, turn::varchar)
         when role = 'assistant' then concat_ws('-', 'c', conv_id::varchar, (turn - 1)::varchar) end as call_id
  from conversations),
c as (select conv_id, call_id, min(turn) as call_turn from m where kind = 'call' group by all),
r as (select conv_id, call_id, count(*) as n from m where kind = 'result' group by all)
select m.conv_id, m.turn, m.kind, m.call_id,
  case when m.kind = 'call' then r.n is not null when m.kind = 'result' then c.call_turn is not null end as linked,
  case when m.kind = 'call' then concat_ws(';', case when m.text is null then 'text: missing' end, case when length(m.text) < 1 then 'text: out of range' end, case when m.turn < 0 then 'turn: out of range' end) else '' end as errors,
  case when m.kind = 'result' and c.call_turn is not null then greatest(m.turn, c.call_turn) else m.turn end as anchor,
  case when m.kind = 'result' and c.call_turn is not null then 1 else 0 end::bigint as step,
  case when m.kind = 'call' then '{"arguments":{"text":' || to_json(m.text)::varchar || ',"turn":' || m.turn || '},"call_id":' || to_json(m.call_id)::varchar || ',"role":' || to_json(m.role)::varchar || ',"tool":"reply"}'
       when m.kind = 'result' then '{"call_id":' || to_json(m.call_id)::varchar || ',"content":' || to_json(m.text)::varchar || ',"role":' || to_json(m.role)::varchar || '}'
       else '{"content":' || to_json(m.text)::varchar || ',"role":' || to_json(m.role)::varchar || '}' end as json
from m left join c on m.conv_id = c.conv_id and m.call_id = c.call_id left join r on m.conv_id = r.conv_id and m.call_id = r.call_id
"""
