"""Queries of packets, progress, differences, nested values, tallies and orders of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.functions import rules, schemas
from strataflow.operators import nested, sequences, surfaces, upsert, windows
from strataflow.registry import query


@query(
    """with recursive s as (select conv_id, turn, coalesce(length(text), 0) as n, row_number() over (partition by conv_id order by turn) as k from conversations),
    p as (select conv_id, turn, n, k, n as used, 1 as packet from s where k = 1 union all select s.conv_id, s.turn, s.n, s.k, case when p.used + s.n > 600 then s.n else p.used + s.n end, case when p.used + s.n > 600 then p.packet + 1 else p.packet end from p join s on p.conv_id = s.conv_id and s.k = p.k + 1)
    select conv_id, packet::bigint as packet, string_agg(turn::varchar, ',' order by turn) as turns, sum(n)::bigint as size from p group by all""",
    "conversations",
)
def pack_packets(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation into packets of limited size."""
    sized = conversations.select("conv_id", "turn", F.coalesce(F.char_length("text"), F.lit(0)).alias("n"))
    rows = sequences.packets(sized, "conv_id", "turn", "n", 600)
    turns = F.transform(F.sort_array(F.collect_list("turn")), lambda t: t.cast("string"))
    return rows.groupBy("conv_id", "packet").agg(F.array_join(turns, ",").alias("turns"), F.sum("n").alias("size"))


@query(
    """with b as (select l_orderkey, list_sort(list(distinct l_linenumber::varchar)) as every, list_sort(list(distinct l_linenumber::varchar) filter (where l_linestatus = 'F')) as done, list_sort(list(distinct l_linenumber::varchar) filter (where l_returnflag = 'A')) as now from lineitem group by 1)
    select l_orderkey, list_aggregate(list_filter(every, lambda x: list_contains(coalesce(done, []), x) or list_contains(coalesce(now, []), x)), 'string_agg', ',') as done, len(list_filter(every, lambda x: not (list_contains(coalesce(done, []), x) or list_contains(coalesce(now, []), x)))) = 0 as complete from b""",
    "lineitem",
)
def progress_subset(lineitem: DataFrame) -> DataFrame:
    """Blocks done before and now, in order, and whether all are."""
    block = F.col("l_linenumber").cast("string")
    of = lambda c: F.sort_array(F.collect_set(F.when(c, block)))
    rows = lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_set(block)).alias("every"), of(F.col("l_linestatus") == "F").alias("before"), of(F.col("l_returnflag") == "A").alias("now"))
    done, complete = upsert.progress(F.col("before"), F.col("now"), F.col("every"))
    return rows.select("l_orderkey", F.nullif(F.array_join(done, ","), F.lit("")).alias("done"), complete.alias("complete"))


@query(
    """with d as (select p_partkey, case when p_size > 25 then 'large' else 'small' end as before, case when p_size > 30 then 'large' when p_size < 5 then null else 'small' end as after from part)
    select * from d where before is distinct from after""",
    "part",
)
def renormalize_diff(part: DataFrame) -> DataFrame:
    """Derived values that change when they are derived again."""
    n = F.col("p_size")
    old = part.select("p_partkey", F.when(n > 25, "large").otherwise("small").alias("v"))
    new = part.select("p_partkey", F.when(n > 30, "large").when(n < 5, None).otherwise("small").alias("v"))
    return upsert.changes(old, new, ["p_partkey"], "v")


@query(
    """with n as (select distinct c_nationkey as k, 'customer' as origin, c_mktsegment as note from customer), o as (select s_nationkey as k, 'supplier' as origin, s_name as note from supplier)
    select k, origin, note from n union all select * from o where k not in (select k from n)""",
    "customer",
    "supplier",
)
def replace_scope(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """Rows of a scope replaced by new ones."""
    new = customer.select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("origin"), F.col("c_mktsegment").alias("note")).distinct()
    old = supplier.select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("origin"), F.col("s_name").alias("note"))
    return upsert.replaced(old, new, ["k"])


@query(
    """with a as (select s_nationkey as k, s_acctbal as v from supplier union all select c_nationkey, c_acctbal from customer), g as (select k from a group by 1 having min(v) > -990 and count(*) > 3)
    select k, count(*) as n, round(sum(v), 2) as total from a where k in (select k from g) group by 1""",
    "customer",
    "supplier",
)
def union_gate(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """Several files of a source, taken whole or not at all."""
    parts = [supplier.select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("v")), customer.select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v"))]
    rows = upsert.gated(parts, "k", (F.min("v") > -990) & (F.count("*") > 3))
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))


@query(
    """select event_type, floor(min(value) / s + 1e-9) * s as lo, ceil(max(value) / s - 1e-9) * s as hi, s as step, (round((ceil(max(value) / s - 1e-9) - floor(min(value) / s + 1e-9))) + 1)::bigint as ticks from events
      join (select event_type, list_filter(list_transform([1.0, 2.0, 2.5, 5.0, 10.0], lambda m: m::double * p), lambda v: v >= raw * 0.999)[1] as s from (select event_type, (max(value) - min(value)) / 4 as raw, pow(10.0, floor(log10((max(value) - min(value)) / 4))) as p from events group by 1)) using (event_type) group by event_type, s""",
    "events",
)
def nice_ticks(events: DataFrame) -> DataFrame:
    """Axes of round steps."""
    ends = events.groupBy("event_type").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    return ends.select("event_type", sequences.axis(F.col("a"), F.col("b")).alias("x")).select("event_type", "x.*")


@query(
    """with n as (select doc_id, n_chars, case when n_chars <= 800 then 1 else ceil((n_chars - 100) / 700.0::double) end::int as n from documents), z as (select *, least(n_chars, ceil((n_chars + (n - 1) * 100) / n::double))::int as size from n)
    select doc_id, i + 1 as number, case when n = 1 then 0 else round(i * (n_chars - size) / (n - 1)::double) end::bigint as first, least(n_chars, case when n = 1 then 0 else round(i * (n_chars - size) / (n - 1)::double) end + size)::bigint as last from z, unnest(range(n)) as r(i)""",
    "documents",
)
def cover_spans(documents: DataFrame) -> DataFrame:
    """Overlapping spans that cover a length."""
    made = sequences.spans(F.col("n_chars"), 800, 100)
    return documents.select("doc_id", F.posexplode(made).alias("i", "s")).select("doc_id", (F.col("i") + 1).cast("long").alias("number"), F.col("s.first").cast("long").alias("first"), F.col("s.last").cast("long").alias("last"))


@query(
    """with o as (select user_id, event_type, ts, event_id, row_number() over (partition by user_id order by ts, event_id) as k, lag(event_type) over (partition by user_id order by ts, event_id) as before, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events)
    select user_id, event_type, k as depth from o where n = 1 and k > 1 and event_type is distinct from before""",
    "events",
)
def contacts(events: DataFrame) -> DataFrame:
    """First appearances down a hole, below its top."""
    from pyspark.sql import Window

    deep = events.withColumn("depth", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    return sequences.first_appearances(deep, "user_id", [F.col("ts"), F.col("event_id")], "event_type", "depth").select("user_id", "event_type", (F.col("depth") + 1).cast("long").alias("depth"))


@query(
    """with f as (select o_custkey, lower(o_orderpriority) as low, arg_min(o_orderpriority, o_orderkey) as v, min(o_orderkey) as k from orders group by all) select o_custkey, string_agg(v, '; ' order by k) as priorities from f group by 1""",
    "orders",
)
def ordered_distinct(orders: DataFrame) -> DataFrame:
    """Distinct values in the order of their first appearance."""
    first = orders.groupBy("o_custkey", F.lower("o_orderpriority").alias("low")).agg(F.min(F.struct("o_orderkey", "o_orderpriority")).alias("f"))
    listed = first.groupBy("o_custkey").agg(F.sort_array(F.collect_list("f")).alias("f"))
    return listed.select("o_custkey", F.array_join(sequences.ordered_distinct(F.col("f.o_orderpriority")), "; ").alias("priorities"))


@query(
    """select 'tier' || case when n_chars < 1000 then 0 when n_chars < 4000 then 1 else 2 end || ':' || lang as key, count(*) as n, count(*) filter (where quality = 1) as good, count(*) filter (where quality = 0) as poor, count(*) filter (where toxic = 1) as toxic, count(*) filter (where quality is null) as unlabelled from documents left join labels using (doc_id) group by 1""",
    "documents",
    "labels",
)
def quality_totals(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Tallies by a composite key, and of each verdict."""
    tier = F.when(F.col("n_chars") < 1000, "0").when(F.col("n_chars") < 4000, "1").otherwise("2")
    rows = documents.join(labels, "doc_id", "left").groupBy(F.concat(F.lit("tier"), tier, F.lit(":"), F.col("lang")).alias("key"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("poor"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))


@query(
    """with c(class, place) as (values ('ECONOMY', 1), ('SMALL', 2), ('PROMO', 3), ('Unknown', 4)) select class, place, count(*) as n from (select coalesce(c.class, 'Unknown') as class from part left join c on p_type = c.class) join c using (class) group by all""",
    "part",
)
def legend_counts(part: DataFrame) -> DataFrame:
    """Counts by class in a fixed order, others as unknown."""
    classes = part.sparkSession.createDataFrame([("ECONOMY", 1), ("SMALL", 2), ("PROMO", 3), ("Unknown", 4)], "class string, place int")
    return surfaces.legend_counts(part, "p_type", classes)


@query(
    """with b as (select p_type, p_brand, count(*) as n, min(struct_pack(l := length(p_name), t := p_name)) as s from part group by all) select p_type, sum(n)::bigint as n, string_agg(p_brand || ':' || n || ':' || s.t, ',' order by p_brand) as brands from b group by 1""",
    "part",
)
def nested_legend(part: DataFrame) -> DataFrame:
    """Two levels of groups: counts and shortest labels of the inner one listed in the outer one."""
    inner = part.groupBy("p_type", "p_brand").agg(F.count("*").alias("n"), F.min(F.struct(F.char_length("p_name").alias("l"), F.col("p_name").alias("t"))).alias("s"))
    entry = F.struct("p_brand", F.concat_ws(":", "p_brand", F.col("n").cast("string"), "s.t").alias("t"))
    outer = inner.groupBy("p_type").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(entry)).alias("b"))
    return outer.select("p_type", "n", F.array_join(F.col("b.t"), ",").alias("brands"))


@query(
    """select l_orderkey, '[' || string_agg('[' || l_linenumber || ',' || l_partkey || ',' || l_quantity::bigint || ']', ',' order by l_linenumber, l_partkey, l_suppkey, l_shipdate) || ']' as rows, count(*) as n from lineitem group by 1""",
    "lineitem",
)
def column_arrays(lineitem: DataFrame) -> DataFrame:
    """Long rows as arrays whose columns are named once."""
    return nested.column_once(lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], [F.col("l_linenumber").cast("bigint"), F.col("l_partkey"), F.col("l_quantity").cast("bigint")])


@query(
    """with l as (select l_orderkey, list(struct_pack(q := l_quantity::bigint, p := l_partkey) order by l_partkey, l_linenumber, l_suppkey, l_shipdate) filter (where l_quantity > 25) as kept, count(*) as n from lineitem group by 1)
    select l_orderkey, len(kept)::bigint as kept, n - len(kept) as dropped from l where len(kept) > 0""",
    "lineitem",
)
def prune_nested(lineitem: DataFrame) -> DataFrame:
    """Nested values without those that a rule drops, and without parents left empty."""
    docs = lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("q"), F.col("l_partkey").alias("p"))).alias("v"))
    kept = nested.pruned(docs, "v", lambda v: v["q"] <= 25)
    return kept.join(docs.select("l_orderkey", F.size("v").alias("all")), "l_orderkey").select("l_orderkey", F.size("v").cast("long").alias("kept"), (F.col("all") - F.size("v")).cast("long").alias("dropped"))


@query(
    """select c_custkey, '{' || concat_ws(',', '"id":' || c_custkey, case when c_acctbal > 0 then '"name":"' || c_name || '"' end, case when c_mktsegment = 'BUILDING' then '"segment":"BUILDING"' end) || '}' as doc from customer""",
    "customer",
)
def null_drop(customer: DataFrame) -> DataFrame:
    """Structs written without their null fields."""
    doc = F.struct(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("name"), F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_mktsegment")).alias("segment"))
    return customer.select("c_custkey", F.to_json(doc, {"ignoreNullFields": "true"}).alias("doc"))


@query(
    """select user_id, arg_min(event_id, struct_pack(v := value, e := event_id)) as lowest, arg_max(event_id, struct_pack(v := value, e := event_id)) as highest from events group by 1""",
    "events",
)
def extreme_points(events: DataFrame) -> DataFrame:
    """The lowest and highest point of each series."""
    point = F.struct("value", "event_id")
    return events.groupBy("user_id").agg(F.min(point)["event_id"].alias("lowest"), F.max(point)["event_id"].alias("highest"))


@query(
    """select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F') and c_custkey in (select o_custkey from orders) and c_nationkey not in (select s_nationkey from supplier where s_acctbal < 0)""",
    "customer",
    "orders",
    "supplier",
)
def exclusions(customer: DataFrame, orders: DataFrame, supplier: DataFrame) -> DataFrame:
    """Rows that are known (semi join) and neither done nor excluded (anti joins)."""
    done = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    barred = supplier.where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey"))
    known = orders.select(F.col("o_custkey").alias("c_custkey"))
    return customer.join(known, "c_custkey", "left_semi").join(done, "c_custkey", "left_anti").join(barred, "c_nationkey", "left_anti").select("c_custkey")


@query(
    """select o_orderkey, row_number() over (partition by o_custkey order by case o_orderstatus when 'P' then 0 when 'O' then 1 else 2 end, coalesce(o_totalprice, 1e12), o_orderkey) as place from orders""",
    "orders",
)
def queue_order(orders: DataFrame) -> DataFrame:
    """A queue in order of status, size and key, numbered within each owner."""
    from pyspark.sql import Window

    status = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    w = Window.partitionBy("o_custkey").orderBy(status, F.coalesce("o_totalprice", F.lit(1e12)), "o_orderkey")
    return orders.select("o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query(
    """with t as (select user_id, list(distinct event_type) as t from events group by 1) select user_id, case when user_id::varchar like '1%' then 'well' when user_id::varchar like '2%' then 'lake' when list_contains(t, 'error') then 'tidal' else 'stream' end as type from t""",
    "events",
)
def station_types(events: DataFrame) -> DataFrame:
    """Types of stations from their codes, else from what they measure."""
    rows = events.groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    return rows.select("user_id", rules.station_type(F.col("user_id").cast("string"), F.col("t"), [("1", "well"), ("2", "lake")], [(["error"], "tidal")], "stream").alias("type"))


@query(
    """select count(*) as n, count(*) filter (where p_name like '%water%' or lower(trim(p_brand)) = 'water' or lower(p_type) like 'water%') as wet, count(*) filter (where not (regexp_matches(p_name, 'old') or regexp_matches(p_type, 'PROMO') or regexp_matches(p_brand, '#1$'))) as mapped from part""",
    "part",
)
def placeholders(part: DataFrame) -> DataFrame:
    """Rows of water, and rows without a placeholder in any of several columns."""
    from strataflow.functions import parsing

    wet = rules.is_water(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.lit(None).cast("string"))
    bare = parsing.any_of([F.col("p_name")], "old") | parsing.any_of([F.col("p_type")], "PROMO") | parsing.any_of([F.col("p_brand")], "#1$")
    return part.agg(F.count("*").alias("n"), F.count_if(wet).alias("wet"), F.count_if(~bare).alias("mapped"))


@query(
    """with a as (select user_id, event_type, value, ts, event_id from events), last as (select user_id, max(ts) as t from a group by 1), keep as (select a.* from a join last using (user_id) where ts >= t - interval 5 day)
    select user_id, event_type, arg_max(value, struct_pack(ts := ts, e := -event_id)) as value, count(*) as n from keep group by all""",
    "events",
)
def area_replace(events: DataFrame) -> DataFrame:
    """The latest value of each series of an area; series that were quiet when the area was read again are gone."""
    last = events.groupBy("user_id").agg(F.max("ts").alias("t"))
    recent = events.join(last, "user_id").where(F.col("ts") >= F.col("t") - F.expr("interval 5 days"))
    latest = windows.latest_by(recent.select("user_id", "event_type", "value", "ts", "event_id"), ["user_id", "event_type"], [F.col("ts"), -F.col("event_id")])
    counts = recent.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return latest.select("user_id", "event_type", "value").join(counts, ["user_id", "event_type"])


#: What an event's text must be.
EVENT = {
    "type": "object", "required": ["kind", "value"], "additionalProperties": False,
    "properties": {"kind": {"enum": ["click", "purchase", "view"]}, "value": {"type": "number", "minimum": 20}, "tags": {"type": "array", "items": {"type": "string", "maxLength": 6}}},
}


@query(
    """select event_id, concat_ws('; ', case when event_type not in ('click', 'purchase', 'view') then 'kind: must be one of ["click","purchase","view"]' end, case when value < 20 then 'value: must be 20 or more' end,
      case when length(event_type) > 6 then 'tags[0]: longer than 6 characters' end, case when user_id % 3 = 0 then 'tags[1]: expected string, got integer' end, case when user_id % 5 = 0 then 'more: unexpected field' end) as errors from events""",
    "events",
)
def schema_errors(events: DataFrame) -> DataFrame:
    """Errors, with their paths, of JSON texts against a schema."""
    said = lambda c: F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.char_length(F.to_json(F.struct(c.alias("v")))) - 6)
    user = F.col("user_id").cast("string")
    tag = F.when(F.col("user_id") % 3 == 0, user).otherwise(F.concat(F.lit('"'), user, F.lit('"')))
    more = F.when(F.col("user_id") % 5 == 0, ',"more":1').otherwise("")
    text = F.concat(F.lit('{"kind":'), said(F.col("event_type")), F.lit(',"value":'), F.col("value").cast("string"), F.lit(',"tags":['), said(F.col("event_type")), F.lit(","), tag, F.lit("]"), more, F.lit("}"))
    return events.select("event_id", F.array_join(schemas.errors(text, EVENT), "; ").alias("errors"))
