"""Demonstration queries, one for each operator, over the driver's tables, with equivalents in SQL.

Stations are users, parameters are event types; orders stand for catalog records, parts for map units.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.functions import rules
from strataflow.operators import joins, surfaces, upsert, windows
from strataflow.plans import chosen, gridded, labelled, modelled, overlaid, records, selected, shaped, space, stacks, surfaces_plan, texts  # noqa: F401  (each registers its queries)
from strataflow.registry import ORACLE_SQL, QUERIES, query  # noqa: F401


@query(
    """with m as (select max(ts) as now from events),
    l as (select user_id, event_type, arg_min(struct_pack(ts := ts, value := value), struct_pack(a := -epoch_us(ts), b := event_id)) as r from events group by all),
    p as (select *, case event_type when 'purchase' then 0 when 'click' then 1 when 'view' then 2 else 3 end as prio, date_diff('microsecond', r.ts, now) / 3.6e9 as age from l, m)
    select user_id, string_agg(event_type || '=' || r.value::varchar, ',' order by prio, event_type) as readings,
      arg_min(event_type, struct_pack(a := prio, b := event_type)) as primary_type, count(*) as n_readings,
      case when min(age) <= 3 then 'current' when min(age) <= 72 then 'recent' else 'stale' end as status
    from p group by user_id""",
    "events",
)
def latest_station_status(events: DataFrame) -> DataFrame:
    """Latest reading per station and type, readings in priority order, the primary one, status by age."""
    last = windows.latest_by(events, ["user_id", "event_type"], [F.col("ts"), -F.col("event_id")])
    now = events.agg(F.max("ts").alias("now"))
    prio = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    aged = last.crossJoin(F.broadcast(now)).withColumn("age", (micros("now") - micros("ts")) / 3.6e9).withColumn("prio", prio)
    one = F.struct("prio", "event_type", F.concat_ws("=", "event_type", F.col("value").cast("string")).alias("s"))
    rows = aged.groupBy("user_id").agg(F.sort_array(F.collect_list(one)).alias("r"), F.min("age").alias("age"))
    return rows.select("user_id", F.array_join("r.s", ",").alias("readings"), F.get("r", 0)["event_type"].alias("primary_type"), F.size("r").cast("long").alias("n_readings"), rules.reading_status(F.col("age")).alias("status"))


@query("select s_suppkey, coalesce(nullif(trim(s_name), ''), n_name) as name, concat_ws(', ', n_name, case when s_acctbal < 0 then 'in debt' end) as label from supplier left join nation on s_nationkey = n_nationkey", "supplier", "nation")
def coalesce_aliases(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """First non-empty of several columns; non-null ones joined."""
    joined = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("s_suppkey", F.coalesce(F.nullif(F.trim("s_name"), F.lit("")), "n_name").alias("name"), F.concat_ws(", ", "n_name", F.when(F.col("s_acctbal") < 0, "in debt")).alias("label"))


@query("select p_partkey, case when p_size is null then 0.5 when p_size <= 10 then 1.0 when p_size <= 25 then 0.9 when p_size <= 40 then 0.7 else 0.4 end::double as weight, case when regexp_matches(p_type, 'ECON|PROMO') then 'cheap' when regexp_matches(p_type, '^(STANDARD|MEDIUM)') then 'plain' else 'other' end as layer from part", "part")
def scale_layer_rules(part: DataFrame) -> DataFrame:
    """Step weights by size band and ordered pattern rules."""
    layer = rules.first_class([(F.col("p_type").rlike("ECON|PROMO"), "cheap"), (F.col("p_type").rlike("^(STANDARD|MEDIUM)"), "plain")], "other")
    return part.select("p_partkey", rules.steps(F.col("p_size"), [(10, 1.0), (25, 0.9), (40, 0.7)], 0.4, 0.5).alias("weight"), layer.alias("layer"))


@query(
    """select o_orderkey, (case o_orderpriority when '1-URGENT' then 30 when '2-HIGH' then 20 else 0 end + case when o_totalprice > 300000 then 25 when o_totalprice > 100000 then 10 else 0 end + case when c_mktsegment = 'BUILDING' then 15 else 0 end)::bigint as points,
    concat_ws('; ', case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'priority' end, case when o_totalprice > 100000 then 'large' end, case when c_mktsegment = 'BUILDING' then 'segment' end) as reasons
    from orders join customer on o_custkey = c_custkey""",
    "orders",
    "customer",
)
def relevance_score(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Additive points with their reasons in order."""
    p, t, s = F.col("o_orderpriority"), F.col("o_totalprice"), F.col("c_mktsegment")
    points = F.when(p == "1-URGENT", 30).when(p == "2-HIGH", 20).otherwise(0) + F.when(t > 300000, 25).when(t > 100000, 10).otherwise(0) + F.when(s == "BUILDING", 15).otherwise(0)
    reasons = F.concat_ws("; ", F.when(p.isin("1-URGENT", "2-HIGH"), "priority"), F.when(t > 100000, "large"), F.when(s == "BUILDING", "segment"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", points.cast("long").alias("points"), reasons.alias("reasons"))


@query(
    """with l as (select doc_id, text, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) as ls from documents)
    select doc_id, len(ls)::bigint as n_lines, len(list_filter(ls, lambda x: regexp_matches(x, '[0-9]+$')))::bigint as n_numbered,
      case when length(text) < 40 then 'blank' when len(list_filter(ls, lambda x: regexp_matches(x, '[0-9]+$'))) * 2 > len(ls) then 'toc' when len(ls) = 1 and length(text) < 200 then 'title' else 'content' end as kind from l""",
    "documents",
)
def triage_pages(documents: DataFrame) -> DataFrame:
    """Page kinds by the share of lines of one form."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.trim(x)) > 0)
    rows = documents.select("doc_id", "text", lines.alias("ls")).withColumn("numbered", F.size(F.filter("ls", lambda x: x.rlike("[0-9]+$"))))
    kind = F.when(F.length("text") < 40, "blank").when(F.col("numbered") * 2 > F.size("ls"), "toc").when((F.size("ls") == 1) & (F.length("text") < 200), "title").otherwise("content")
    return rows.select("doc_id", F.size("ls").cast("long").alias("n_lines"), F.col("numbered").cast("long").alias("n_numbered"), kind.alias("kind"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(p_name, 'unnamed') as unit, coalesce(p_size, 0)::bigint as size from lineitem left join part on l_partkey = p_partkey", "lineitem", "part")
def attach_units(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Left join to a dimension with defaults."""
    joined = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce("p_name", F.lit("unnamed")).alias("unit"), F.coalesce("p_size", F.lit(0)).cast("long").alias("size"))


@query("select n as nationkey, coalesce(c, 0)::bigint as customers, coalesce(s, 0)::bigint as suppliers, case when c is null then 'new' when s is null then 'old' else 'both' end as origin from (select c_nationkey n, count(*) c from customer group by 1) full outer join (select s_nationkey n, count(*) s from supplier group by 1) using (n)", "customer", "supplier")
def upsert_catalog(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """Full outer upsert of two sources by key, with the origin of each record."""
    c = customer.groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("c"))
    s = supplier.groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("s"))
    origin = F.when(F.col("c").isNull(), "new").when(F.col("s").isNull(), "old").otherwise("both")
    return c.join(s, "nationkey", "full_outer").select("nationkey", F.coalesce("c", F.lit(0)).cast("long").alias("customers"), F.coalesce("s", F.lit(0)).cast("long").alias("suppliers"), origin.alias("origin"))


@query("with k as (select s_suppkey, s_suppkey % 25 as key from supplier) select p_partkey, count(s_suppkey)::bigint as n_suppliers, min(s_suppkey) as first_supplier from (select p_partkey, try_cast(regexp_extract(p_brand, '#([0-9]+)', 1) as bigint) as key from part) left join k using (key) group by p_partkey", "part", "supplier")
def derived_key_join(part: DataFrame, supplier: DataFrame) -> DataFrame:
    """Join on a key cut out of a label; the many side is aggregated first."""
    keyed = supplier.groupBy((F.col("s_suppkey") % 25).alias("key")).agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first_supplier"))
    parts = part.withColumn("key", F.regexp_extract("p_brand", "#([0-9]+)", 1).try_cast("bigint"))
    return parts.join(keyed, "key", "left").select("p_partkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_suppliers"), "first_supplier")


@query(
    """with e as (select p_brand, p_type, min(case when p_size > 45 then p_retailprice end) as v from part group by all), b as (select lower(p_name) as k, min(p_retailprice) as v from part group by all)
    select p_partkey, coalesce(e.v, b.v) as price from part left join e using (p_brand, p_type) left join b on lower(p_name) = k""",
    "part",
)
def correlate_two_stage(part: DataFrame) -> DataFrame:
    """Lookup by exact keys, else by name."""
    exact = part.groupBy("p_brand", "p_type").agg(F.min(F.when(F.col("p_size") > 45, F.col("p_retailprice"))).alias("price"))
    named = part.groupBy(F.lower("p_name").alias("k")).agg(F.min("p_retailprice").alias("price"))
    return joins.two_stage(part.withColumn("k", F.lower("p_name")), exact, named, ["p_brand", "p_type"], "k", "price").select("p_partkey", "price")


@query("select o_orderkey, l_partkey, l_suppkey, l_quantity from orders left join (select *, row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey) as n from lineitem) on o_orderkey = l_orderkey and n = 1", "orders", "lineitem")
def first_observation(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Left join to the first row of each key; firsts are found before the join with a combined minimum."""
    first = windows.first_by(lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_linenumber"), ["l_orderkey"], [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")])
    return orders.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_partkey", "l_suppkey", "l_quantity")


@query(
    """with p as (select vec_id, label, (embedding[1] * 10)::double as x, (embedding[2] * 10)::double as y from embeddings),
    n as (select a.vec_id, count(distinct b.label) as k from p a join p b on a.label <> b.label and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.25 group by 1)
    select vec_id, coalesce(k, 0)::bigint as agreeing, round(greatest(0.6, least(0.98, 1 - (1 - 0.6) * pow(0.7, coalesce(k, 0)))), 6) as confidence from p left join n using (vec_id)""",
    "embeddings",
)
def source_agreement(embeddings: DataFrame) -> DataFrame:
    """Points of other sources within a distance, found through cells, boost the confidence."""
    p = embeddings.select("vec_id", "label", (F.get("embedding", 0) * F.lit(10).cast("float")).cast("double").alias("x"), (F.get("embedding", 1) * F.lit(10).cast("float")).cast("double").alias("y"))
    q = p.select(F.col("label").alias("b_label"), F.col("x").alias("bx"), F.col("y").alias("by"))
    pairs = joins.distance_join(p, q, "x", "y", "bx", "by", 0.25, F.col("label") != F.col("b_label"))
    agreed = pairs.groupBy("vec_id").agg(F.countDistinct("b_label").alias("k"))
    k = F.coalesce("k", F.lit(0))
    return p.join(agreed, "vec_id", "left").select("vec_id", k.cast("long").alias("agreeing"), F.round(rules.boosted(F.lit(0.6), k), 6).alias("confidence"))


@query(
    """with e as (select event_id, user_id, ts from events where event_type = 'error'), p as (select user_id, ts as pts, value from events where event_type = 'purchase')
    select event_id, user_id, pts as nearest_ts, value as nearest_value from (select e.*, p.pts, p.value, row_number() over (partition by event_id order by abs(epoch_us(e.ts) - epoch_us(pts)), pts) as n from e left join p using (user_id)) where n = 1""",
    "events",
)
def nearest_in_time(events: DataFrame) -> DataFrame:
    """As-of join to the nearest row in time."""
    errors = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    return joins.nearest_in_time(errors, events.where("event_type = 'purchase'").select("user_id", "ts", "value"), "user_id", "ts", "value").drop("ts")


@query("select o_orderpriority as priority, count(*) as n, count(*) filter (where o_totalprice > 200000) as n_large, count(*) filter (where o_orderstatus = 'F') as n_done, count(distinct o_custkey) as n_customers from orders group by 1", "orders")
def catalog_summary(orders: DataFrame) -> DataFrame:
    """Counts by key, conditional counts."""
    return orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("n_large"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"), F.countDistinct("o_custkey").alias("n_customers"))


@query("select o_custkey, count(*) as n from orders group by 1 order by n desc, o_custkey limit 12", "orders")
def most_common(orders: DataFrame) -> DataFrame:
    """The twelve most frequent keys."""
    return orders.groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(12)


@query("select user_id, string_agg(distinct event_type, ',' order by event_type) as types from events group by 1", "events")
def distinct_sets(events: DataFrame) -> DataFrame:
    """Sorted sets per key."""
    return events.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("types"))


@query(
    """with f as (select regr_slope(l_extendedprice, l_quantity) as m, regr_intercept(l_extendedprice, l_quantity) as b from lineitem), e as (select l_returnflag, l_extendedprice - (m * l_quantity + b) as e from lineitem, f)
    select l_returnflag, count(*) as n, round(sqrt(avg(e * e)), 3) as rmse, round(avg(abs(e)), 3) as mae, round(avg(e), 3) as bias from e group by 1""",
    "lineitem",
)
def error_stats(lineitem: DataFrame) -> DataFrame:
    """Residuals of a linear fit: n, RMSE, MAE, bias per group."""
    fit = lineitem.agg(F.regr_slope("l_extendedprice", "l_quantity").alias("m"), F.regr_intercept("l_extendedprice", "l_quantity").alias("b"))
    e = F.col("l_extendedprice") - (F.col("m") * F.col("l_quantity") + F.col("b"))
    rows = lineitem.crossJoin(F.broadcast(fit)).select("l_returnflag", e.alias("e"))
    stats = rows.groupBy("l_returnflag").agg(*surfaces.error_stats(F.col("e")))
    return stats.select("l_returnflag", "n", *(F.round(c, 3).alias(c) for c in ("rmse", "mae", "bias")))


@query(
    """with s as (select user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) as step from events),
    m as (select user_id, list_sort(list(step) filter (where step is not null))[(count(step) // 2 + 1)::int] as med from s group by 1),
    b as (select s.*, case when step > greatest(3.0 * med, 7.2e9) then 1 else 0 end as brk from s join m using (user_id)),
    g as (select user_id, ts, sum(brk) over (partition by user_id order by ts) as segment from b)
    select user_id, segment::bigint as segment, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from g group by all""",
    "events",
)
def gap_segments(events: DataFrame) -> DataFrame:
    """Segments of a series, broken at gaps over three upper-median steps and two hours."""
    cut = windows.gap_segments(events.select("user_id", "ts"), "user_id", "ts", 3.0, 7200)
    return cut.groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("with i as (select conv_id, turn, turn - row_number() over (partition by conv_id order by turn) as g from (select distinct conv_id, turn from conversations)), r as (select conv_id, min(turn) as a, max(turn) as b from i group by conv_id, g) select conv_id, string_agg(case when a = b then a::varchar else a || '-' || b end, ', ' order by a) as ranges from r group by 1", "conversations")
def page_ranges(conversations: DataFrame) -> DataFrame:
    """Runs of consecutive numbers as text."""
    runs = windows.islands(conversations, "conv_id", "turn")
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    return runs.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", text.alias("t")))), lambda x: x["t"]), ", ").alias("ranges"))


@query("select doc_id, source, n_chars from (select doc_id, source, n_chars, row_number() over w as n, sum(n_chars) over (w rows unbounded preceding) as spent from documents window w as (partition by source order by n_chars desc, doc_id)) where n = 1 or spent <= 40000", "documents")
def budget_take(documents: DataFrame) -> DataFrame:
    """Rows per source while their sizes fit a budget; the first always."""
    return windows.within_budget(documents.select("doc_id", "source", "n_chars"), "source", [-F.col("n_chars"), F.col("doc_id")], F.col("n_chars"), 40000)


@query(
    """with o as (select o_orderkey as k, strftime(o_orderdate, '%Y-%m') as page, o_totalprice as v from orders), n as (select l_orderkey as k, strftime(l_shipdate, '%Y-%m') as page, sum(l_quantity) as v from lineitem group by all), r as (select distinct page from n where page like '%-06')
    select k, page, v, case when page in (select page from r) or (k, page) in (select (k, page) from n) then 'history' else 'kept' end as state from o union all select k, page, v, 'fresh' from n""",
    "orders",
    "lineitem",
)
def versioned_merge(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Kept, fresh and replaced values of two readings: by key and page, and whole pages that were read again."""
    month = lambda c: F.date_format(c, "yyyy-MM").alias("page")
    old = orders.select(F.col("o_orderkey").alias("k"), month("o_orderdate"), F.col("o_totalprice").alias("v"))
    new = lineitem.groupBy(F.col("l_orderkey").alias("k"), month("l_shipdate")).agg(F.sum("l_quantity").alias("v"))
    again = new.where("page like '%-06'").select("page").distinct()
    return upsert.versioned_merge(old, new, ["k", "page"], "page", again)


@query("select o_orderkey, case o_orderstatus when 'P' then 'Y' when 'X' then 'Y' else o_orderstatus end as status, (case when o_orderstatus in ('P', 'X') then 2 when o_orderstatus = 'Y' then 1 else 0 end)::bigint as applied, (case when o_orderstatus in ('P', 'X') then 0 when o_orderstatus = 'Y' then 1 else 2 end)::bigint as stale from orders", "orders")
def corrections(orders: DataFrame) -> DataFrame:
    """Corrections, two to a row, take effect one after the other and only where the value is the expected one."""
    fixes = orders.select("o_orderkey", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("P").alias("old"), F.lit("X").alias("new")), F.struct(F.lit(2).alias("seq"), F.lit("X").alias("old"), F.lit("Y").alias("new")))).alias("f")).select("o_orderkey", "f.*")
    fixed, _ = upsert.corrected(orders.select("o_orderkey", F.col("o_orderstatus").alias("status")), fixes, "o_orderkey", "status")
    return fixed.select("o_orderkey", "status", F.col("applied").cast("long").alias("applied"), F.col("stale").cast("long").alias("stale"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, '{\"k\":' || json_extract_string(props, '$.k') || ',\"type\":\"' || event_type || '\"}' as doc from events", "events")
def json_values(events: DataFrame) -> DataFrame:
    """Values out of JSON text and back into it."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return events.select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type"))).alias("doc"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, u.m as measure, u.v as value from lineitem, unnest([{'m': 'quantity', 'v': l_quantity}, {'m': 'price', 'v': l_extendedprice}, {'m': 'discount', 'v': l_discount}]) as t(u)", "lineitem")
def expand_table(lineitem: DataFrame) -> DataFrame:
    """Columns of measures to long rows."""
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    wide = lineitem.select(*ids, F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"))
    return wide.unpivot(ids, ["quantity", "price", "discount"], "measure", "value")


@query("select o_orderkey, concat_ws('; ', case when o_totalprice < 1000 then 'price too small' end, case when o_orderstatus not in ('F', 'O') then 'status unknown' end, case when o_orderdate < timestamp '1996-01-01' then 'too old' end) as errors from orders", "orders")
def validate_rules(orders: DataFrame) -> DataFrame:
    """A list of broken rules per row."""
    errors = F.concat_ws("; ", F.when(F.col("o_totalprice") < 1000, "price too small"), F.when(~F.col("o_orderstatus").isin("F", "O"), "status unknown"), F.when(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"), "too old"))
    return orders.select("o_orderkey", errors.alias("errors"))


@query("select p_brand, p_type, count(*) as n, string_agg(distinct p_name, ',' order by p_name) as names, arg_min(p_name, struct_pack(a := length(p_name), b := p_name)) as shortest from part group by all", "part")
def legend_tree(part: DataFrame) -> DataFrame:
    """Two-level groups with label sets, shortest label and counts."""
    return part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("p_name")), ",").alias("names"), F.min(F.struct(F.length("p_name").alias("a"), F.col("p_name").alias("b")))["b"].alias("shortest"))


@query("select p_partkey, l_orderkey, l_linenumber, l_suppkey from part join (select *, row_number() over (partition by l_partkey order by l_discount desc, l_quantity, l_orderkey, l_linenumber, l_suppkey, l_shipdate) as n from lineitem) on p_partkey = l_partkey and n = 1", "part", "lineitem")
def priority_winner(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    """The best-ranked row per key."""
    cols = ["l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_discount", "l_quantity", "l_shipdate"]
    best = windows.first_by(lineitem.select(*cols), ["l_partkey"], [-F.col("l_discount"), *(F.col(c) for c in ("l_quantity", "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate"))])
    return part.join(best, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "l_orderkey", "l_linenumber", "l_suppkey")


@query("select count(*) filter (where regexp_matches(p_type, '^[A-Z]+$'))::double / count(*) as type_share, count(distinct p_type) as types, count(*) filter (where regexp_matches(p_brand, '#[0-9]{2}$'))::double / count(*) as brand_share, count(distinct p_brand) as brands from part", "part")
def column_profile(part: DataFrame) -> DataFrame:
    """Share of values of a form and distinct counts per column."""
    share = lambda c, p: F.count_if(F.col(c).rlike(p)) / F.count("*")
    return part.agg(share("p_type", "^[A-Z]+$").alias("type_share"), F.countDistinct("p_type").alias("types"), share("p_brand", "#[0-9]{2}$").alias("brand_share"), F.countDistinct("p_brand").alias("brands"))


@query("with p as (select label, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings), s as (select label, count(*) n, regr_slope(z, x) as bx, avg(z) as mz from p group by 1) select label, n, round(bx, 5) as slope, round(mz, 5) as mean from s", "embeddings")
def trend(embeddings: DataFrame) -> DataFrame:
    """A linear trend per group from sums alone."""
    p = embeddings.select("label", *(F.get("embedding", i).cast("double").alias(c) for i, c in enumerate("xyz")))
    return p.groupBy("label").agg(F.count("*").alias("n"), F.round(F.regr_slope("z", "x"), 5).alias("slope"), F.round(F.avg("z"), 5).alias("mean"))


@query(
    """with p as (select vec_id, label, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings)
    select a.vec_id, round(sum(b.z / ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) / sum(1 / ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 4) as estimate from p a join p b on a.label = b.label and a.vec_id <> b.vec_id group by 1""",
    "embeddings",
)
def idw_loo(embeddings: DataFrame) -> DataFrame:
    """Leave-one-out inverse-distance estimates within each surface's points."""
    p = embeddings.select("vec_id", "label", *(F.get("embedding", i).cast("double").alias(c) for i, c in enumerate("xyz")))
    return surfaces.idw_loo(p, "vec_id", "label", "x", "y", "z").withColumn("estimate", F.round("estimate", 4))


@query("select user_id, time_bucket(interval 1 day, ts) as day, round(avg(value), 6) as mean, count(*) as n from events group by all", "events")
def daily_means(events: DataFrame) -> DataFrame:
    """Daily means per station."""
    return events.groupBy("user_id", F.window("ts", "1 day")["start"].alias("day")).agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@query(
    """with b as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as brk from events), s as (select user_id, ts, sum(brk) over (partition by user_id order by ts) as k from b)
    select user_id, min(ts) as started, count(*) as n from s group by user_id, k""",
    "events",
)
def session_debounce(events: DataFrame) -> DataFrame:
    """Sessions that end after six quiet hours."""
    return events.groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.min("ts").alias("started"), F.count("*").alias("n")).select("user_id", "started", "n")


@query("select o_orderkey, l_partkey, l_quantity from orders join (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_partkey, l_linenumber, l_suppkey, l_shipdate) as k from lineitem) on o_orderkey = l_orderkey and k = 1 where o_orderstatus = 'F' and o_custkey in (select c_custkey from customer where c_mktsegment = 'MACHINERY')", "orders", "lineitem", "customer")
def top_component(orders: DataFrame, lineitem: DataFrame, customer: DataFrame) -> DataFrame:
    """The largest part of each selected record, the first by key at a tie, with the correlated subquery rewritten as a
    minimum that is combined before the shuffle."""
    chosen = orders.where("o_orderstatus = 'F'").join(customer.where("c_mktsegment = 'MACHINERY'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    rank = [-F.col("l_extendedprice"), *(F.col(c) for c in ("l_partkey", "l_linenumber", "l_suppkey", "l_shipdate"))]
    top = windows.first_by(lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_linenumber", "l_suppkey", "l_shipdate"), ["l_orderkey"], rank)
    return top.join(chosen, F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey", "l_partkey", "l_quantity")
