"""Queries of what is included, sampled, queued, carried on and dropped, of names, and of joins into cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.functions import coordinates, names
from strataflow.operators import nested, selection, windows
from strataflow.plans.labelled import _answers, _case
from strataflow.plans.space import points
from strataflow.registry import query


@query(
    """with o as (select s_suppkey, s_acctbal, case when s_suppkey % 5 = 0 then 'package' when s_suppkey % 3 = 0 then 'shapes' end as own from supplier), e as (select distinct c_custkey as s_suppkey from customer where c_custkey % 40 = 1 and c_custkey < 400)
    select s_suppkey, coalesce(own, 'extra') as kind, case when s_acctbal > 5000 then 'too coarse' when s_acctbal is null then 'unknown scale' end as skip from o full outer join e using (s_suppkey) where own is not null or s_suppkey in (select s_suppkey from e)""",
    "supplier",
    "customer",
)
def source_inclusion(supplier: DataFrame, customer: DataFrame) -> DataFrame:
    """Sources to merge: by rule, and extra ones; with the reason of those that cannot be used."""
    key, balance = F.col("s_suppkey"), F.col("s_acctbal")
    extra = customer.where("c_custkey % 40 = 1 and c_custkey < 400").select(F.col("c_custkey").alias("s_suppkey"), F.lit("extra").alias("kind"))
    rules = [(key % 5 == 0, "package"), (key % 3 == 0, "shapes")]
    skips = [(balance > 5000, F.lit("too coarse")), (balance.isNull(), F.lit("unknown scale"))]
    return selection.included(supplier.select("s_suppkey", "s_acctbal"), extra, "s_suppkey", rules, skips).select("s_suppkey", "kind", "skip")


@query(
    """select event_id, event_type from events where event_type = 'error' or ('0x' || substr(md5('verify:' || event_id), 1, 8))::bigint < floor(0.15 * 4294967296)""",
    "events",
)
def verify_sample(events: DataFrame) -> DataFrame:
    """What must be read again, and a steady share of the rest."""
    return selection.to_verify(events, F.col("event_type") == "error", F.col("event_id"), "verify", 0.15).select("event_id", "event_type")


@query(
    """with v as (select distinct o_custkey as k from orders where o_orderstatus <> 'P')
    select c_custkey as k, 'old' as reason from customer where c_acctbal < 4000 and c_custkey not in (select k from v) and c_nationkey not in (select n_nationkey from nation where n_regionkey = 1)
    union all select o_custkey, 'new' from orders where o_orderstatus <> 'P' group by 1 having count(*) filter (where o_orderstatus = 'O') = 0""",
    "customer",
    "orders",
    "nation",
)
def needs_access(customer: DataFrame, orders: DataFrame, nation: DataFrame) -> DataFrame:
    """The list of records without a text: unvisited ones are carried on, solved and excluded ones go."""
    old = customer.where("c_acctbal < 4000").select(F.col("c_custkey").alias("k"), F.lit("old").alias("reason"))
    seen = orders.where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("solved"))
    fresh = seen.where("solved = 0").select("k", F.lit("new").alias("reason"))
    out = customer.join(nation.where("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select(F.col("c_custkey").alias("k"))
    return selection.carried(old, seen, fresh, "k", out)


@query(
    """with i as (select l_orderkey as k, list(distinct l_linenumber) as pages from lineitem where l_quantity > 30 group by 1), m as (select o_orderkey as k, [1, 2] as pages from orders where o_orderkey % 7 = 0),
    q as (select k, coalesce(i.pages, m.pages) as pages, case when i.k is not null then 'notes' else 'manual' end as origin from i full outer join m using (k)), c as (select l_orderkey as k, list(distinct l_linenumber) as seen, max(l_shipdate) as t from lineitem where l_returnflag <> 'N' group by 1)
    select k, origin, len(pages)::int as n, case when len(list_filter(pages, lambda p: not list_contains(coalesce(seen, []), p))) = 0 then 'done' else 'pending' end as status, case when len(list_filter(pages, lambda p: not list_contains(coalesce(seen, []), p))) = 0 then t end as done_at from q left join c using (k)""",
    "lineitem",
    "orders",
)
def reread_queue(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Items to read again from two origins, done once their pages are covered."""
    noted = lineitem.where("l_quantity > 30").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_set("l_linenumber")).alias("pages"))
    manual = orders.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("k"), F.array(F.lit(1), F.lit(2)).alias("pages"))
    covered = lineitem.where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("k"), F.array("l_linenumber").alias("pages"), F.col("l_shipdate").alias("at"))
    return selection.queue([("notes", noted), ("manual", manual)], covered, "k", "pages").select("k", "origin", F.size("pages").alias("n"), "status", "done_at")


@query(
    """select event_type, reason, count(*) as n from (select event_type, case when value < 5 then 'too low' when value > 60 then 'too high' when user_id % 10 = 0 then 'no place' end as reason from events) where reason is not null group by all""",
    "events",
)
def drop_counters(events: DataFrame) -> DataFrame:
    """How many rows each rule drops, by kind."""
    _, dropped = selection.judged(events, [(F.col("value") < 5, "too low"), (F.col("value") > 60, "too high"), (F.col("user_id") % 10 == 0, "no place")])
    return dropped.groupBy("event_type", "reason").agg(F.count("*").alias("n"))


@query(
    """with v as (select l_orderkey as k, l_returnflag as u, max(l_quantity) as b, max(l_quantity) - max(l_discount) * 100 as a from lineitem group by all),
    w as (select k, max(b) filter (where u = 'A') ab, max(b) filter (where u = 'N') nb, max(b) filter (where u = 'R') rb, max(a) filter (where u = 'A') aa, max(a) filter (where u = 'N') na, max(a) filter (where u = 'R') ra from v group by 1),
    p as (select 'A' as younger, 'N' as older, nb - ab as b, na - aa as a from w union all select 'N', 'R', rb - nb, ra - na from w)
    select younger, older, count(*) as nodes, count(*) filter (where b > 1e-6) as crossed_before, count(*) filter (where a > 1e-6) as crossed_after, greatest(max(b) filter (where b > 1e-6), 0) as worst_before, round(greatest(max(a) filter (where a > 1e-6), 0), 6) as worst_after from p where a is not null and b is not null group by all""",
    "lineitem",
)
def surface_crossings(lineitem: DataFrame) -> DataFrame:
    """Where ordered surfaces cross before and after an adjustment. Orders stand for places, flags for units."""
    rows = lineitem.groupBy(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("u")).agg(F.max("l_quantity").alias("b"), (F.max("l_quantity") - F.max("l_discount") * 100).alias("a"))
    return selection.crossings(rows, ["k"], "u", [("A", "N"), ("N", "R")], "b", "a").withColumn("worst_after", F.round("worst_after", 6))


UNITS = [
    ("Cooper Marl", "cooper", "marl"),
    ("Goose Creek Limestone (part)", "goose creek", "limestone"),
    ("Black Mingo Gp., Williamsburg Fm.", "williamsburg", "formation"),
    ("Undivided beach sand", None, None),
    ("Gneissic granite of Starr", None, None),
    ("Upper Duplin Formation member", "duplin", "member"),
    ("Peedee/Black Creek Formation", "peedee", "formation"),
    ("alluvium", None, None),
    (None, None, None),
]
TITLES = [
    ("Water quality of the Piedmont", "water quality"),
    ("Streamflow in 1980", "streamflow"),
    ("Geology and water quality of Aiken", None),
    ("Geology of Aiken", None),
    ("Ground-water in the Coastal Plain, Cretaceous", None),
    (None, None),
]


@query(f"select p_partkey, {_answers(UNITS, 1)} as name, {_answers(UNITS, 2)} as rank, {_answers(TITLES, 1)} as subject from part", "part")
def unit_names(part: DataFrame) -> DataFrame:
    """Places and ranks in names of units, and subjects of titles outside the field."""
    subject = names.other_subject(_case(TITLES, 0), "water quality|streamflow", "geolog\\w*|piedmont|coastal plain|cretaceous", "piedmont|coastal plain|cretaceous")
    return part.select("p_partkey", names.name_key(_case(UNITS, 0)).alias("k"), subject.alias("subject")).select("p_partkey", "k.*", "subject")


@query(
    """with f as (select l_orderkey, arg_max(l_linenumber, struct_pack(q := l_quantity, n := -l_linenumber, p := -l_partkey, s := -l_suppkey)) as top, count(*) as n from lineitem group by 1)
    select o_orderkey, top, coalesce(n, 0)::bigint as hits, coalesce(n, 0) > 3 as truncated from orders left join f on o_orderkey = l_orderkey""",
    "orders",
    "lineitem",
)
def topmost_feature(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """The feature of highest rank at each place, and whether more were found than a cap of pages holds."""
    order = [F.col("l_quantity"), -F.col("l_linenumber"), -F.col("l_partkey"), -F.col("l_suppkey")]
    top = windows.latest_by(lineitem.select("l_orderkey", "l_quantity", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey"], order)
    found = lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    hits = F.coalesce("n", F.lit(0)).cast("long")
    return orders.join(top, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(found, F.col("o_orderkey") == F.col("k"), "left").select("o_orderkey", F.col("l_linenumber").alias("top"), hits.alias("hits"), (hits > 3).alias("truncated"))


@query(
    """with a as (select l_orderkey, string_agg(l_partkey::varchar, ',' order by l_discount desc, l_partkey, l_linenumber, l_suppkey) as others from (select *, row_number() over (partition by l_orderkey order by l_discount desc, l_partkey, l_linenumber, l_suppkey) as k from lineitem where l_tax < 0.05) where k <= 3 group by 1)
    select o_orderkey, c_name as source, n_name as county, coalesce(others, '') as others, case when n_regionkey = 0 then null else c_mktsegment end as layer from orders join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join a on o_orderkey = l_orderkey""",
    "orders",
    "customer",
    "nation",
    "lineitem",
)
def feature_cards(orders: DataFrame, customer: DataFrame, nation: DataFrame, lineitem: DataFrame) -> DataFrame:
    """A card for each feature: its source, place, and three best alternatives. Alternatives are cut to three a key before
    they are gathered; Catalyst broadcasts the small sides."""
    order = [F.col("l_discount").desc(), F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey")]
    first = windows.top(lineitem.where("l_tax < 0.05").select("l_orderkey", "l_discount", "l_partkey", "l_linenumber", "l_suppkey"), ["l_orderkey"], order, 3)
    best = first.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("place", "l_partkey"))).alias("b"))
    others = F.array_join(F.transform("b", lambda x: x["l_partkey"].cast("string")), ",")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(best, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", F.col("c_name").alias("source"), F.col("n_name").alias("county"), F.coalesce(others, F.lit("")).alias("others"), F.when(F.col("n_regionkey") == 0, None).otherwise(F.col("c_mktsegment")).alias("layer"))


@query(
    """select p_partkey, case when p_partkey % 3 = 0 then p_brand end as brand, case when p_partkey % 3 <> 1 then p_size end as size, (p_partkey % 3 = 0)::int + (p_partkey % 3 <> 1)::int as kept from part""",
    "part",
)
def cells_in_quotes(part: DataFrame) -> DataFrame:
    """Cells of a table's row that its quote holds; the others become null."""
    quote = F.concat(F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise("x"), F.lit(" | "), F.when(F.col("p_partkey") % 3 != 1, F.col("p_size").cast("string")).otherwise("none"))
    held = lambda c: F.when(F.contains(quote, F.col(c).cast("string")), F.col(c))
    return part.select("p_partkey", held("p_brand").alias("brand"), held("p_size").alias("size")).withColumn("kept", F.col("brand").isNotNull().cast("int") + F.col("size").isNotNull().cast("int"))


@query(
    """with p as (select vec_id, embedding[1]::double as x, embedding[2]::double as y from embeddings)
    select a.vec_id, round((a.x + b.x) / 2, 6) as mid_x, round((a.y + b.y) / 2, 6) as mid_y from p a left join p b on b.vec_id = a.vec_id + 1""",
    "embeddings",
)
def section_midpoints(embeddings: DataFrame) -> DataFrame:
    """Midpoints of sections between two ends; null without a second one."""
    p = points(embeddings).select("vec_id", "x", "y")
    end = p.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("u"), F.col("y").alias("v"))
    return p.join(end, "vec_id", "left").select("vec_id", F.round((F.col("x") + F.col("u")) / 2, 6).alias("mid_x"), F.round((F.col("y") + F.col("v")) / 2, 6).alias("mid_y"))


@query(
    """with p as (select p_partkey, p_partkey % 6 as k, 32 + p_size % 3 as d, p_size as m, p_partkey % 60 as s, 79 + p_size % 4 as e from part),
    r as (select *, case k when 0 then d + m / 60.0::double + s / 3600.0::double when 1 then d + m / 60.0::double + s / 3600.0::double when 2 then d + m / 100.0::double when 3 then d + m / 60.0::double end as lat, case k when 0 then -(e + s / 60.0::double + m / 3600.0::double) when 1 then -(e + s / 60.0::double + m / 3600.0::double) when 2 then -(e + s / 100.0::double) when 3 then -(e + s / 60.0::double) end as lon from p)
    select p_partkey, case when lat between 31.5 and 35.6 then round(lat, 8) end as lat, case when lat between 31.5 and 35.6 then round(lon, 8) end as lon, case when lat between 31.5 and 35.6 then case k when 2 then 'decimal' when 1 then 'packed_dms' else 'dms' end end as format from r""",
    "part",
)
def parse_places(part: DataFrame) -> DataFrame:
    """Places printed in degrees, minutes and seconds, as packed digits, as decimals; and texts without one."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    d, m, s, e = F.col("p_size") % 3 + 32, F.col("p_size"), F.col("p_partkey") % 60, F.col("p_size") % 4 + 79
    forms = [
        F.concat(F.lit("lat "), d, F.lit("°"), m, F.lit("'"), s, F.lit('" N., long '), e, F.lit("°"), s, F.lit("'"), m, F.lit('" W.')),
        F.concat(F.lit("Lat "), d, two(m), two(s), F.lit(" Long 0"), e, two(s), two(m)),
        F.concat(F.lit("-"), e, F.lit("."), two(s), F.lit(", "), d, F.lit("."), two(m), F.lit(" (NAD 83)")),
        F.concat(F.lit("N"), d, F.lit("°"), m, F.lit("' W"), e, F.lit("°"), s, F.lit("'")),
        F.concat(d, two(m), two(s), F.lit(" "), e, two(s), two(m)),
        F.concat(F.lit("lat "), d, F.lit("°"), m, F.lit("', "), s, F.lit(" ft deep")),
    ]
    text = F.element_at(F.array(*forms), (F.col("p_partkey") % 6 + 1).cast("int"))
    read = part.select("p_partkey", coordinates.place(text).alias("p"))
    return read.select("p_partkey", F.round("p.lat", 8).alias("lat"), F.round("p.lon", 8).alias("lon"), "p.format")


@query(
    """with u as (select p_type, arg_min(p_name, p_partkey) as ref from part group by 1)
    select p_partkey, case when p_size % 4 > 0 then part.p_type end as link, u.ref as reference from part left join u on u.p_type = case when p_size % 4 > 0 then part.p_type end""",
    "part",
)
def unit_references(part: DataFrame) -> DataFrame:
    """The first reference of each unit, joined to the polygons that link to it."""
    first = windows.first_by(part.select("p_type", "p_name", "p_partkey"), ["p_type"], [F.col("p_partkey")]).select(F.col("p_type").alias("link"), F.col("p_name").alias("reference"))
    return part.select("p_partkey", F.when(F.col("p_size") % 4 > 0, F.col("p_type")).alias("link")).join(first, "link", "left").select("p_partkey", "link", "reference")


@query(
    """select event_id, user_id, coalesce(c_name, 'station ' || user_id) as station, c_mktsegment as kind from events left join (select * from customer where c_acctbal > 0) on user_id = c_custkey""",
    "events",
    "customer",
)
def station_readings(events: DataFrame, customer: DataFrame) -> DataFrame:
    """Readings with what is known of their station; a station without an entry is named by its number."""
    known = customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), "c_name", F.col("c_mktsegment").alias("kind"))
    return events.join(known, "user_id", "left").select("event_id", "user_id", F.coalesce("c_name", F.concat(F.lit("station "), F.col("user_id"))).alias("station"), "kind")


@query(
    """select o_orderkey, case when o_orderstatus = 'F' then null when o_orderkey % 3 = 0 then o_totalprice else o_totalprice * 2 end as confidence from orders""",
    "orders",
)
def confidence_restored(orders: DataFrame) -> DataFrame:
    """Values put back to what they were before agreement was counted in."""
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    history = F.when(key % 3 == 0, F.struct(price.alias("confidence_before")))
    value = F.when(F.col("o_orderstatus") != "F", F.struct((price * 2).alias("confidence"), history.alias("agreement")))
    return orders.select("o_orderkey", nested.restored(value, "agreement", "confidence", "confidence_before").alias("v")).select("o_orderkey", "v.confidence")


@query(
    """select event_id, coalesce(case when event_id % 11 = 0 then event_id % 2 = 0 end, event_type in ('error', 'purchase') or props like '%"k": 9%') as images from events""",
    "events",
)
def images_wanted(events: DataFrame) -> DataFrame:
    """Whether an item needs images: as it says itself, else by its reason or the words of its detail."""
    said = F.when(F.col("event_id") % 11 == 0, F.col("event_id") % 2 == 0)
    rule = F.col("event_type").isin("error", "purchase") | F.coalesce(F.col("props").rlike('"k": 9'), F.lit(False))
    return events.select("event_id", F.coalesce(said, rule).alias("images"))
