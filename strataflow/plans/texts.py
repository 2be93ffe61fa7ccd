"""Queries of text parsers, ages, classes and quotes. Texts are printed from the tables' numbers, so that SQL knows what
must be read without parsing anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.functions import ages, parsing, quotes, terms
from strataflow.registry import query

def _printed(part: DataFrame, *forms: Column) -> DataFrame:
    """p_partkey, n (p_size) and text, one of the forms by p_partkey."""
    text = F.element_at(F.array(*forms), (F.col("p_partkey") % len(forms) + 1).cast("int"))
    return part.select("p_partkey", F.col("p_size").alias("n"), text.alias("text"))


def _join(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _size() -> Column:
    return F.col("p_size").cast("string")


@query(
    """select p_partkey, round((case p_partkey % 7 when 0 then n when 1 then n + 0.5 when 2 then n / 0.3048 when 4 then n / 12.0 when 5 then n * 1000 end)::double, 6) as low,
      round((case p_partkey % 7 when 0 then n + 5 when 1 then n + 0.5 when 2 then n / 0.3048 when 3 then n when 5 then n * 1000 + 700 end)::double, 6) as high,
      case p_partkey % 7 when 2 then true when 6 then null else false end as approximate
    from (select p_partkey, p_size::double as n from part)""",
    "part",
)
def parse_lengths(part: DataFrame) -> DataFrame:
    """Lengths in feet: ranges, feet and inches, other units, bounds, spans, and none."""
    s = _size()
    more = (F.col("p_size") + 5).cast("string")
    forms = [_join(s, " to ", more, " ft"), _join(s, "' 6\""), _join("about ", s, " m"), _join("up to ", s, " feet"), _join("more than ", s, " in."), _join(s, ",000 ft here; maximum ", s, ",700 ft"), F.lit("none seen")]
    rows = _printed(part, *forms).select("p_partkey", parsing.length_ft(F.col("text")).alias("v"))
    return rows.select("p_partkey", F.round("v.min_ft", 6).alias("low"), F.round("v.max_ft", 6).alias("high"), F.col("v.approximate").alias("approximate"))


@query(
    """select p_partkey, (case p_partkey % 6 when 0 then -n when 1 then -n when 3 then n when 5 then -n - 5 end)::double as low,
      (case p_partkey % 6 when 0 then -n when 1 then -n when 2 then -n when 3 then n when 5 then -n end)::double as high,
      case p_partkey % 6 when 1 then 'MSL' when 2 then 'MSL' when 3 then 'NGVD29' when 4 then 'land surface' when 5 then 'NAVD88' end as datum
    from (select p_partkey, p_size as n from part)""",
    "part",
)
def parse_elevations(part: DataFrame) -> DataFrame:
    """Signed elevations and their datums; depths are none."""
    s = _size()
    more = (F.col("p_size") + 5).cast("string")
    forms = [_join("-", s, " ft"), _join(s, " ft below sea level"), _join("more than ", s, " ft below sea level"), _join(s, " ft NGVD 29"), _join(s, " ft below land surface"), _join("-", s, " to -", more, " feet NAVD of 1988")]
    rows = _printed(part, *forms).select("p_partkey", parsing.elevation_ft(F.col("text")).alias("v"), parsing.vertical_datum(F.col("text")).alias("datum"))
    return rows.select("p_partkey", F.col("v.min_ft").alias("low"), F.col("v.max_ft").alias("high"), "datum")


@query(
    """select p_partkey, (case p_partkey % 7 when 0 then n / 10.0 when 1 then n * 1000 + 0.5 when 4 then n / 1000.0 when 5 then -n end)::double as number,
      (case when p_partkey % 7 = 2 then n / 100.0 end)::double as low, (case when p_partkey % 7 = 2 then n / 100.0 + 1 end)::double as high,
      case p_partkey % 7 when 0 then '<' when 1 then '>' when 3 then 'ND' end as qualifier, p_partkey % 7 in (0, 2, 6) as units
    from (select p_partkey, p_size as n from part)""",
    "part",
)
def parse_values(part: DataFrame) -> DataFrame:
    """Printed laboratory values: bounds, thousands, ranges, not detected, powers of ten, signs, unreadable ones."""
    n = F.col("p_size")
    tens = F.format_string("%d.%d", F.floor(n / 10), n % 10)
    hundredths = lambda more: F.format_string("%d.%02d", F.floor(n / 100) + more, n % 100)
    forms = [_join("<", tens, " mg/L"), _join("> ", n.cast("string"), ",000.5"), _join(hundredths(0), " to ", hundredths(1)), F.lit(" N.D. "), _join(n.cast("string"), ".0 x 10^-3"), _join("-", n.cast("string")), _join("about ", n.cast("string"), "%")]
    rows = _printed(part, *forms).select("p_partkey", parsing.printed_value(F.col("text")).alias("v"), parsing.has_units(F.col("text")).alias("units"))
    return rows.select("p_partkey", F.round("v.number", 9).alias("number"), F.round("v.min", 9).alias("low"), F.round("v.max", 9).alias("high"), F.col("v.qualifier").alias("qualifier"), "units")


@query(
    """select o_orderkey, case when o_orderkey % 4 = 3 then strftime(o_orderdate, '%Y-%m') else strftime(o_orderdate, '%Y-%m-%d') end as day from orders""",
    "orders",
)
def parse_dates(orders: DataFrame) -> DataFrame:
    """Dates as printed in four ways."""
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.when(F.year(day) < 2000, F.date_format(day, "M/d/yy")).otherwise(F.date_format(day, "M/d/yyyy"))).when(k == 2, F.date_format(day, "MMMM d, yyyy")).otherwise(F.date_format(day, "'in' MMM. yyyy"))
    return orders.select("o_orderkey", parsing.date_text(text).alias("day"))


@query(
    """select p_partkey, case when p_partkey % 5 = 0 then '10YR ' || n % 9 || '/' || n % 7 when p_partkey % 5 = 1 then 'N ' || n % 9 || '/' end as colour,
      case p_partkey % 5 when 2 then 'SP,SM' when 3 then 'CL' else '' end as soils,
      case p_partkey % 5 when 2 then n + n + 1 when 3 then 50 when 4 then 0 end::bigint as blows, case p_partkey % 5 when 3 then true when 2 then false when 4 then false end as refusal
    from (select p_partkey, p_size as n from part)""",
    "part",
)
def parse_soils(part: DataFrame) -> DataFrame:
    """Soil colours, classes and blow counts."""
    n, s = F.col("p_size"), _size()
    digits = lambda k: (n % k).cast("string")
    colour = F.when(F.col("p_partkey") % 5 == 0, _join("brown 10yr ", digits(9), "/", digits(7))).when(F.col("p_partkey") % 5 == 1, _join("N", digits(9), "/ gray"))
    log = F.when(F.col("p_partkey") % 5 == 2, _join("SP-SM sand")).when(F.col("p_partkey") % 5 == 3, "lean clay (CL) XX")
    blows = F.when(F.col("p_partkey") % 5 == 2, _join("3-", s, "-", (n + 1).cast("string"))).when(F.col("p_partkey") % 5 == 3, '50/4"').when(F.col("p_partkey") % 5 == 4, "WOH")
    rows = part.select("p_partkey", parsing.munsell(colour).alias("m"), parsing.soil_classes(log).alias("c"), parsing.spt_n(blows).alias("b"))
    return rows.select("p_partkey", F.col("m.notation").alias("colour"), F.array_join("c", ",").alias("soils"), F.col("b.n").cast("long").alias("blows"), F.col("b.refusal").alias("refusal"))


@query(
    """select p_partkey, (case p_partkey % 5 when 0 then n when 1 then (360 - n) % 360 when 2 then 180 - n when 3 then 180 + n else n + 100 end)::double as strike,
      (case when p_partkey % 5 = 4 then n else 45 end)::double as dip, case when p_partkey % 5 < 4 then 'SE' end as direction, p_partkey % 5 = 4 as inferred
    from (select p_partkey, p_size as n from part)""",
    "part",
)
def parse_orientations(part: DataFrame) -> DataFrame:
    """Strikes from quadrants and azimuths, with dips."""
    s = _size()
    quadrant = lambda a, b: _join(f"{a} ", s, f"° {b}, 45 SE")
    forms = [quadrant("N", "E"), quadrant("N", "W"), quadrant("S", "E"), quadrant("S", "W"), _join((F.col("p_size") + 100).cast("string"), "/", s)]
    rows = _printed(part, *forms).select("p_partkey", parsing.strike_dip(F.col("text")).alias("v"))
    return rows.select("p_partkey", "v.strike", "v.dip", F.col("v.dip_direction").alias("direction"), F.col("v.convention_inferred").alias("inferred"))


@query(
    """select conv_id, string_agg(turn::varchar, ',' order by turn) as pages, count(*) as n from (select distinct conv_id, turn from conversations) group by 1""",
    "conversations",
)
def page_lists(conversations: DataFrame) -> DataFrame:
    """Page numbers to the text of their runs and back."""
    numbers = conversations.groupBy("conv_id").agg(F.collect_set(F.col("turn").cast("int")).alias("p"))
    back = parsing.pages(parsing.page_text(F.col("p")))
    return numbers.select("conv_id", F.transform(back, lambda x: x.cast("string")).alias("b")).select("conv_id", F.array_join("b", ",").alias("pages"), F.size("b").cast("long").alias("n"))


@query(
    """select least(c_custkey, s_suppkey) as number, c_custkey, s_suppkey, 'area:CUS-' || c_custkey as key from customer join supplier on c_custkey = s_suppkey""",
    "customer",
    "supplier",
)
def shared_identifiers(customer: DataFrame, supplier: DataFrame) -> DataFrame:
    """Labels in two spellings linked by their normal form: exploded keys, one equality join."""
    prefixes = F.array(F.lit("CUS"), F.lit("ROW"))
    keys = lambda label: parsing.shared_keys(label, F.lit(None).cast("string"), prefixes)
    left = customer.select("c_custkey", F.explode(keys(_join("Cus ", F.regexp_extract("c_name", r"#(\d+)", 1)))).alias("key"))
    right = supplier.select("s_suppkey", F.explode(keys(_join("CUS-", F.col("s_suppkey").cast("string")))).alias("key"))
    return left.join(right, "key").select(F.least("c_custkey", "s_suppkey").alias("number"), "c_custkey", "s_suppkey", "key")


RULES = [("widget|gear", "machine"), ("ring|bolt", "small"), ("cold|hot", "thermal"), ("anvil", "machine")]


@query(
    """with r as (select p_partkey, p_name, list_distinct(list_filter([case when regexp_matches(p_name, 'widget|gear') then 'machine' end, case when regexp_matches(p_name, 'ring|bolt') then 'small' end, case when regexp_matches(p_name, 'cold|hot') then 'thermal' end, case when regexp_matches(p_name, 'anvil') then 'machine' end], lambda x: x is not null)) as c from part)
    select p_partkey, case when len(c) = 1 then c[1] end as only_class, case when regexp_matches(p_name, 'widget|gear') then 'machine' when regexp_matches(p_name, 'ring|bolt') then 'small' when regexp_matches(p_name, 'cold|hot') then 'thermal' when regexp_matches(p_name, 'anvil') then 'machine' end as first_class from r""",
    "part",
)
def classify_unique(part: DataFrame) -> DataFrame:
    """Classes by rules: the only one that matching rules name, and the first one."""
    return part.select("p_partkey", parsing.only_class(F.col("p_name"), RULES).alias("only_class"), parsing.first_rule(F.col("p_name"), RULES).alias("first_class"))


AGE_TEXTS = ("Holocene", "early Miocene", "Phanerozoic - Cenozoic - Quaternary - Pleistocene", "Tertiary / Miocene, early", "Pliocene, late / Pleistocene, early", "Late Paleozoic", "early Tertiary (early Oligocene)", "Cretaceous and Jurassic", "of no age")


@query(
    """with t(i, ay, ao, fy, fo, class) as (values (0, 0.0, 0.0117, 0.0, 0.0117, 'holocene'), (1, 15.98, 23.03, 15.98, 23.03, 'miocene'), (2, 0.0117, 2.58, 0.0117, 2.58, 'pleistocene'), (3, 2.58, 66.0, 15.98, 23.03, 'miocene'),
      (4, 0.0117, 5.333, 0.774, 3.6, 'pleistocene'), (5, 251.902, 347.534667, 251.902, 347.534667, 'carboniferous'), (6, 27.82, 33.9, 27.82, 33.9, 'oligocene'), (7, 66.0, 201.4, 66.0, 201.4, 'cretaceous'), (8, null, null, null, null, 'unknown'))
    select p_partkey, ay::double as young, ao::double as old, fy::double as finest_young, fo::double as finest_old, class from part join t on p_partkey % 9 = i""",
    "part",
)
def finest_intervals(part: DataFrame) -> DataFrame:
    """Ages named in texts: their union, the finest ones, and the class."""
    rows = _printed(part, *map(F.lit, AGE_TEXTS)).select("p_partkey", ages.age_range(F.col("text")).alias("a"), ages.finest_age_range(F.col("text")).alias("f"))
    rows = rows.withColumn("class", ages.age_class(F.col("f")))
    six = lambda c: F.round(c, 6)
    return rows.select("p_partkey", six("a.young").alias("young"), six("a.old").alias("old"), six("f.young").alias("finest_young"), six("f.old").alias("finest_old"), "class")


@query(
    """with c(class, young, old) as (values ('low', 0.0, 12.0), ('mid', 12.0, 30.0), ('high', 30.0, 60.0)), p as (select p_partkey, p_size::double as young, p_size + p_partkey % 9 + 1.0 as old from part),
    j as (select p_partkey, class, least(p.old, c.old) - greatest(p.young, c.young) as o, c.young as cy, (least(p.old, c.old) - greatest(p.young, c.young)) / (p.old - p.young) as share from p, c where least(p.old, c.old) > greatest(p.young, c.young))
    select p_partkey, class, round(share, 6) as share from (select *, row_number() over (partition by p_partkey order by o desc, cy) as n from j) where n = 1""",
    "part",
)
def interval_class(part: DataFrame) -> DataFrame:
    """The class of a table with the largest overlap, by a range join, and the share that it holds."""
    rows = part.select("p_partkey", F.struct(F.col("p_size").cast("double").alias("young"), (F.col("p_size") + F.col("p_partkey") % 9 + 1.0).alias("old")).alias("age"))
    classes = part.sparkSession.createDataFrame([("low", 0.0, 12.0), ("mid", 12.0, 30.0), ("high", 30.0, 60.0)], "class string, young double, old double")
    found = ages.with_class(rows, "age", classes).join(F.broadcast(classes.select("class", F.struct("young", "old").alias("c"))), "class")
    held = (F.least("age.old", "c.old") - F.greatest("age.young", "c.young")) / (F.col("age.old") - F.col("age.young"))
    return found.select("p_partkey", "class", F.round(held, 6).alias("share"))


@query(
    """with g as (select conv_id, turn, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as body from conversations where text is not null), q as (select conv_id, turn, turn + turn % 3 - 1 as claimed, trim(body[6:45]) as quote from g),
    j as (select q.conv_id, q.turn, g.turn as page, claimed, contains(body, quote) and regexp_matches(body, (case when regexp_matches(quote, '^[\\pL\\pN]') then '(^|[^a-z0-9])' else '' end) || regexp_escape(quote) || (case when regexp_matches(quote, '[\\pL\\pN]$') then '([^a-z0-9]|$)' else '' end)) as hit
      from q join g on q.conv_id = g.conv_id and abs(g.turn - claimed) <= 1 where quote <> '')
    select conv_id, turn, arg_min(page, struct_pack(a := case when page = claimed then 0 when page < claimed then 1 else 2 end)) as page, 'exact' as tier from j where hit group by conv_id, turn""",
    "conversations",
)
def quote_match(conversations: DataFrame) -> DataFrame:
    """Quotes on the page they name or one beside it, whole words only, by the best tier of likeness."""
    pages = conversations.select("conv_id", F.col("turn").alias("page"), "text")
    plain = quotes.normalised(F.col("text"))
    asked = conversations.where("text is not null").select("conv_id", "turn", (F.col("turn") + F.col("turn") % 3 - 1).alias("claimed"), F.trim(F.substring(plain, 6, 40)).alias("quote")).where("quote <> ''")
    return quotes.on_pages(asked, pages, ["conv_id", "turn"], "conv_id").where("tier = 'exact' and not loose").select("conv_id", "turn", "page", "tier")


@query(
    """with h as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as link from pages), c as (select page_id, case when regexp_matches(lower(link), '\\.pdf$') then 'document' when regexp_matches(lower(link), '^https?://') then 'site' when link like '/%' then 'page' when link like '#%' then 'place' else 'other' end as class from h)
    select p.page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, count(class)::bigint as links, count(*) filter (where class = 'site')::bigint as sites, count(*) filter (where class = 'page')::bigint as inner_links
    from pages p left join c using (page_id) group by all""",
    "pages",
)
def product_page_links(pages: DataFrame) -> DataFrame:
    """Titles and links of pages with counts by class, by expressions alone."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    of = lambda rule: F.size(F.filter(links, rule)).cast("long")
    low = lambda x: F.lower(x)
    return pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(links).cast("long").alias("links"), of(lambda x: low(x).rlike("^https?://") & ~low(x).rlike(r"\.pdf$")).alias("sites"), of(lambda x: x.startswith("/") & ~low(x).rlike(r"\.pdf$")).alias("inner_links"))


@query(
    """with u as (select p_partkey, case when p_size > 10 then p_name end as name, p_size % 20 as y, p_size % 20 + 5 as o, p_brand, case when p_size % 7 > 2 then p_name end as other, p_size % 11 as oy, p_size % 11 + 4 as oo from part)
    select p_partkey, (case when name is not null and other is not null then case when name = other then 1.0 else 0.0 end when least(o, oo) - greatest(y, oy) <= 0 then 0.0 when name is null and other is null then 0.5 else 0.25 end)::double as agreement from u""",
    "part",
)
def unit_agreement(part: DataFrame) -> DataFrame:
    """How two descriptions agree: by name, else by ages that overlap."""
    n = F.col("p_size")
    age = lambda low, width: F.struct(low.cast("double").alias("young"), (low + width).cast("double").alias("old"))
    return part.select("p_partkey", quotes.agreement(F.when(n > 10, F.col("p_name")), F.when(n % 7 > 2, F.col("p_name")), ages.overlap(age(n % 20, 5), age(n % 11, 4))).alias("agreement"))


@query(
    """with t as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{8,}')) as term from benchmark), d as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN]+')) as w from documents),
    f as (select doc_id, count(*) as n, min(w) as first from d semi join t on w = term group by 1)
    select doc_id, coalesce(n, 0)::bigint as n, first from documents left join f using (doc_id)""",
    "documents",
    "benchmark",
)
def term_counts(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """How often terms of a table stand in whole texts, and the first of them by the table's order."""
    listed = benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{8,})"), F.lit(1))).alias("term")).distinct()
    table = listed.select("term", F.col("term").alias("name"), F.lit(0).alias("place"))
    found = terms.found(documents.select("doc_id", "text"), "text", table, "found")
    return found.select("doc_id", F.coalesce(F.size(terms.longest(F.col("found"))), F.lit(0)).cast("long").alias("n"), terms.first_name(F.col("found")).alias("first")).withColumn("n", F.greatest("n", F.lit(0).cast("long")))
