"""Queries of classes, reasons and display texts. Inputs are made from the tables' numbers, so that SQL knows the answers
without the rules: each key takes the case that its number names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataflow.functions import labels
from strataflow.registry import query


def _case(cases: list[tuple], place: int, key: str = "p_partkey") -> Column:
    """The value at a place of the case that a key names."""
    return F.element_at(F.array(*(F.lit(c[place]) for c in cases)), (F.col(key) % len(cases) + 1).cast("int"))


def _answers(cases: list[tuple], place: int, key: str = "p_partkey") -> str:
    """The same in SQL."""
    said = lambda v: "null" if v is None else str(v).lower() if isinstance(v, (bool, int, float)) else "'" + v.replace("'", "''") + "'"
    return f"case {key} % {len(cases)} " + " ".join(f"when {i} then {said(c[place])}" for i, c in enumerate(cases)) + " end"


SYMBOLS = [("Qal", "Quaternary"), ("QH2", "Holocene"), ("TQu", "Tertiary to Quaternary"), ("Tb", "Tertiary"), ("L UKs", "Cretaceous"), ("CZg", "Cambrian to Neoproterozoic"), ("Cm", "Cambrian"), ("xQ", None), ("Q", "Quaternary"), (None, None)]
CHAINS = [
    ("Phanerozoic - Cenozoic - Quaternary - Pleistocene", "Phanerozoic - Cenozoic - Tertiary-Neogene", "Quaternary", "Pleistocene to Tertiary-Neogene"),
    ("Phanerozoic - Paleozoic", "Phanerozoic - Paleozoic", "Paleozoic", "Paleozoic"),
    ("Proterozoic - Neoproterozoic", None, "Neoproterozoic", "Neoproterozoic"),
    (None, "preCambrian", "Unknown", "preCambrian"),
    ("Elsewhere", " - ", "Unknown", "Elsewhere"),
    (None, None, "Unknown", "Unknown"),
]
ROCKS = [("Igneous, intrusive", "Igneous"), ("Water", "Water"), (", none", "Unknown"), ("", "Unknown"), (None, "Unknown")]
LINES = [
    ("Fault, unknown type, approximate", None, "fault", "approximate", False),
    ("Thrust fault", "Fault, certain", "thrust fault", "certain", False),
    ("Line of something", "Syncline, inferred, queried", "fold", "inferred", True),
    ("Dike?", "Contact, concealed", "dike", "concealed", True),
    (None, None, "other", "certain", False),
]


@query(f"select p_partkey, {_answers(SYMBOLS, 0)} as symbol, {_answers(SYMBOLS, 1)} as age from part", "part")
def symbol_ages(part: DataFrame) -> DataFrame:
    """Ages implied by the letters of map symbols."""
    return part.select("p_partkey", _case(SYMBOLS, 0).alias("symbol")).withColumn("age", labels.symbol_age(F.col("symbol")))


@query(f"select p_partkey, {_answers(CHAINS, 2)} as class, {_answers(CHAINS, 3)} as shown, {_answers(ROCKS, 1)} as rock from part", "part")
def hierarchy_classes(part: DataFrame) -> DataFrame:
    """Classes of chains of ages, their ranges as text, and classes of rocks."""
    young, old = _case(CHAINS, 0), _case(CHAINS, 1)
    return part.select("p_partkey", labels.hierarchy_class(young).alias("class"), labels.age_text(young, old, "Unknown").alias("shown"), labels.rock_class(_case(ROCKS, 0)).alias("rock"))


@query(f"select p_partkey, {_answers(LINES, 2)} as kind, {_answers(LINES, 3)} as certainty, {_answers(LINES, 4)} as queried from part", "part")
def line_classes(part: DataFrame) -> DataFrame:
    """Kind, certainty and question marks of structure lines."""
    return part.select("p_partkey", labels.line_class(_case(LINES, 0), _case(LINES, 1)).alias("l")).select("p_partkey", "l.*")


STREETS = [
    ("RIVERS AV", "M", "S1400", "local", None, "Rivers Ave", 2),
    ("I- 26", "I", "S1100", "interstate", "I-26", None, 7),
    ("US Hwy 52 Spr", "U", "S1200", "us", "US 52 Spur", None, 6),
    ("State Hwy 061 Byp.", "S", "S1200", "sc", "SC 61 Byp", None, 5),
    ("MCELVEEN  ST NW", "", "S1630", "ramp", None, "Mcelveen St NW".replace("Mce", "McE"), 4),
    ("1ST ST-JR", None, "S1740", "private", None, "1st St-Jr", 1),
    ("Old Way", "C", "S1400", "secondary", None, "Old Way", 3),
    ("unnamed", None, None, "local", None, None, 2),
    (None, None, None, "local", None, None, 2),
]
TIERS = [("interstate", 0, 13), ("highway", 8, 13), ("local", 13, 24)]


@query(f"select p_partkey, {_answers(STREETS, 3)} as class, {_answers(STREETS, 4)} as ref, {_answers(STREETS, 5)} as name, {_answers(STREETS, 6)} as rank from part", "part")
def road_labels(part: DataFrame) -> DataFrame:
    """Class, route number and written name of roads."""
    return part.select("p_partkey", labels.road(*(_case(STREETS, i) for i in range(3))).alias("r")).select("p_partkey", "r.*")


@query("select p_partkey, concat_ws(',', case when z < 13 then 'interstate' end, case when z >= 8 and z < 13 then 'highway' end, case when z >= 13 and z < 24 then 'local' end) as tiers from (select p_partkey, p_size % 26 as z from part)", "part")
def tiers_shown(part: DataFrame) -> DataFrame:
    """Which tiers of roads a zoom level shows."""
    return part.select("p_partkey", F.array_join(labels.zoom_tiers(F.col("p_size") % 26, TIERS), ",").alias("tiers"))


SERVICES = [
    ("public", "https://a.example/1", True, "PIN", True, None),
    ("no public service", "https://a.example/1", True, "PIN", False, "no public parcel service"),
    ("public", None, True, "PIN", False, "no public parcel service"),
    ("blocked", "https://a.example/1", True, "PIN", False, "service is blocked"),
    ("public", "https://a.example/1", False, "PIN", False, "service blocks browser access (CORS)"),
    ("public", "https://a.example/1", None, None, False, "no parcel ID field known"),
]
LINKS = [
    (None, "https://a.example/?p={id}", "R 7/2", "https://a.example/?p=R%207%2F2", True),
    ("https://b.example/x", "https://a.example/?p={id}", "R7", "https://b.example/x", True),
    ("ftp://b.example/x", "https://a.example/find", "R7", "https://a.example/find", False),
    (None, "https://a.example/?p={id}", None, None, False),
    (None, None, "R7", None, False),
]


@query(
    f"""select s_suppkey, case when n_regionkey = 0 then false else {_answers(SERVICES, 4, 's_suppkey')} end as usable, case when n_regionkey = 0 then 'not in the parcel registry' else {_answers(SERVICES, 5, 's_suppkey')} end as reason,
    {_answers(LINKS, 3, 's_suppkey')} as url, {_answers(LINKS, 4, 's_suppkey')} as deep from supplier join nation on s_nationkey = n_nationkey""",
    "supplier",
    "nation",
)
def parcel_services(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Whether a service can be asked, why not, and the link to a record. Nations of region 0 are in no registry."""
    known = nation.where("n_regionkey <> 0").select(F.col("n_nationkey").alias("s_nationkey"), F.lit(True).alias("known"))
    case = lambda cases, i: _case(cases, i, "s_suppkey")
    plan = labels.service_plan(F.col("known"), *(case(SERVICES, i) for i in range(4)))
    link = labels.record_link(*(case(LINKS, i) for i in range(3)))
    return supplier.join(known, "s_nationkey", "left").select("s_suppkey", plan.alias("p"), link.alias("l")).select("s_suppkey", "p.*", "l.*")


CODES = [("Ice", "Ice affected"), ("e", "Estimated"), ("<", "Less than value shown"), ("zz", "zz"), ("Rat", "Rating being developed")]


@query(f"select event_id, {_answers(CODES, 1, 'event_id')} || '; Provisional' as texts, case when value < 3 then 'Low' when value < 6 then 'Moderate' when value < 9 then 'High' when value is not null then 'Very high' end as swell from events", "events")
def reading_labels(events: DataFrame) -> DataFrame:
    """Texts of the codes of readings, and classes of a number."""
    texts = labels.qualifier_texts(F.array(_case(CODES, 0, "event_id"), F.lit("P")))
    return events.select("event_id", F.array_join(texts["text"], "; ").alias("texts"), labels.shrink_swell(F.col("value")).alias("swell"))


@query(
    """with p as (select p_partkey, p_size * 100 as t, case when p_size % 3 = 0 then p_size * 100 when p_size % 3 = 1 then p_size * 100 + 50 end as b, p_partkey % 3 as r from part)
    select p_partkey, format('{:,}', t) || case when b <> t then '–' || format('{:,}', b) || '.5' else '' end || case r when 0 then ' ft (elevation)' when 1 then ' ft below land surface' else ' ft' end as depth,
      case r when 0 then 'exact coordinates' when 1 then 'precision unknown' else 'within about ' || format('{:,}', t) || ' m' end as place, '1:' || format('{:,}', t * 100) as scale,
      case r when 0 then 'Confidence unknown' when 1 then '75% confidence · 3 maps, 50% agree' else '75% confidence · only map here · Geolex unit' end as confidence from p""",
    "part",
)
def display_texts(part: DataFrame) -> DataFrame:
    """Depths, places, scales and confidence as they are shown."""
    t, r = F.col("p_size") * 100, F.col("p_partkey") % 3
    bottom = F.when(F.col("p_size") % 3 == 0, t.cast("double")).when(F.col("p_size") % 3 == 1, t + 50.5)
    reference = F.when(r == 0, "elevation").when(r == 1, "land surface")
    place = labels.radius_text(r != 0, F.when(r == 2, t + 0.25))
    sources, agreement = F.when(r == 1, 3).otherwise(1), F.lit(0.5)
    confidence = labels.confidence_text(F.when(r != 0, 0.75), sources, agreement, r == 2)
    return part.select("p_partkey", labels.depth_text(t, bottom, reference).alias("depth"), place.alias("place"), labels.scale_text(t * 100).alias("scale"), confidence.alias("confidence"))


@query(
    """with e as (select vec_id, label, embedding[1]::double as x, embedding[2]::double as y, 1980 + vec_id % 40 as year from embeddings), g as (select label, min(x) + 0.1 as w, min(y) + 0.1 as s, max(x) - 0.1 as e, max(y) - 0.1 as n from e where label > 0 group by 1)
    select vec_id, case when why is null then least(0.6, 0.5) end as confidence, why as reason from (select vec_id, case when year <= 1990 then 'too old' when g.label is null then 'no box' when x < w - 0.05 or x > e + 0.05 or y < s - 0.05 or y > n + 0.05 then 'outside the box' end as why from e left join g using (label))""",
    "embeddings",
)
def assumed_places(embeddings: DataFrame) -> DataFrame:
    """Places without a printed datum: assumed for late documents, inside their box."""
    p = embeddings.select("vec_id", "label", *(F.get("embedding", i).cast("double").alias(c) for i, c in enumerate("xy")), (F.col("vec_id") % 40 + 1980).alias("year"))
    box = p.where("label > 0").groupBy("label").agg((F.min("x") + 0.1).alias("w"), (F.min("y") + 0.1).alias("s"), (F.max("x") - 0.1).alias("e"), (F.max("y") - 0.1).alias("n"))
    judged = labels.assumed_datum(F.lit(0.8), F.col("x"), F.col("y"), F.col("year"), tuple(F.col(c) for c in "wsen"))
    return p.join(box, "label", "left").select("vec_id", judged.alias("j")).select("vec_id", "j.*")


DATUMS = [("NAVD88",), ("NGVD29",), ("MSL",), ("land surface",), ("unknown",), (None,), ("LOCAL",)]


@query(
    f"""with p as (select p_partkey, p_size::double as v, {_answers(DATUMS, 0)} as d, 1960 + p_size as year, case when p_partkey % 5 > 0 then -0.5 end as shift from part),
    r as (select *, case when d = 'land surface' then 'relative to land surface; no elevation datum' when d = 'MSL' and year >= 1991 then 'sea level: NGVD29 or NAVD88 unclear' when d in ('MSL', 'NGVD29') and shift is null then 'location outside the shift grid' when d = 'LOCAL' then 'datum not supported' end as reason from p)
    select p_partkey, case when reason is null then v + case when d in ('MSL', 'NGVD29') then shift else 0 end end as value, case when reason is null then d = 'MSL' or d = 'unknown' or d is null end is true as approximate, reason from r""",
    "part",
)
def datum_shift(part: DataFrame) -> DataFrame:
    """Elevations in the newer datum, with the reasons of those that cannot be moved."""
    shift = F.when(F.col("p_partkey") % 5 > 0, -0.5)
    moved = labels.to_datum(F.col("p_size").cast("double"), _case(DATUMS, 0), F.col("p_size") + 1960, shift)
    return part.select("p_partkey", moved.alias("m")).select("p_partkey", "m.value", F.coalesce("m.approximate", F.lit(False)).alias("approximate"), "m.reason")


TESTS = [
    ("0.5 mg/L", None, "0.5 mg/L", False, ""),
    ("0.|2 found", "mg/L", "0.2", False, "ocr_digit"),
    ("seven", None, "seven", False, "unclear_value,missing_units"),
    ("7.2", None, "7.2", True, ""),
    ("ND", None, "ND", False, ""),
    ("| to 6", None, "6", False, "ocr_digit,missing_units"),
    (None, "%", "12-14", False, ""),
]


@query(f"select p_partkey, {_answers(TESTS, 4)} as problems from part", "part")
def review_tests(part: DataFrame) -> DataFrame:
    """Problems of stored test values."""
    quote, units, value, plain = (_case(TESTS, i) for i in range(4))
    return part.select("p_partkey", F.array_join(labels.review_problems(quote, value, units, plain), ",").alias("problems"))


@query(
    """select event_id, round(least(0.7, greatest(0.0, least(0.7, value / 100 * 0.8::double) * case event_type when 'click' then 1.0 when 'view' then 0.4 else 0.8 end * case when event_id % 2 = 0 then 0.85 else 1 end * case when event_id % 5 = 0 then 0.5 else 1 end)), 9) as confidence from events""",
    "events",
)
def image_readings(events: DataFrame) -> DataFrame:
    """Confidence of readings of images: capped, and lowered by verdict, inference and unclear digits."""
    found = labels.image_confidence(F.col("value") / 100, F.col("event_type"), F.col("event_id") % 2 == 0, F.col("event_id") % 5 == 0, 0.7, 0.8, {"click": 1.0, "view": 0.4}, 0.8, 0.85, 0.5, 9)
    return events.select("event_id", found.alias("confidence"))
