"""Column rules: weights, status classes, confidence algebra, interval overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def steps(value: Column, bounds: list[tuple[float, float]], beyond: float, missing: float) -> Column:
    """A step function: the weight of the first bound that value does not exceed."""
    found = F.when(value.isNull(), F.lit(missing))
    for bound, weight in bounds:
        found = found.when(value <= bound, F.lit(weight))
    return found.otherwise(F.lit(beyond))


def first_class(rules: list[tuple[Column, str]], other: str) -> Column:
    """The name of the first rule that holds."""
    return reduce(lambda acc, r: acc.when(r[0], F.lit(r[1])), rules[1:], F.when(rules[0][0], F.lit(rules[0][1]))).otherwise(F.lit(other))


def reading_status(age_hours: Column) -> Column:
    """Current up to 3 hours, recent up to 72, else stale; no reading is an issue."""
    return F.when(age_hours.isNull(), "issue").when(age_hours <= 3, "current").when(age_hours <= 72, "recent").otherwise("stale")


def boosted(confidence: Column, others: Column, boost: float = 0.3, cap: float = 0.98) -> Column:
    """Confidence after agreement of so many independent sources, never lowered."""
    return F.greatest(confidence, F.least(F.lit(cap), 1 - (1 - confidence) * F.pow(F.lit(1 - boost), others)))


def overlap_share(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """The share of the narrower interval that lies inside the other; for a point, whether it does."""
    common = F.greatest(F.least(a_high, b_high) - F.greatest(a_low, b_low), F.lit(0.0))
    narrow = F.least(a_high - a_low, b_high - b_low)
    inside = (F.greatest(a_low, b_low) <= F.least(a_high, b_high)).cast("double")
    return F.when(narrow > 0, common / narrow).otherwise(inside)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def identity_weight(identity: Column) -> Column:
    """1 for certain, 0.8 for questionable, else 0.9."""
    word = F.lower(F.trim(identity))
    return F.when(word == "certain", 1.0).when(word == "questionable", 0.8).otherwise(0.9)


def merged_confidence(base: Column, agreement: Column, supported: Column) -> Column:
    """Base confidence raised or lowered by the agreement of others (a little lower without any), and raised where a
    reference supports it; at most 1."""
    value = base * F.when(agreement.isNull(), 0.92).otherwise(0.8 + 0.25 * agreement)
    return F.least(F.lit(1.0), value + F.when(supported, 0.03).otherwise(0.0))


def confidence_level(value: Column) -> Column:
    """High from 0.7 on, Medium from 0.4 on, else Low; null for null."""
    return F.when(value >= 0.7, "High").when(value >= 0.4, "Medium").when(value.isNotNull(), "Low")


def is_water(name: Column, unit: Column, material: Column, lith: Column) -> Column:
    """Whether one of four columns says water."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return low(name).isin("water", "bodies of water") | (low(unit) == "water") | low(material).startswith("water") | (low(lith) == "water")


def station_type(code: Column, parameters: Column, kinds: list[tuple[str, str]], measured: list[tuple[list[str], str]], other: str) -> Column:
    """A type from the start of a code, else from what is measured, else other."""
    made = [F.when(F.coalesce(code.startswith(p), F.lit(False)), F.lit(t)) for p, t in kinds]
    made += [F.when(F.arrays_overlap(parameters, F.array(*map(F.lit, names))), F.lit(t)) for names, t in measured]
    return F.coalesce(*made, F.lit(other))
