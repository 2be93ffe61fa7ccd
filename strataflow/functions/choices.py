"""Which records are wanted: kinds, distances, addresses, work that is due. All are Column expressions that are never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of sites that are holes or springs, and metres of a mile.
SITES = ("well", "boring", "core", "auger_hole", "test_pit", "cpt", "spring")
MILE = 1609.0


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_site(kind: Column) -> Column:
    """Whether a kind is that of a hole or a spring."""
    return _true(kind.isin(*SITES))


def within(inferred: Column, radius: Column, limit: float = MILE) -> Column:
    """Whether a place is known well enough: read as it stands (not inferred; null counts as inferred), or inferred with a
    known radius up to the limit."""
    return _true(~inferred) | _true(radius <= limit)


def allowed(url: Column, denied: str) -> Column:
    """Whether an address is one of the web and the expression of what is denied does not occur in it."""
    return _true(url.rlike("^https?://") & ~url.rlike(denied))


def tested(features: Column, field: str) -> Column:
    """Features (array of structs) whose number of tests is above zero; null for null."""
    return F.filter(features, lambda f: F.coalesce(f[field], F.lit(0)) > 0)


def record_kind(themes: Column, sheets: Column, title: Column) -> Column:
    """map for records with a theme, a sheet or the word in their title, else publication."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return F.when(some(themes) | some(sheets) | _true(title.rlike(r"(?i)\bmaps?\b")), "map").otherwise("publication")


def stale(candidates: Column, skipped: Column, failed: Column, status: Column, version: Column, now: int, contact: bool) -> Column:
    """Whether a record's sources must be looked up: never done, skipped for want of a contact that there is now, failed, or
    without a text by an older resolver."""
    return candidates.isNull() | (F.lit(contact) & _true(skipped)) | _true(failed) | (~_true(status == "text") & ~_true(version == now))


def retry_due(status: Column, missing: Column, attempts: Column, engine: bool = True, most: int = 3) -> Column:
    """Whether pages without text should be read from their images again: some are missing and tries are left."""
    left = F.coalesce(attempts, F.lit(0)) < most
    return F.lit(engine) & left & (_true(status == "needs_ocr") | _true((status == "text") & (missing > 0)))


def tag(when: Column) -> Column:
    """data-yyyymmdd-HHMM of a time, in the session's zone."""
    return F.date_format(when, "'data-'yyyyMMdd-HHmm")
