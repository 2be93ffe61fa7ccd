"""Operators for preparing training corpora at scale: tokenising, scoring, extraction, filtering, deduplication,
decontamination, secret scanning and archive round trips. Nothing outside this subpackage imports it."""
