"""What a column's name says. These look at schemas on the driver; no data is read."""

from __future__ import annotations

import re
from collections.abc import Sequence

# fixed values: parts of names, whole endings, whole names
PERSONAL_PARTS = ("email", "mrn", "ssn", "dob", "birth", "name", "address", "zip", "phone", "geo")
TIME_PARTS = ("date", "time", "timestamp")
BIRTH_PARTS = ("dob", "birth")
COUNT_TOKENS = frozenset({"count", "cnt", "n", "freq", "frequency", "size", "tally", "num", "total"})
SUBJECT_KEYS = ("time_traveler_id", "subject_id", "participant_id", "public_client_id", "user_id", "record_id", "id")


def _has(name: str, parts: Sequence[str], endings: Sequence[str] = (), whole: Sequence[str] = ()) -> bool:
    low = (name or "").lower()
    return any(p in low for p in parts) or low.endswith(tuple(endings)) or low in whole


def is_sensitive_name(name: str) -> bool:
    return _has(name, PERSONAL_PARTS + TIME_PARTS, ("_at", "_id"), ("id",))


def is_identifier_name(name: str) -> bool:
    """As is_sensitive_name, but dates and times may be released."""
    return _has(name, PERSONAL_PARTS, ("_id",), ("id",))


def is_datetime_name(name: str) -> bool:
    return _has(name, TIME_PARTS, ("_at",))


def is_birth_name(name: str) -> bool:
    return _has(name, BIRTH_PARTS)


def find_count_column(names: Sequence[str]) -> str | None:
    """The first column one of whose words is a word for counts (so n_chars is one, too)."""
    return next((n for n in names if COUNT_TOKENS.intersection(re.split(r"[^a-z0-9]+", n.lower()))), None)


def find_subject_key(names: Sequence[str]) -> str | None:
    """By the order of SUBJECT_KEYS, not of the columns; letter case doesn't count."""
    by_low = {n.lower(): n for n in names}
    return next((by_low[k] for k in SUBJECT_KEYS if k in by_low), None)
