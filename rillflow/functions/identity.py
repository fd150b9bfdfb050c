"""Canonical spellings of identifiers and labels, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid_key(c: Column) -> Column:
    """32 lower-case hex digits for any spelling of a UUID (case, blanks, braces, hyphens, urn prefix).

    A string that is no UUID gives itself, trimmed and in lower case, behind a '?', so that it can't meet a UUID.
    Null gives null.
    """
    plain = F.lower(F.trim(c))
    digits = F.regexp_replace(F.regexp_replace(plain, r"^urn:uuid:", ""), r"[\s{}()\-]", "")
    return F.when(digits.rlike(r"^[0-9a-f]{32}$"), digits).otherwise(F.concat(F.lit("?"), plain))


def label_key(c: Column) -> Column:
    """Letter case and surrounding blanks carry no meaning. Null gives null."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def snake_key(c: Column) -> Column:
    """Lower-case words joined by single underscores, whatever separated them."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")


def epoch_ms(c: Column) -> Column:
    return F.unix_millis(c)
