"""Name normalisation (native expressions, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32 ASCII punctuation characters that are deleted from names
# (the same set as Python's string.punctuation), in natural order.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Java regex character class for PUNCTUATION; every character is escaped.
_PUNCT_CLASS = "[" + "".join("\\" + c for c in PUNCTUATION) + "]"
# Unicode whitespace as Python's str.isspace() sees it: Java's (?U)\s plus the
# four information separators 0x1c-0x1f, which Python also treats as whitespace.
_SPACE_RUN = "(?U)[\\s\\x{1c}-\\x{1f}]+"


# A name that cleaning leaves as it is (once in upper case): most names, found by one cheap match.
_CLEAN = "\\A[A-Z0-9]+(?: [A-Z0-9]+)*+\\z"


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_name(c) -> Column:
    """Upper-case, delete ASCII punctuation (no space inserted), collapse whitespace
    runs to one blank, trim; null becomes the empty string."""
    x = F.upper(_as_col(c))
    cleaned = F.trim(F.regexp_replace(F.regexp_replace(x, _PUNCT_CLASS, ""), _SPACE_RUN, " "))
    return F.coalesce(F.when(x.rlike(_CLEAN), x).otherwise(cleaned), F.lit(""))


def upper_trim(c) -> Column:
    """The lighter normalisation used by pair lookups: upper case and strip blanks; null
    becomes the empty string."""
    x = F.upper(_as_col(c))
    return F.coalesce(F.regexp_replace(x, "(?U)^[\\s\\x{1c}-\\x{1f}]+|[\\s\\x{1c}-\\x{1f}]+$", ""), F.lit(""))


def normalise(c, mode: str = "clean") -> Column:
    if mode == "clean":
        return clean_name(c)
    if mode == "upper_trim":
        return upper_trim(c)
    raise ValueError(f"unknown name mode {mode!r}")


def canonical_pair(a, b, mode: str = "clean") -> tuple[Column, Column]:
    """Normalise both names and order them so that drug_a <= drug_b."""
    na, nb = normalise(a, mode), normalise(b, mode)
    return F.least(na, nb), F.greatest(na, nb)
