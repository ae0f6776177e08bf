"""Text expressions. All of them stay on the JVM side."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolefit import refdata as R


def strip(c: Column) -> Column:
    """Remove white space of every kind (not blanks only, as trim does) from both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def falsy_to_null(c: Column) -> Column:
    """Empty string counts as absent."""
    return F.nullif(c, F.lit(""))


def zero_to_null(c: Column) -> Column:
    """Zero counts as absent."""
    return F.nullif(c, F.lit(0.0))


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """First match of a pattern, or null."""
    if group == 0:
        return F.regexp_substr(c, F.lit(pattern))
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def empty_if_null(c: Column) -> Column:
    """Null array counts as an empty one."""
    return F.coalesce(c, F.array().cast("array<string>"))


def words(c: Column) -> Column:
    """White-space separated words; the empty text has none."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(F.coalesce(c, F.lit(""))))


def tokens(lowered: Column) -> Column:
    """Distinct alphanumeric tokens of an already lower-cased text; the empty token can be among them."""
    return F.array_distinct(F.split(lowered, "[^a-z0-9]+"))


def contains_any(c: Column, terms) -> Column:
    """True when one of a fixed list of terms occurs in the text."""
    test = F.lit(False)
    for term in terms:
        test = test | F.contains(c, F.lit(term))
    return test


def strip_bullet(c: Column, chars: str = R.BULLET_CHARS) -> Column:
    return strip(F.regexp_replace(c, rf"(?U)^[{chars}]\s*", ""))


def normalise_line(c: Column) -> Column:
    """Comparison form of a line: no bullet mark, single blanks, lower case."""
    return F.lower(strip(F.regexp_replace(strip_bullet(c), r"(?U)\s+", " ")))


#: Decimal digits of all scripts outside ASCII, and what each stands for.
_DIGITS = [c for c in map(chr, range(128, 0x110000)) if c.isdecimal()]


def decimal_number(text: Column) -> Column:
    """A number written in decimal digits of any script as a double; null for anything else."""
    return F.translate(text, "".join(_DIGITS), "".join(str(unicodedata.decimal(c)) for c in _DIGITS)).try_cast("double")
