"""Text helpers shared by parsing and mining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the Unicode White_Space property.
WHITESPACE = (
    "\t\n\u000b\u000c\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def trimmed(text: Column) -> Column:
    """``text`` without Unicode whitespace at either end."""
    return F.btrim(text, F.lit(WHITESPACE))


def tokens(text: Column) -> Column:
    """The non-empty pieces of ``text`` between runs of Unicode whitespace."""
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def contains_ignoring_case(text: Column, needle: str) -> Column:
    """Literal, case-insensitive substring test."""
    return F.contains(F.lower(text), F.lower(F.lit(needle)))


def once(value: Column) -> Column:
    """``value``, computed once per row however often the new column is used.

    Spark copies a plain expression into the filters and projections above it, which would run a
    regular expression once per use; it does not copy a generator. Use as a whole output column, and
    only where the column is always needed: a generator is not pruned either.
    """
    return F.explode(F.array(value))


def with_value(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
