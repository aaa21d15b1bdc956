"""Logical bytes of items: names and strings in UTF-8, numbers by their digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def string_bytes(value: Column) -> Column:
    return F.octet_length(value)


def number_bytes(value: Column) -> Column:
    """One byte for two significant digits, one more, and one for a minus."""
    # An exponent's digits don't count.
    plain = F.regexp_replace(value.cast("string"), "[eE].*$", "")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "[-.]", ""), "^0+", ""), "0+$", "")
    return F.ceil(F.greatest(F.length(digits), F.lit(1)) / 2).cast("int") + 1 + F.when(value < 0, 1).otherwise(0)


def list_bytes(*elements: Column) -> Column:
    """Three bytes, one for each element, and the elements."""
    total = F.lit(3 + len(elements))
    for e in elements:
        total = total + e
    return total


def item_bytes(**attributes: Column) -> Column:
    """Names and given value sizes; absent attributes have a null size and count nothing."""
    total = F.lit(0)
    for name, size in attributes.items():
        total = total + F.coalesce(size + len(name.encode()), F.lit(0))
    return total.cast("long")
