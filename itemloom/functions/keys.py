"""Ordered key encoding, key spans and scan segments.

A key component is a tag, its escaped payload and two zero bytes; encoded keys
compare bytewise like the typed values. Homogeneous typed columns sort the same
way natively, so queries use them as they are; the encoding serves cursors,
directories and tables of mixed keys.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the key format.
TAG_STRING, TAG_NUMBER, TAG_BINARY = "10", "20", "30"
DIGITS, LEAST_EXPONENT, MOST_EXPONENT = 38, -130, 125


def escaped(payload: Column) -> Column:
    """Binary with each zero byte followed by FF."""
    spaced = F.regexp_replace(F.hex(payload), "(..)", "$1 ")
    return F.unhex(F.replace(F.replace(spaced, F.lit("00 "), F.lit("00FF ")), F.lit(" "), F.lit("")))


def component(tag: str, payload: Column) -> Column:
    return F.concat(F.unhex(F.lit(tag)), escaped(payload), F.unhex(F.lit("0000")))


def string_key(value: Column) -> Column:
    return component(TAG_STRING, F.encode(value, "UTF-8"))


def binary_key(value: Column) -> Column:
    return component(TAG_BINARY, value)


def number_payload(text: str) -> bytes:
    """Bytes that order exact decimals of up to 38 digits; equal numbers are equal bytes."""
    sign, digits, exponent = Decimal(text).as_tuple()
    if not isinstance(exponent, int):
        raise ValueError(f"{text}: not a number")
    plain = "".join(map(str, digits)).lstrip("0")
    stripped = plain.rstrip("0")
    if not stripped:
        return b"\x01"
    exponent += len(plain) - 1
    if len(stripped) > DIGITS or not LEAST_EXPONENT <= exponent <= MOST_EXPONENT:
        raise ValueError(f"{text}: outside the number domain")
    figures = [int(c) for c in stripped.ljust(DIGITS, "0")]
    place = exponent - LEAST_EXPONENT
    if sign:
        return bytes([0, 255 - place, *(9 - f for f in figures)])
    return bytes([2, place, *figures])


def number_key(value: Column) -> Column:
    """Key of decimals given as strings, so that their whole domain fits."""

    @F.pandas_udf("binary")
    def payload(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else number_payload(t))

    return component(TAG_NUMBER, payload(value.cast("string")))


def successor(prefix: bytes) -> bytes | None:
    """The least byte string beyond all that begin with ``prefix``; None if there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


@dataclass(frozen=True)
class KeySpan:
    """Keys from ``lower`` up to, without, ``upper``; None is unbounded."""

    lower: bytes | None = None
    upper: bytes | None = None

    def contains(self, key: bytes) -> bool:
        return (self.lower is None or key >= self.lower) and (self.upper is None or key < self.upper)

    def within(self, key: Column) -> Column:
        out = F.lit(True)
        if self.lower is not None:
            out = out & (key >= F.lit(self.lower))
        if self.upper is not None:
            out = out & (key < F.lit(self.upper))
        return out

    def intersection(self, other: KeySpan) -> KeySpan | None:
        lows = [x for x in (self.lower, other.lower) if x is not None]
        highs = [x for x in (self.upper, other.upper) if x is not None]
        both = KeySpan(max(lows, default=None), min(highs, default=None))
        return None if both.lower is not None and both.upper is not None and both.lower >= both.upper else both

    def resume(self, key: bytes, forward: bool = True) -> KeySpan | None:
        """What is left after ``key`` was read."""
        return self.intersection(KeySpan(lower=key + b"\x00") if forward else KeySpan(upper=key))


def segment(key: Column, total: int) -> Column:
    """A stable segment from 0 to ``total`` - 1 of a key, by its hash."""
    return F.floor(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") * total / F.lit(1 << 32)).cast("long")
