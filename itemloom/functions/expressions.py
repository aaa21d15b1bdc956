"""Conditions and updates over items, as Spark columns.

Conditions are two-valued: a comparison with an absent attribute or between
different kinds of values isn't met, and never an error; ``negate`` is true where
the inner condition isn't met, and ``<>`` where ``=`` isn't, so also with an absent
side. A column that is null is an absent attribute. What isn't met may be null
rather than false: a filter drops both, and bare comparisons reach the scan;
``met`` gives a boolean to show.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


#: Kinds of values by the names that Spark gives to their types.
_NUMBER = r"^(tinyint|smallint|int|bigint|float|double|decimal.*)$"
_TIME = r"^(timestamp|timestamp_ntz|date)$"


def _kind(value: Column) -> Column:
    """The kind of a column's type; Spark folds it to a constant."""
    name = F.typeof(value)
    return F.when(name.rlike(_NUMBER), "number").when(name.rlike(_TIME), "time").otherwise(name)


def _typed(left: Column, right: Any, made: Callable[[Column, Column], Column]) -> Column:
    """``made`` of both sides where they are of one kind."""
    right = right if isinstance(right, Column) else F.lit(right)
    return F.when(_kind(left) == _kind(right), made(left, right))


def met(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def attribute(path: str, source: str | None = None, kind: str = "string") -> Column:
    """A column, or a place like ``a.b[1]`` inside a JSON column ``source``,
    which is null if absent or of another kind."""
    if source is None:
        return F.col(path)
    return F.try_variant_get(F.try_parse_json(F.col(source)), f"$.{path}", kind)


def compare(left: Column, operator: str, right: Any) -> Column:
    if operator == "<>":
        return negate(compare(left, "=", right))
    return _typed(left, right, COMPARISONS[operator])


def between(value: Column, low: Any, high: Any) -> Column:
    if not isinstance(low, Column) and not isinstance(high, Column) and low > high:
        raise ValueError("the lower bound lies above the upper one")
    return compare(value, ">=", low) & compare(value, "<=", high)


def within(value: Column, choices: Sequence[Any]) -> Column:
    """Whether the value equals one of the choices of its kind."""
    return any_of(*(compare(value, "=", c) for c in choices))


def exists(value: Column) -> Column:
    return value.isNotNull()


def not_exists(value: Column) -> Column:
    return value.isNull()


def begins_with(value: Column, prefix: str | bytes) -> Column:
    return _typed(value, prefix, lambda v, p: v.startswith(p))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def negate(condition: Column) -> Column:
    return ~met(condition)


FUNCTIONS: dict[str, Callable[..., Column]] = {"attribute_exists": exists, "attribute_not_exists": not_exists, "begins_with": begins_with}


def call(name: str, *arguments: Any) -> Column:
    if name not in FUNCTIONS:
        raise ValueError(f"unsupported function: {name}")
    return FUNCTIONS[name](*arguments)


@dataclass(frozen=True)
class Update:
    """One action on an attribute: ``set``, ``remove``, ``add`` or ``delete``."""

    action: str
    name: str
    value: Any = None

    def applied(self, old: Column) -> Column:
        value = self.value
        if isinstance(value, SetValue):
            value = F.array(*(F.lit(x) for x in value))
        elif not isinstance(value, Column):
            value = F.lit(value)
        if self.action == "set":
            return value
        if self.action == "remove":
            return F.lit(None)
        if self.action == "add":
            # A number is added to what is there; a set is united with it.
            return F.array_sort(F.array_union(F.coalesce(old, F.array()), value)) if isinstance(self.value, SetValue) else F.coalesce(old, F.lit(0)) + value
        if self.action == "delete":
            left = F.array_except(old, value)
            return F.when(F.size(left) > 0, left)
        raise ValueError(f"unknown action: {self.action}")


class SetValue(list):
    """A set given to ``add`` or ``delete``."""
