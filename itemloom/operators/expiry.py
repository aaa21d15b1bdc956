"""Time to live: which items are expired, and what a sweep leaves and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The identity on the removals that a sweep records, a fixed value of the format.
SERVICE = "dynamodb.amazonaws.com"


def epoch(value: Column) -> Column:
    """A TTL attribute's seconds: a whole positive number, else none."""
    return F.when((value > 0) & (value == F.floor(value)), value.cast("long"))


def is_expired(value: Column, now: int) -> Column:
    return F.coalesce(epoch(value).between(1, now), F.lit(False))


def candidates(items: DataFrame, ttl: str, now: int, key: list[str], part: list[str], locked: DataFrame | None = None, most: int = 2) -> DataFrame:
    """The ``most`` items of each part that expired first and aren't locked."""
    due = items.where(is_expired(F.col(ttl), now))
    if locked is not None:
        due = due.join(locked.select(*key), key, "left_anti")
    return due.withColumn("place", F.row_number().over(Window.partitionBy(*part).orderBy(ttl, *key))).where(F.col("place") <= most)


def sweep(items: DataFrame, ttl: str, now: int) -> DataFrame:
    return items.where(~is_expired(F.col(ttl), now))


def removals(items: DataFrame, ttl: str, now: int, key: list[str]) -> DataFrame:
    """The stream records of a sweep."""
    return items.where(is_expired(F.col(ttl), now)).select(*key, F.lit("REMOVE").alias("event_name"), F.lit(SERVICE).alias("principal"))
