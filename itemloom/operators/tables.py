"""The catalog as data: tables, tags, streams and the rules on changing them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from itemloom.operators.read import after
from itemloom.operators.transactions import fold

#: Changes of a table's class that are allowed in 30 days.
CLASS_CHANGES, CLASS_WINDOW = 2, 30 * 86400


def list_page(entries: DataFrame, order: list[str], start: tuple | None = None, limit: int = 100) -> DataFrame:
    """Up to ``limit`` (1 to 100) entries in order beyond ``start``, with whether more follow."""
    if not 1 <= limit <= 100:
        raise ValueError("a page has 1 to 100 entries")
    if start is not None:
        entries = entries.where(after(order, dict(zip(order, start, strict=True)), True))
    # One row more than a page tells whether there is another.
    first = entries.orderBy(*order).limit(limit + 1)
    numbered = first.withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit)
    return numbered.where(F.col("place") <= limit)


def live(tables: DataFrame, deletions: DataFrame) -> DataFrame:
    """Tables that aren't being deleted."""
    return tables.join(deletions.select("table_id"), "table_id", "left_anti")


def lifecycle(tables: DataFrame, deletions: DataFrame) -> DataFrame:
    marked = tables.join(deletions.select("table_id", F.lit(True).alias("fenced")), "table_id", "left")
    return marked.withColumn("status", F.when(F.col("fenced"), "DELETING").otherwise("ACTIVE")).drop("fenced")


def current_tags(changes: DataFrame) -> DataFrame:
    """(arn, tag, value) after puts and removals (null values), newest first."""
    return changes.groupBy("arn", "tag").agg(F.max_by("value", "seq").alias("value")).where("value IS NOT NULL")


def class_changes(changes: DataFrame, tie: str = "at", first: str = "STANDARD") -> DataFrame:
    """Changes (table_id, at, class, in the order of ``at`` and ``tie``) with whether
    they were ``allowed``: a change to the class that the table has counts nothing and
    is always allowed, another one if fewer than two were accepted in the 30 days
    before. Tables begin with the class ``first``; a refused change leaves it."""

    def step(state, row):
        now, accepted = state or (first, ())
        if row["class"] == now:
            return (now, accepted), (True,)
        accepted = tuple(t for t in accepted if t > row["at"] - CLASS_WINDOW)
        if len(accepted) >= CLASS_CHANGES:
            return (now, accepted), (False,)
        return (row["class"], (*accepted, row["at"])), (True,)

    return fold(changes, "table_id", ["at", tie], step, pa.schema([("allowed", pa.bool_())]))


def newest_statistics(samples: DataFrame) -> DataFrame:
    """Per table the last sample; an older one never replaces a newer one."""
    return samples.groupBy("table_id").agg(F.max_by(F.struct(*[c for c in samples.columns if c != "table_id"]), "sampled_at").alias("s")).select("table_id", "s.*")
