"""Secondary indexes as derived tables, and their upkeep from a change log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.sources.items import Index, ItemTable


def project(items: DataFrame, table: ItemTable, index: Index, form: str = "ALL") -> DataFrame:
    """An index's items: only those that have all of its keys; ``form`` is ALL,
    KEYS_ONLY or INCLUDE (keys and the index's attributes)."""
    for name in index.keys:
        items = items.where(F.col(name).isNotNull())
    if form == "ALL":
        return items
    keys = list(dict.fromkeys([*index.keys, *table.keys]))
    more = [c for c in (index.include or ()) if form == "INCLUDE" and c not in keys]
    return items.select(*keys, *more)


def fold(changes: DataFrame, keys: list[str], version: list[str], value: str) -> DataFrame:
    """(keys, version, value, is_tombstone): the newest image per index key; a
    null image is a tombstone and stays, so that older changes remain superseded."""
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*version, value), F.struct(*version)).alias("newest"))
    return newest.select(*keys, "newest.*").withColumn("is_tombstone", F.col(value).isNull())


def moves(log: DataFrame, key: list[str], index_key: str, version: str, value: str) -> DataFrame:
    """(index_key, key, version, value) changes of an index from a log of items:
    when the index key moves, the old place gets a tombstone with the new version. A
    change that leaves key and value as they were gives none."""
    from itemloom.operators.change_log import with_old

    paired = with_old(log, key, version, [index_key, value])
    old, new = F.col(f"old_{index_key}"), F.col(index_key)
    gone = paired.where(old.isNotNull() & ~old.eqNullSafe(new)).select(old.alias(index_key), *key, version, F.lit(None).cast(log.schema[value].dataType).alias(value))
    same = ~F.col("is_first") & old.eqNullSafe(new) & F.col(f"old_{value}").eqNullSafe(F.col(value))
    put = paired.where(new.isNotNull() & ~same).select(index_key, *key, version, value)
    return put.unionByName(gone)
