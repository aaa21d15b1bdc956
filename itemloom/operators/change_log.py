"""The change log: from mutations to state, stream records, pages and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def state(log: DataFrame, key: list[str], version: str, removed: Column | None = None) -> DataFrame:
    """The newest row of each key; keys whose newest row is removed are absent.
    A partial aggregate, so a key with very many changes is no hot task."""
    newest = log.groupBy(*key).agg(F.max_by(F.struct(*log.columns), F.col(version)).alias("newest")).select("newest.*")
    return newest if removed is None else newest.where(~removed)


def with_old(log: DataFrame, key: list[str], version: str, values: list[str]) -> DataFrame:
    """Each change with the values (``old_``...) it replaces."""
    before = Window.partitionBy(*key).orderBy(version)
    return log.withColumns({f"old_{v}": F.lag(v).over(before) for v in values} | {"is_first": F.row_number().over(before) == 1})


def records(log: DataFrame, key: list[str], version: str, image: str) -> DataFrame:
    """Stream records: event name and both images; changes that leave the item as
    it was give none. A null image is a removal."""
    paired = with_old(log, key, version, [image])
    old, new = F.col(f"old_{image}"), F.col(image)
    name = F.when(old.isNull() & new.isNotNull(), "INSERT").when(old.isNotNull() & new.isNotNull(), "MODIFY").when(old.isNotNull() & new.isNull(), "REMOVE")
    made = paired.where(~old.eqNullSafe(new))
    return made.select(*key, version, name.alias("event_name"), old.alias("old_image"), new.alias("new_image"), F.octet_length(F.coalesce(new, old)).cast("long").alias("size_bytes"), sequence_number(F.col(version)).alias("sequence_number"))


def sequence_number(commit: Column, ordinal: Column | int = 0) -> Column:
    """20 digits of the commit and 3 of the place in it."""
    return F.concat(F.lpad(commit.cast("string"), 20, "0"), F.lpad(F.lit(ordinal).cast("string") if isinstance(ordinal, int) else ordinal.cast("string"), 3, "0"))


def view(made: DataFrame, kind: str) -> DataFrame:
    """Records with the images that a stream view shows."""
    shown = {"KEYS_ONLY": (), "NEW_IMAGE": ("new_image",), "OLD_IMAGE": ("old_image",), "NEW_AND_OLD_IMAGES": ("old_image", "new_image")}[kind]
    return made.drop(*({"old_image", "new_image"} - set(shown)))


def read_page(made: DataFrame, version: str, after: int, limit: int) -> DataFrame:
    """Up to ``limit`` (1 to 1000) records beyond a sequence."""
    if not 1 <= limit <= 1000:
        raise ValueError("a page has 1 to 1000 records")
    return made.where(F.col(version) > after).orderBy(version).limit(limit)


def get_records(made: DataFrame, version: str, after: int, limit: int, created: Column, now: int, size: Column, budget: int = 1 << 20, keep: int = 24 * 3600) -> DataFrame:
    """A page of records beyond a sequence, that are younger than ``keep`` seconds: up
    to ``limit`` (1 to 1000) and up to ``budget`` bytes. Every row says the page's
    ``last_sequence`` and whether no record follows (``exhausted``). A first record
    larger than the budget is an error when the rows are computed."""
    if not 1 <= limit <= 1000:
        raise ValueError("a page has 1 to 1000 records")
    live = made.where((F.col(version) > after) & (created > now - keep))
    running, page = Window.orderBy(version).rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    first = live.orderBy(version).limit(limit + 1).withColumns({"place": F.row_number().over(running), "page_bytes": F.sum(size).over(running)})
    fits = (F.col("place") <= limit) & (F.col("page_bytes") <= budget)
    checked = F.when((F.col("place") == 1) & (F.col("page_bytes") > budget), F.raise_error(F.lit("a record exceeds the page's bytes")).cast("boolean")).otherwise(fits)
    told = first.withColumn("fits", checked).withColumns({"last_sequence": F.max(F.when(F.col("fits"), F.col(version))).over(page), "exhausted": F.min("fits").over(page)})
    return told.where("fits").drop("fits", "place")


def shard_end(latest: DataFrame, shard: str, version: str, closed: DataFrame) -> DataFrame:
    """``latest`` read positions (shard, version) with ``state``: End for a closed
    shard read to its last sequence, else More; ``closed`` has (shard, last)."""
    met = latest.join(closed.select(shard, F.col("last").alias("closed_at")), shard, "left")
    return met.withColumn("state", F.when(F.col(version) >= F.col("closed_at"), "End").otherwise("More")).drop("closed_at")


def tail(made: DataFrame, shard: list[str], version: str) -> DataFrame:
    """The last sequence of each shard."""
    return made.groupBy(*shard).agg(F.max(version).alias("latest"))


def retained(made: DataFrame, created: Column, now: int, keep: int = 24 * 3600) -> DataFrame:
    """Records younger than ``keep`` seconds; the others are visible no more."""
    return made.where(created > now - keep)


def prunable(made: DataFrame, created: Column, now: int, keep: int = 24 * 3600) -> DataFrame:
    return made.where(created <= now - keep)
