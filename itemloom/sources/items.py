"""Item tables over Parquet: key schemas, indexes and change logs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Index:
    """A secondary index; ``include`` is None for all attributes."""

    name: str
    hash_keys: tuple[str, ...]
    range_keys: tuple[str, ...] = ()
    include: tuple[str, ...] | None = None

    @property
    def keys(self) -> tuple[str, ...]:
        return self.hash_keys + self.range_keys


@dataclass(frozen=True)
class ItemTable:
    """Keys and indexes of a table of items."""

    name: str
    hash_keys: tuple[str, ...]
    range_keys: tuple[str, ...] = ()
    local: dict[str, Index] = field(default_factory=dict)
    broad: dict[str, Index] = field(default_factory=dict)

    @property
    def keys(self) -> tuple[str, ...]:
        return self.hash_keys + self.range_keys

    def read(self, spark: SparkSession, folder: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{self.name}.parquet")

    def violations(self, items: DataFrame) -> DataFrame:
        """Items that miss a key or whose key is longer than the format allows."""
        bad = F.lit(False)
        for keys, most in ((self.hash_keys, 2048), (self.range_keys, 1024)):
            for k in keys:
                bad = bad | F.col(k).isNull()
                if isinstance(items.schema[k].dataType, (T.StringType, T.BinaryType)):
                    bad = bad | ~F.octet_length(k).between(1, most)
        return items.where(bad)


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


def seconds(ts: str | Column) -> Column:
    return F.floor(micros(ts) / 1_000_000).cast("long")


EVENTS = ItemTable("events", ("user_id",), ("ts",), local={"by_value": Index("by_value", ("user_id",), ("value",))}, broad={"by_type": Index("by_type", ("event_type",), ("value",))})
ORDERS = ItemTable("orders", ("o_orderkey",), broad={"by_customer": Index("by_customer", ("o_custkey",), ("o_orderdate",))})
CONVERSATIONS = ItemTable("conversations", ("conv_id",), ("turn",))
PARTS = ItemTable("part", ("p_brand",), ("p_name", "p_partkey"))
CUSTOMERS = ItemTable("customer", ("c_custkey",))
DOCUMENTS = ItemTable("documents", ("doc_id",))
