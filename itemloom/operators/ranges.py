"""Statistics, split points, and directories of key ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def statistics(items: DataFrame, size: Column, indexes: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(name, item_count, item_bytes) of a table and its indexes, each given by who
    is in it and its items' bytes, in one pass."""
    held = {"table": (F.lit(True), size)} | indexes
    row = items.agg(*(x for name, (inside, own) in held.items() for x in (F.sum(inside.cast("long")).alias(f"{name}_n"), F.sum(F.when(inside, own)).alias(f"{name}_b"))))
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(f"{n}_n", F.lit(0)).alias("item_count"), F.coalesce(f"{n}_b", F.lit(0)).cast("long").alias("item_bytes")) for n in held))).alias("x")).select("x.*")


def split_point(items: DataFrame, key: str) -> DataFrame:
    """(split_key, key_count): the key at place count / 2 of the distinct keys, none
    for fewer than two. Keys of any type are sorted over ranges; with the count of
    each range, a row for each, every key knows its place."""
    spark = items.sparkSession
    keys = items.select(F.col(key).alias("split_key")).where(F.col(key).isNotNull()).distinct()
    placed = keys.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "split_key").sortWithinPartitions("split_key")
    # The upper half of the id is the range, the lower one the place in it.
    placed = placed.withColumn("id", F.monotonically_increasing_id()).withColumn("part", F.shiftright("id", 33))
    counts = placed.groupBy("part").agg(F.count("*").alias("own"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"), F.sum("own").over(Window.partitionBy()).alias("key_count"))
    ranked = placed.join(F.broadcast(counts), "part").withColumn("place", F.col("before") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1)))
    return ranked.where((F.col("key_count") >= 2) & (F.col("place") == F.floor(F.col("key_count") / 2))).select("split_key", "key_count")


def directory(fences: DataFrame, fence: str) -> DataFrame:
    """(part, lower, upper) of the ranges between fences: a row per range."""
    over = Window.orderBy(F.col("lower").asc_nulls_first())
    lows = fences.select(F.col(fence).alias("lower")).unionByName(fences.select(F.lit(None).cast(fences.schema[fence].dataType).alias("lower")).limit(1)).distinct()
    return lows.select(F.row_number().over(over).alias("part"), "lower", F.lead("lower").over(over).alias("upper"))


def route(items: DataFrame, key: str, ranges: DataFrame) -> DataFrame:
    """Items with the part that owns their key; a directory has a row per range."""
    k = F.col(key)
    return items.join(F.broadcast(ranges), (F.col("lower").isNull() | (k >= F.col("lower"))) & (F.col("upper").isNull() | (k < F.col("upper"))))
