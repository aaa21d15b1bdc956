"""The change log as a stream: index upkeep, records and expiry.

The state kept is one row per key, as in the batch forms these equal. Changes may
come late and in any order: a version older than the one applied is superseded.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from itemloom.operators import change_log, expiry, index


def read_log(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder, in the order of their times."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def fold(changes: DataFrame, keys: list[str], version: list[str], value: str) -> DataFrame:
    """The newest image of each index key, as a running aggregate (update or
    complete mode); tombstones stay in the state and fence late changes."""
    return index.fold(changes, keys, version, value)


def records(log: DataFrame, key: str, version: str, image: str) -> DataFrame:
    """Stream records against the image kept for each key; changes older than
    that image's version give none."""
    kind = log.schema[key].dataType.simpleString()

    def step(name: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, old = state.get if state.exists else (-1, None)
        rows = []
        for row in pd.concat(list(frames)).sort_values(version, kind="stable").itertuples(index=False):
            new, at = getattr(row, image), int(getattr(row, version))
            new = None if pd.isna(new) else new
            if at <= seen:
                continue
            if new != old:
                rows.append((name[0], at, "INSERT" if old is None else "REMOVE" if new is None else "MODIFY", old, new))
            seen, old = at, new
        state.update((seen, old))
        yield pd.DataFrame(rows, columns=[key, version, "event_name", "old_image", "new_image"])

    schema = f"{key} {kind}, {version} long, event_name string, old_image string, new_image string"
    return log.select(key, version, image).groupBy(key).applyInPandasWithState(step, schema, "seen long, image string", "append", GroupStateTimeout.NoTimeout)


def removals(items: DataFrame, ttl: str, now: int, key: list[str]) -> DataFrame:
    """The records of expired items among the new ones."""
    return expiry.removals(items, ttl, now, key)


def retained(made: DataFrame, created: Column, now: int) -> DataFrame:
    return change_log.retained(made, created, now)


def put_into(stream: DataFrame, folder: str, key: list[str], version: str, checkpoint: str):
    """Apply a stream's newest image per key to a table of snapshots: each batch
    writes a new one (``folder``/batch=N), so a repeated batch writes it again."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = f"{folder}/batch={number}"
        if number:
            before = spark.read.schema(batch.schema).parquet(f"{folder}/batch={number - 1}")
            batch = before.unionByName(batch)
        change_log.state(batch, key, version).write.mode("overwrite").parquet(path)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
