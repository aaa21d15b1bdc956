"""Batches of all-or-nothing groups.

Each transaction of a batch sees the snapshot before it, so its members must
have keys of their own; ``fold`` is for transactions that share keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from itemloom.functions.expressions import met

#: The most operations of a transaction, and seconds that a client token lives.
MOST_OPERATIONS = 100
TOKEN_LIFE = 600
#: The most bytes that a transaction reads.
MOST_BYTES = 4 << 20


def decide(operations: DataFrame, txn: str, good: Column, place: str) -> DataFrame:
    """Operations with ``decision`` (COMMIT if all of a transaction's are good, of
    which there may be 100 at most) and the place of the first one that isn't."""
    own = Window.partitionBy(txn)
    marked = operations.withColumn("good", met(good))
    fits = F.count("*").over(own) <= MOST_OPERATIONS
    return marked.withColumn("decision", F.when(F.min("good").over(own) & fits, "COMMIT").otherwise("ABORT")).withColumn("first_failed", F.min(F.when(~F.col("good"), F.col(place))).over(own))


def transact_get(operations: DataFrame, items: DataFrame, key: Sequence[str], place: str) -> DataFrame:
    """One row per read in its order; absent items keep their row."""
    return operations.join(items.withColumn("found", F.lit(True)), [*key], "left").withColumn("found", F.coalesce("found", F.lit(False))).orderBy(place)


def fold(rows: DataFrame, component: str, order: Sequence[str], step: Callable[[Any, dict], tuple[Any, tuple]], more: pa.Schema) -> DataFrame:
    """``rows`` with the columns ``more``, which ``step`` gives for each row of a
    component in order, from a state that it returns, too (None at first). Rows
    pass through batch by batch, so a component of any size needs no room for
    more than its state; give slim rows, since one task reads all of them."""
    names = rows.columns
    laid = rows.repartition(component).sortWithinPartitions(component, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, last, state = False, None, None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if not begun or row[component] != last:
                    begun, last, state = True, row[component], None
                state, values = step(state, row)
                made.append(values)
            added = [pa.array([m[i] for m in made], field.type) for i, field in enumerate(more)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*names, *more.names])

    return laid.mapInArrow(run, T.StructType([*rows.schema, *from_arrow_schema(more)]))


def token_lives(requests: DataFrame, token: str, at: str, fingerprint: str, tie: str, cancelled: str | None = None) -> DataFrame:
    """Requests with ``outcome``: Applied for the one that begins a life of its
    token, by time and ``tie``; for others in that life Replayed if the content is
    the same, or else Mismatch. The first request after a life begins the next, and
    so does the one after a first request that was ``cancelled``."""

    def step(life, row):
        if life is None or row[at] - life[0] >= TOKEN_LIFE:
            freed = cancelled is not None and row[cancelled]
            return None if freed else (row[at], row[fingerprint]), ("Applied",)
        return life, ("Replayed" if row[fingerprint] == life[1] else "Mismatch",)

    return fold(requests, token, [at, tie], step, pa.schema([("outcome", pa.string())]))


def write(items: DataFrame, operations: DataFrame, key: Sequence[str], txn: str, place: str, kind: str, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Transactions of puts, updates, deletes and checks: (decided operations, items
    after them). ``kind`` is PUT, UPDATE, DELETE or CHECK; the condition sees the old
    item's attributes as ``old_``... The operations' further columns are attributes:
    a put replaces the item as a whole, an update sets those that aren't null.

    A transaction with any failure changes nothing. ``failure`` of an operation is
    ConditionFailed, DuplicateItem (an item that another operation of the transaction
    addresses, too) or TooMany (operations); ``old`` is the item before. Each
    transaction sees the items as given, so transactions of a batch that address the
    same item conflict: all but the first, by ``txn``, fail with Conflict.
    """
    attributes = [c for c in items.columns if c not in key]
    old = items.select(*key, *(F.col(c).alias(f"old_{c}") for c in items.columns), F.struct(*items.columns).alias("old"))
    seen = operations.join(old, [*key], "left")
    own, same, item = Window.partitionBy(txn), Window.partitionBy(txn, *key), Window.partitionBy(*key)
    failure = (
        F.when(F.count("*").over(own) > MOST_OPERATIONS, "TooMany")
        .when(F.count("*").over(same) > 1, "DuplicateItem")
        .when(F.col(txn) > F.min(txn).over(item), "Conflict")
        .when(~met(condition), "ConditionFailed")
    )
    marked = seen.withColumn("failure", failure)
    decided = marked.withColumn("decision", F.when(F.max(F.col("failure").isNotNull()).over(own), "ABORT").otherwise("COMMIT"))
    shown = decided.select(txn, place, kind, *key, "decision", "failure", "old")
    applied = decided.where((F.col("decision") == "COMMIT") & (F.col(kind) != "CHECK"))
    # At most one operation of a batch that commits addresses an item.
    changed = applied.select(*key, F.col(kind).alias("applied_kind"), *(F.col(c).alias(f"new_{c}") if c in operations.columns else F.lit(None).cast(items.schema[c].dataType).alias(f"new_{c}") for c in attributes))
    after = items.withColumn("was", F.lit(True)).join(changed, [*key], "full").where("applied_kind IS NULL OR applied_kind <> 'DELETE'")
    new = [F.when(F.col("applied_kind") == "PUT", F.col(f"new_{c}")).otherwise(F.coalesce(f"new_{c}", c)).alias(c) for c in attributes]
    return shown, after.select(*key, *new).select(*items.columns)


def transact_read(operations: DataFrame, items: DataFrame, key: Sequence[str], txn: str, place: str, size: Column) -> DataFrame:
    """Reads of transactions, with ``found`` and ``failure``: TooMany operations, or
    TooLarge if a transaction's items have more than 4 MiB."""
    own = Window.partitionBy(txn)
    read = operations.join(items.withColumn("found", F.lit(True)), [*key], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    read = read.withColumn("bytes", F.when(F.col("found"), size).otherwise(0))
    failure = F.when(F.count("*").over(own) > MOST_OPERATIONS, "TooMany").when(F.sum("bytes").over(own) > MOST_BYTES, "TooLarge")
    return read.withColumn("failure", failure).drop("bytes")
