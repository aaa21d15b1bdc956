"""Puts, updates, deletes and batches, each from one snapshot to the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.functions.expressions import Update, met


def put(items: DataFrame, new: DataFrame, key: Sequence[str], order: str | None = None) -> DataFrame:
    """``new`` replaces items of the same key as a whole. Of several rows of a key the
    one with the greatest ``order`` counts; without an order, equal rows are one and
    others an error when the rows are computed."""
    ranked = new.groupBy(*key).agg(F.max_by(F.struct(*new.columns), F.col(order)).alias("row") if order else _only(F.struct(*new.columns), key).alias("row")).select("row.*")
    return items.join(ranked.select(*key), [*key], "left_anti").unionByName(ranked, allowMissingColumns=True)


def _only(row: Column, key: Sequence[str]) -> Column:
    """A key's single row."""
    same = F.max(row).eqNullSafe(F.min(row))
    return F.when(same, F.max(row)).otherwise(F.raise_error(F.concat(F.lit("several puts of the key "), F.to_json(F.struct(*key)))))


def delete(items: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """Without the items of these keys; absent keys change nothing."""
    return items.join(keys.select(*key), [*key], "left_anti")


def batch_write(items: DataFrame, puts: DataFrame, deletes: DataFrame, key: Sequence[str]) -> DataFrame:
    """All puts and deletes of one batch, each of a key of its own: a key that is
    both put and deleted is an error when the rows are computed."""
    both = deletes.select(*key).distinct().withColumn("clash", F.lit(True))
    failed = F.raise_error(F.concat(F.lit("put and delete of the key "), F.to_json(F.struct(*key))))
    checked = puts.join(both, [*key], "left").where(F.when(F.col("clash"), failed.cast("boolean")).otherwise(True)).drop("clash")
    return put(delete(items, deletes, key), checked, key)


def outcomes(items: DataFrame, requests: DataFrame, key: Sequence[str], condition: Column) -> DataFrame:
    """Requests with ``outcome``: Applied or ConditionFailed. The condition sees the
    old item's attributes as ``old_``..., all absent if there is none."""
    old = items.select(*key, *(F.col(c).alias(f"old_{c}") for c in items.columns), F.lit(True).alias("old_present"))
    joined = requests.join(old, [*key], "left").withColumn("old_present", F.coalesce("old_present", F.lit(False)))
    return joined.withColumn("outcome", F.when(met(condition), "Applied").otherwise("ConditionFailed"))


def write(items: DataFrame, requests: DataFrame, key: Sequence[str], condition: Column | None = None, kind: str = "put", actions: Sequence[Update] = ()) -> tuple[DataFrame, DataFrame]:
    """Conditional writes of one kind (put, update or delete), a request for each key:
    (requests with ``outcome``, ``old`` and ``new``, items after them). Refused requests
    change nothing and show the old item; a delete of no item is applied, too. An
    update's actions may read the request's attributes as ``new_``..."""
    decided = outcomes(items, requests, key, condition if condition is not None else F.lit(True)).withColumn("applied", F.col("outcome") == "Applied")
    old = F.when(F.col("old_present"), F.struct(*(F.col(f"old_{c}").alias(c) for c in items.columns)))
    if kind == "put":
        made = {c: F.col(c) if c in requests.columns else F.lit(None) for c in items.columns}
    elif kind == "update":
        if changed := {a.name for a in actions} & set(key):
            raise ValueError(f"key attributes can't be updated: {sorted(changed)}")
        made = {c: F.col(c) if c in key else F.col(f"old_{c}") for c in items.columns} | {a.name: a.applied(F.col(f"old_{a.name}")) for a in actions}
    elif kind == "delete":
        made = None
    else:
        raise ValueError(f"unknown kind: {kind}")
    shape = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in items.schema)
    new = F.lit(None).cast(f"struct<{shape}>") if made is None else F.struct(*(made[c].cast(items.schema[c].dataType).alias(c) for c in items.columns))
    shown = decided.select(*key, "outcome", old.alias("old"), F.when(F.col("applied"), new).otherwise(old).alias("new"))
    kept = items.join(shown.where("outcome = 'Applied'").select(*key), [*key], "left_anti")
    return shown, kept.unionByName(shown.where("outcome = 'Applied' AND new IS NOT NULL").select("new.*"))


def update(items: DataFrame, targets: DataFrame, key: Sequence[str], actions: Sequence[Update]) -> DataFrame:
    """The actions on the items of these keys; a key without an item gets one with
    what the actions set. Every action reads the old item; keys stay as they are."""
    if changed := {a.name for a in actions} & set(key):
        raise ValueError(f"key attributes can't be updated: {sorted(changed)}")
    marked = items.join(targets.select(*key).distinct().withColumn("is_target", F.lit(True)), [*key], "full")
    new = {a.name: F.when(F.col("is_target"), a.applied(F.col(a.name))).otherwise(F.col(a.name)).cast(items.schema[a.name].dataType) for a in actions}
    return marked.withColumns(new).select(*items.columns)
