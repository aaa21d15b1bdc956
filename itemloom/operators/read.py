"""Point reads, ordered queries, scans and pages."""

from __future__ import annotations

import operator
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from itemloom.functions import keys as K
from itemloom.functions.expressions import met
from itemloom.sources.items import Index, ItemTable


def get_item(items: DataFrame, table: ItemTable, key: dict[str, Any]) -> DataFrame:
    """The item with a complete key: no row or one. The filter reaches the scan."""
    if set(key) != set(table.keys):
        raise ValueError(f"{table.name}: a complete key has {table.keys}")
    for name, value in key.items():
        items = items.where(F.col(name) == F.lit(value))
    return items


def batch_get(items: DataFrame, table: ItemTable, wanted: DataFrame) -> DataFrame:
    """Items whose keys are in ``wanted``; keys without an item give no row."""
    return items.join(wanted.select(*table.keys).distinct(), [*table.keys], "left_semi")


def _ordered(columns: Sequence[str], forward: bool) -> list[Column]:
    return [F.col(c).asc() if forward else F.col(c).desc() for c in columns]


def after(columns: Sequence[str], start: dict[str, Any], forward: bool) -> Column:
    """Rows beyond ``start`` in the order of ``columns``. The bound of the first
    column stands alone, so that it reaches the scan."""
    strict, weak = (operator.gt, operator.ge) if forward else (operator.lt, operator.le)
    beyond = F.lit(False)
    for c in reversed(columns):
        beyond = strict(F.col(c), F.lit(start[c])) | ((F.col(c) == F.lit(start[c])) & beyond)
    first = columns[0]
    if len(columns) == 1:
        return strict(F.col(first), F.lit(start[first]))
    return weak(F.col(first), F.lit(start[first])) & beyond


def query(items: DataFrame, table: ItemTable, partition: dict[str, Any], condition: Column | None = None, forward: bool = True, limit: int | None = None, start: dict[str, Any] | None = None, index: Index | None = None) -> DataFrame:
    """Items of one partition in the order of their range keys; an index orders by
    its own range keys, then by the table's keys, and holds only items with all of them."""
    hash_keys, range_keys = (index.hash_keys, index.range_keys) if index else (table.hash_keys, table.range_keys)
    if set(partition) != set(hash_keys):
        raise ValueError(f"a query gives {hash_keys} by equality")
    for name, value in partition.items():
        items = items.where(F.col(name) == F.lit(value))
    if index:
        for name in index.keys:
            items = items.where(F.col(name).isNotNull())
    if condition is not None:
        items = items.where(condition)
    order = list(dict.fromkeys([*range_keys, *(table.keys if index else ())]))
    if start is not None:
        items = items.where(after(order, start, forward))
    items = items.orderBy(*_ordered(order, forward))
    return items if limit is None else items.limit(limit)


def paged(rows: DataFrame, order: Sequence[str], maximum: int, keep: Column | None = None, forward: bool = True, size: Column | None = None, budget: int = 1 << 20, cut_is_end: bool = True) -> DataFrame:
    """The first page of ``rows``: up to ``maximum`` evaluated rows in order and, given
    their ``size``, up to ``budget`` bytes, though one row at least. ``returned``
    marks the rows that ``keep`` lets pass; ``scanned`` is the number of evaluated
    ones and ``cursor`` the order's values of the last. The cursor is null if no row
    follows, as a query's; a scan's page that was cut by the maximum has one even
    then (not ``cut_is_end``)."""
    # One row more than a page tells whether there is another.
    first = rows.orderBy(*_ordered(order, forward)).limit(maximum + 1)
    running, page = Window.orderBy(*_ordered(order, forward)).rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    placed = first.withColumns({"place": F.row_number().over(running), "page_bytes": F.sum(F.lit(0) if size is None else size).over(running)})
    fits = (F.col("place") <= maximum) & ((F.col("place") == 1) | (F.col("page_bytes") <= budget))
    placed = placed.withColumns({"fits": fits, "scanned": F.max(F.when(fits, F.col("place"))).over(page).cast("long"), "seen": F.max("place").over(page)})
    more = F.col("seen") > F.col("scanned")
    if not cut_is_end:
        more = more | (F.col("scanned") == maximum)
    last = F.max(F.when(F.col("place") == F.col("scanned"), F.struct(*order))).over(page)
    return placed.withColumns({"cursor": F.when(more, last), "returned": met(keep) if keep is not None else F.lit(True)}).where("fits").drop("fits", "seen", "page_bytes")


def scan(items: DataFrame, table: ItemTable, limit: int | None = None, start: dict[str, Any] | None = None, part: int | None = None, total: int | None = None) -> DataFrame:
    """All items, or a segment's, in the order of their keys. A page is a top-k:
    each task keeps its own first rows."""
    if total is not None:
        key = F.concat_ws("|", *(F.col(k).cast("string") for k in table.keys))
        items = items.where(K.segment(key, total) == part)
    if start is not None:
        items = items.where(after(table.keys, start, True))
    return items if limit is None else items.orderBy(*table.keys).limit(limit)


def page(ordered: DataFrame, order: Sequence[Column], size: Column, budget: int, keep: Column | None = None) -> DataFrame:
    """The first page of rows by ``order``, already limited: rows up to the byte
    budget, of which the first always stays. ``returned`` says which of the
    evaluated rows the filter keeps."""
    running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = ordered.withColumn("place", F.row_number().over(running)).withColumn("page_bytes", F.sum(size).over(running))
    return counted.where((F.col("place") == 1) | (F.col("page_bytes") <= budget)).withColumn("returned", met(keep) if keep is not None else F.lit(True))


def all_pages(items: DataFrame, partition: Sequence[str], order: Sequence[str], size: str, budget: int) -> DataFrame:
    """(partition, order, size, page): pages of every partition, filled in order;
    each begins with the row that no longer fits. One partition's sizes pass
    through one task batch by batch, not its items."""
    slim = items.select(*partition, *order, F.col(size).cast("long").alias("row_bytes"))
    names = slim.columns
    laid = slim.repartition(*partition).sortWithinPartitions(*partition, *order)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number, used, empty = None, 0, 0, True
        for batch in batches:
            groups = pd.MultiIndex.from_arrays([batch.column(c).to_pandas() for c in partition]).to_flat_index() if batch.num_rows else []
            codes, _ = pd.factorize(pd.Series(groups, dtype=object)) if len(groups) else ([], [])
            total = np.concatenate([[0], np.cumsum(batch.column("row_bytes").to_numpy())])
            ends = np.flatnonzero(np.append(np.diff(codes) != 0, True)) + 1 if len(groups) else []
            pages, low = np.empty(batch.num_rows, np.int64), 0
            for end in ends:
                if groups[low] != last:
                    last, number, used, empty = groups[low], 0, 0, True
                while low < end:
                    # As many rows as still fit; an empty page takes one in any case.
                    upto = int(np.searchsorted(total, total[low] + budget - used, "right")) - 1
                    upto = min(max(upto, low + empty), end)
                    pages[low:upto] = number
                    used += int(total[upto] - total[low])
                    empty, low = empty and not pages[low:upto].size, upto
                    if low < end:
                        number, used, empty = number + 1, 0, True
            yield batch.append_column("page", pa.array(pages))

    return laid.mapInArrow(fill, ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in names) + ", page long")
