"""Exact comparison of candidate pairs of sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm.shared import discard, settle, slices
from itemloom.llm.words import mixed


def matched(pairs: DataFrame, sets: DataFrame, share: int, of: int) -> DataFrame:
    """The pairs (a, b) whose sets, given by (key, items: sorted array<long>),
    have a Jaccard similarity of ``share / of`` or more."""
    left, right = sets.select(F.col("key").alias("a"), F.col("items").alias("mine")), sets.select(F.col("key").alias("b"), F.col("items").alias("theirs"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "mine", "theirs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), "mine", 8_000_000):
                good = []
                for mine, theirs in zip(batch.column("mine"), batch.column("theirs"), strict=True):
                    x, y = mine.values.to_numpy(), theirs.values.to_numpy()
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(of * common >= share * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(pa.array(good, pa.bool_())) for c in ("a", "b")})

    return rows.mapInArrow(run, "a long, b long")


#: Nodes of a star of which its consensus is made.
GIVING = 64
#: Cells of the table of differences, of all stars together.
CELLS, BLOCK = 1 << 22, 1 << 16


def _differences(batch: pa.RecordBatch, cells: int) -> tuple[np.ndarray, ...]:
    """Of the differences (``theirs``) in a batch of star rows the row, the
    difference itself and its cell; and for each row where its differences end."""
    sizes = np.diff(batch.column("theirs").offsets.to_numpy()).astype(np.int64)
    row, items = np.repeat(np.arange(len(sizes)), sizes), batch.column("theirs").flatten().to_numpy()
    star = mixed(batch.column("reference").to_numpy().astype(np.uint64))
    return row, items, ((items.view(np.uint64) ^ star[row]) & np.uint64(cells - 1)).astype(np.int64), np.cumsum(sizes)


class Stars:
    """Pairs of nodes with a common reference that may be similar enough, without
    comparing all of them.

    ``stars`` has (reference, node, n: the node's size), the reference itself
    included. Each node stands for the shingles in which it differs from its
    star's consensus: the reference, changed where most nodes differ from it. Two
    nodes differ in the sum of their differences less twice the common ones. With
    the excess of a node, its differences less ``(of - share) / (of + share)`` of
    its size, nodes are similar if they have half the sum of their excesses in
    common, at least. Where this sum isn't positive, the star's node of least
    excess is similar to both (``leads``). Else they share a difference, and one
    of their rarest (``others``); differences of one node alone meet nothing, so
    copies that were edited each in its own way aren't compared.

    How rare a difference is tells a table of fixed size, before any gets a row of
    its own: only the rarest that another component may have do (``items``). Any
    number of ``cells`` (a power of two) is right; with few of them more rows are made.
    """

    def __init__(self, stars: DataFrame, sets: DataFrame, share: int, of: int, cells: int = CELLS):
        self.share, self.of, self.cells, self.items = share, of, cells, None
        left = sets.select(F.col("key").alias("reference"), F.col("items").alias("mine"))
        right = sets.select(F.col("key").alias("node"), F.col("items").alias("theirs"))
        apart = settle(self._apart(stars.join(left, "reference").join(right, "node").select("reference", "node", F.size("theirs").cast("long").alias("n"), "mine", "theirs")), "apart")
        # Any set will do for a consensus, so some nodes of a star give it: about ``GIVING``.
        members = apart.groupBy("reference").agg(F.count("*").alias("members"))
        giving = apart.join(members, "reference").where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) * F.col("members") < GIVING << 20)
        counts = giving.groupBy("reference").agg(F.count("*").alias("giving"))
        held = giving.select("reference", F.explode("theirs").alias("item")).groupBy("reference", "item").agg(F.count("*").alias("held"))
        # At most twice as many as a node differs in.
        common = held.join(counts, "reference").where(2 * F.col("held") > F.col("giving")).groupBy("reference").agg(F.collect_list("item").alias("mine"))
        rows = self._apart(apart.join(common, "reference", "left"))
        self.rows = settle(rows.withColumn("excess", F.size("theirs") * (of + share) - F.col("n") * (of - share)), "apart")
        discard(apart)

    def _ranks(self, placed: DataFrame) -> np.ndarray:
        """For each cell of differences 0 if one component has them all, else a number
        that grows with the number of nodes that have them. The cells are summed by
        Spark, in blocks of ``BLOCK``."""
        size, width = self.cells, min(self.cells, BLOCK)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(iter([whole]), "theirs", 8_000_000):
                    row, _, cells, _ = _differences(batch, size)
                    order = np.argsort(cells, kind="stable")
                    full, starts, counts = np.unique(cells[order], return_index=True, return_counts=True)
                    if not len(full):
                        continue
                    component = batch.column("component").to_numpy()[row[order]]
                    columns = {"cells": (full % width).astype(np.uint16), "counts": counts, "lows": np.minimum.reduceat(component, starts), "tops": np.maximum.reduceat(component, starts)}
                    edges = np.searchsorted(full, np.arange(0, size + 1, width))
                    parts = [i for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if low < high]
                    yield pa.RecordBatch.from_pydict({"block": pa.array(parts, pa.int64())} | {c: pa.array([x[edges[i] : edges[i + 1]].tobytes() for i in parts], pa.binary()) for c, x in columns.items()})

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, tuple[np.ndarray, ...]] = {}
            ends = np.iinfo(np.int64)
            for batch in batches:
                for block, cells, *more in zip(*(batch.column(c).to_pylist() for c in ("block", "cells", "counts", "lows", "tops")), strict=True):
                    at, (counts, lows, tops) = np.frombuffer(cells, np.uint16), (np.frombuffer(x, np.int64) for x in more)
                    count, low, top = found.setdefault(block, (np.zeros(width, np.int64), np.full(width, ends.max), np.full(width, ends.min)))
                    count[at] += counts
                    low[at], top[at] = np.minimum(low[at], lows), np.maximum(top[at], tops)
            ranks = [np.where(low < top, np.minimum(8 * np.log2(count + 1), 255), 0).astype(np.uint8).tobytes() for count, low, top in found.values()]
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(found), pa.int64()), "ranks": pa.array(ranks, pa.binary())})

        parts = placed.select("reference", "component", "theirs").mapInArrow(run, "block long, cells binary, counts binary, lows binary, tops binary").repartition("block")
        summed = settle(parts.mapInArrow(total, "block long, ranks binary"), "ranks")
        out = np.zeros((size // width, width), np.uint8)
        # A byte for each cell in all.
        for row in summed.toLocalIterator():
            out[row.block] = np.frombuffer(bytes(row.ranks), np.uint8)
        discard(summed)
        return out.reshape(-1)

    @staticmethod
    def _apart(rows: DataFrame) -> DataFrame:
        """(reference, node, n, theirs): what one of ``mine`` and ``theirs`` lacks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(iter([whole]), "theirs", 8_000_000):
                    apart = [np.setxor1d(np.asarray(x.values if x.is_valid else [], np.int64), np.asarray(y.values, np.int64)) for x, y in zip(batch.column("mine"), batch.column("theirs"), strict=True)]
                    yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("reference", "node", "n")} | {"theirs": pa.array(apart, pa.list_(pa.int64()))})

        return rows.select("reference", "node", "n", "mine", "theirs").mapInArrow(run, "reference long, node long, n long, theirs array<long>")

    def leads(self) -> DataFrame:
        """Pairs (a, b) of a star's node of least excess with those similar to it."""
        lead = self.rows.groupBy("reference").agg(F.min(F.struct("excess", "node")).alias("lead"))
        met = self.rows.join(lead, "reference").where((F.col("node") != F.col("lead.node")) & (F.col("excess") + F.col("lead.excess") <= 0))
        return met.select(F.col("lead.node").alias("a"), F.col("node").alias("b"))

    def others(self, named: DataFrame) -> DataFrame:
        """Pairs (a, b) of nodes with different components that have differences
        in common; ``named`` has (node, component)."""
        placed = self.rows.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
        # The least excess a node can meet is that of the other components. In a star of one
        # component there is none, and a node can't share more than all its differences.
        best = placed.groupBy("reference", "component").agg(F.min("excess").alias("excess"))
        first = best.groupBy("reference").agg(F.min(F.struct("excess", "component")).alias("first"))
        second = best.join(first, "reference").where(F.col("component") != F.col("first.component")).groupBy("reference").agg(F.first("first").alias("first"), F.min("excess").alias("second"))
        placed = placed.join(second, "reference").withColumn("least", F.when(F.col("component") == F.col("first.component"), F.col("second")).otherwise(F.col("first.excess")))
        placed = placed.withColumn("size", F.size("theirs").cast("long")).where(F.col("excess") + F.col("least") <= F.col("size") * (2 * (self.of + self.share)))
        # A node with several texts is one row for each.
        ranks, per = placed.sparkSession.sparkContext.broadcast(self._ranks(placed)), 2 * (self.of + self.share)
        size = self.cells

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(iter([whole]), "theirs", 8_000_000):
                    row, items, cells, ends = _differences(batch, size)
                    rank = ranks.value[cells]
                    order = np.lexsort((items, rank, row))
                    excess, least = batch.column("excess").to_numpy(), batch.column("least").to_numpy()
                    # The excess is in units of 1 / (of + share). The first common difference has
                    # as many others after it as are shared, and never the rank 0.
                    few, more = (np.maximum(-(-(excess + x) // per), 1)[row] for x in (np.maximum(excess, least), least))
                    left = ends[row] - np.arange(len(row))
                    at = np.flatnonzero((left >= more) & (rank[order] > 0))
                    found = batch.select(["reference", "node", "n", "excess", "component"]).take(pa.array(row[at]))
                    yield pa.RecordBatch.from_arrays([*found.columns, pa.array(items[order[at]]), pa.array(left[at]), pa.array(left[at] >= few[at])], [*found.schema.names, "item", "left", "few"])

        schema = "reference long, node long, n long, excess long, component long, item long, left long, few boolean"
        self.items = settle(placed.select("reference", "node", "n", F.col("excess").cast("long").alias("excess"), F.col("least").cast("long").alias("least"), "component", "theirs").mapInArrow(run, schema), "differences")
        # Cells hold several differences, so some of these are of one component.
        shared = self.items.groupBy("reference", "item").agg(F.min("component").alias("low"), F.max("component").alias("top")).where("low < top").select("reference", "item")
        ranked = self.items.join(shared, ["reference", "item"])
        few = ranked.where("few").select("reference", "item", F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("excess").alias("a_excess"), F.col("component").alias("a_component"), F.col("left").alias("a_left"))
        more = ranked.select(F.col("reference").alias("r"), F.col("item").alias("i"), F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("excess").alias("b_excess"), F.col("component").alias("b_component"), F.col("left").alias("b_left"))
        fits = (self.of * F.least("a_n", "b_n") >= self.share * F.greatest("a_n", "b_n")) & (F.col("a_component") != F.col("b_component")) & (F.col("a_excess") + F.col("b_excess") > 0)
        # Of the first common difference both have as many others left as they share.
        fits = fits & (F.least("a_left", "b_left") * (2 * (self.of + self.share)) >= F.col("a_excess") + F.col("b_excess"))
        met = few.join(more, (F.col("reference") == F.col("r")) & (F.col("item") == F.col("i")) & (F.struct("a_excess", "a") < F.struct("b_excess", "b")) & fits)
        return met.select("a", "b").distinct()
