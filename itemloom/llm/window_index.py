"""Substring dedup with a log-structured index of window fingerprints.

A window is ``SPAN`` words in a row. Of each window's word grams the one with the
smallest hash is its anchor; equal windows have equal anchors, and neighbouring
windows mostly share one. The index keeps, for the documents added so far,
immutable runs of (anchor hash, document), sorted by hash, one per batch. A new
batch's anchors are merge-joined with every run; documents that share an anchor,
old or new, give the hashes of the windows on these anchors, and the rows of
each window hash, sorted with older documents first, show which windows of the
batch occur earlier. A match counts only if a second, independent hash agrees.
After ``FANOUT`` runs they are compacted into one.

Each word that such a window covers is removed. A window that began earlier in
its own document counts as earlier, too. Batches must be added in the order that
decides which of two equal windows stays; within a batch smaller keys come
first. Windows are judged on the input, not on what is left.

Rows with the same key are one document: each loses what an earlier document
holds, and none loses words to another. Rows without a key are only compared
with themselves. Null and empty texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itemloom.llm.shared import discard, keep_shared, scratch_path, settle, shuffle_width
from itemloom.llm.words import Words, blocks, mixed

SPAN = 20
#: Words of an anchor gram.
GRAM = 6
#: Runs that are compacted into one.
FANOUT = 3


def _grams(hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hashes of ``size`` words in a row: polynomials of the words' hashes, built by
    doubling, then scrambled."""
    if len(hashes) < size:
        return hashes[:0]
    base = 0x9E3779B97F4A7C15 + 2 * seed
    width, out = 1, hashes
    while width < size:
        step = min(width, size - width)
        # Where the halves overlap, one of them is scrambled, so that no word cancels.
        out = out[:-step] * np.uint64(pow(base, step, 1 << 64)) + (out[step:] if step == width else mixed(out[step:]))
        width += step
    return mixed(out)


def anchored(hashes: np.ndarray) -> np.ndarray:
    """The anchor of each window: the least hash of its grams."""
    grams = _grams(hashes, GRAM, 5)
    reach = SPAN - GRAM + 1
    if len(grams) < reach:
        return grams[:0]
    width, least = 1, grams
    while width < reach:
        step = min(width, reach - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    return least


def windows(hashes: np.ndarray) -> np.ndarray:
    return _grams(hashes, SPAN, 17)


def checks(hashes: np.ndarray) -> np.ndarray:
    """A second hash of each window that doesn't depend on the first: the sum of its
    words' hashes, scrambled."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes + np.uint64(71)))])
    return mixed(sums[SPAN:] - sums[:-SPAN])


class _Windows:
    """The windows of a block's texts: the ``text`` and the ``place`` in it, the
    hash ``one`` and the ``anchor`` of each."""

    def __init__(self, words: Words):
        self.words, hashes, bounds = words, words.hashes, words.texts
        of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.at = np.flatnonzero(of[: max(0, len(of) - SPAN + 1)] == of[SPAN - 1 :])
        self.text = of[self.at]
        self.place = self.at - bounds[self.text]
        self.one, self.anchor = windows(hashes)[self.at], anchored(hashes)[self.at]

    def stretches(self) -> np.ndarray:
        """Where the anchor or the text changes."""
        new = np.ones(len(self.at), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.text[1:] != self.text[:-1])
        return np.flatnonzero(new)

    def repeats(self) -> np.ndarray:
        """Whether a window begins earlier in its own text, too."""
        order = np.argsort(self.one, kind="stable")
        out = np.zeros(len(order), bool)
        out[order[1:]] = (self.one[order[1:]] == self.one[order[:-1]]) & (self.text[order[1:]] == self.text[order[:-1]])
        return out


def _source(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))


def _anchors(source: DataFrame) -> DataFrame:
    """(key, text_hash, anchors: distinct hashes) of documents with windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in blocks(batches):
            found = _Windows(words)
            at = found.stretches()
            text, anchor = found.text[at], found.anchor[at]
            order = np.lexsort((anchor, text))
            text, anchor = text[order], anchor[order]
            new = np.ones(len(at), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
            count = np.bincount(text[new], minlength=batch.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), anchor[new].view(np.int64))
            rows = pa.RecordBatch.from_pydict({"key": batch.column("key"), "text_hash": batch.column("text_hash"), "anchors": lists})
            yield rows.filter(pa.array(count > 0))

    return source.select("key", "body", F.xxhash64("body").alias("text_hash")).mapInArrow(run, "key long, text_hash long, anchors array<long>")


def _told_apart(source: DataFrame, several: DataFrame | None) -> DataFrame:
    """``source`` with ``twin``: 0, or the text's hash if the key has ``several`` texts."""
    if several is None:
        return source.withColumn("twin", F.lit(0).cast("long"))
    return source.join(several, "key", "left").withColumn("twin", F.when(F.col("several"), F.xxhash64("body")).otherwise(F.lit(0).cast("long"))).drop("several")


def _windows(rows: DataFrame) -> DataFrame:
    """(sign, age, key, twin, info) of the first place of each distinct window of a
    document that stands on one of its ``anchors``; ``info`` has the second
    hash's upper half and the place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in blocks(batches):
            found, two = _Windows(words), checks(words.hashes)
            at = found.stretches()
            wanted = batch.column("anchors")
            # Other anchors of equal hash would only add rows.
            named = lambda anchor, text: mixed(anchor + mixed(text.astype(np.uint64)))
            of = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
            good = np.isin(named(found.anchor[at], found.text[at]), named(wanted.flatten().to_numpy().view(np.uint64), of))
            good = np.repeat(good, np.diff(np.append(at, len(found.at)))) & ~found.repeats()
            rows, place = found.text[good], found.place[good]
            yield pa.RecordBatch.from_pydict({
                "sign": found.one[good].view(np.int64), "age": batch.column("age").to_numpy()[rows],
                "key": batch.column("key").to_numpy()[rows], "twin": batch.column("twin").to_numpy()[rows],
                "info": ((two[found.at[good]] & np.uint64(0xFFFFFFFF00000000)) | place.astype(np.uint64)).view(np.int64),
            })

    return rows.mapInArrow(run, "sign long, age int, key long, twin long, info long")


def _repeated(rows: DataFrame) -> DataFrame:
    """(key, twin, places) of the rows of new documents that another document's
    row of the same window precedes, by age and key.

    Rows are sorted over ranges, so a window that very many documents hold is
    spread over tasks; only the rows of a range's first document need another
    range, and are settled by a table of a row per range.
    """
    order = ("sign", F.shiftright("info", 32), "age", "key")
    ordered = rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None

        def part_of(kind: int, sign: np.ndarray, age: np.ndarray, key: np.ndarray, twin: np.ndarray, info: np.ndarray) -> pa.RecordBatch:
            n = len(sign)
            return pa.RecordBatch.from_pydict({"key": key, "twin": twin, "place": info & 0xFFFFFFFF, "kind": np.full(n, kind, np.int32), "part": np.full(n, part, np.int32), "sign": sign, "check": info >> 32, "age": age})

        def settled(key: np.ndarray, twin: np.ndarray, info: np.ndarray) -> pa.RecordBatch:
            n = len(key)
            nothing = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_pydict({"key": key, "twin": twin, "place": info & 0xFFFFFFFF, "kind": np.zeros(n, np.int32), "part": np.full(n, part, np.int32), "sign": nothing, "check": nothing, "age": pa.nulls(n, pa.int32())})

        # The first row of the range, and the one of the window at hand.
        head = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in ("sign", "age", "key", "twin", "info")]
            if last is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(last, columns, strict=True)]
            sign, age, key, twin, info = columns
            check = info >> 32
            again = np.zeros(len(sign), bool)
            again[1:] = (sign[1:] == sign[:-1]) & (check[1:] == check[:-1])
            lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(sign))))
            fresh = np.ones(len(sign), bool)
            fresh[0] = last is None
            if head is None:
                head = tuple(int(c[0]) for c in (sign, check, age, key))
            later = (age != age[lead]) | (key != key[lead])
            hit = later & (age > 0)
            yield settled(key[hit], twin[hit], info[hit])
            open_ = fresh & (sign == head[0]) & (check == head[1]) & (age == head[2]) & (key == head[3]) & (age > 0)
            if open_.any():
                yield part_of(1, *(c[open_] for c in columns))
            at = int(lead[-1])
            last = [c[at : at + 1] for c in columns]
        if last is not None:
            yield part_of(2, *last)

    found = settle(ordered.mapInArrow(run, "key long, twin long, place long, kind int, part int, sign long, check long, age int"), "repeated")
    ends = found.where("kind = 2").select("sign", "check", F.col("part").alias("before"), F.col("age").alias("before_age"), F.col("key").alias("before_key"))
    first = found.where("kind = 1").join(F.broadcast(ends), ["sign", "check"]).where("before < part AND (before_age <> age OR before_key <> key)").select("key", "twin", "place").distinct()
    places = found.where("kind = 0").select("key", "twin", "place").unionByName(first).groupBy("key", "twin").agg(F.collect_set("place").alias("places"))
    out = settle(places, "places")
    discard(found)
    return out


def _kept(rows: DataFrame) -> DataFrame:
    """(key, n_words, n_removed, kept: the words that stay, joined by spaces)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in blocks(batches):
            found = _Windows(words)
            places, first = batch.column("places"), words.texts[:-1]
            count = np.diff(places.offsets.to_numpy()) * places.is_valid().to_numpy(zero_copy_only=False)
            at = np.concatenate([found.at[found.repeats()], places.drop_null().flatten().to_numpy() + np.repeat(first, count)])
            edges = np.zeros(len(words.hashes) + 1, np.int64)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + SPAN, -1)
            gone = np.cumsum(edges[:-1]) > 0
            sums = np.concatenate([[0], np.cumsum(gone)])[words.texts]
            total, removed, kept = np.diff(words.texts), np.diff(sums), []
            for body, some, low, high in zip(batch.column("body").to_pylist(), removed.tolist(), words.texts[:-1].tolist(), words.texts[1:].tolist(), strict=True):
                own = body.encode("utf-8", "surrogatepass").split()
                kept.append(b" ".join(own if not some else [w for w, dead in zip(own, gone[low:high].tolist(), strict=True) if not dead]))
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "n_words": total, "n_removed": removed, "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return rows.select("key", "body", "places").mapInArrow(run, "key long, n_words long, n_removed long, kept string")


@dataclass
class WindowIndex:
    """Runs of the anchors of all documents added so far, and these documents."""

    spark: SparkSession
    runs: list[str] = field(default_factory=list)
    log: list[DataFrame] = field(default_factory=list)

    def _run(self, path: str) -> DataFrame:
        return self.spark.read.schema("sign long, key long").parquet(path)

    def _append(self, rows: DataFrame) -> None:
        path = scratch_path(self.spark, "run")
        rows.repartitionByRange(shuffle_width(self.spark), "sign", "key").sortWithinPartitions("sign", "key").write.parquet(path)
        self.runs.append(path)

    def compact(self) -> None:
        """Merge all runs into one; the old files stay until their folder goes."""
        old, self.runs = self.runs, []
        rows = self._run(old[0])
        for path in old[1:]:
            rows = rows.unionByName(self._run(path))
        self._append(rows)

    def add(self, documents: DataFrame, key: str = "doc_id", text: str = "text", last: bool = False) -> DataFrame:
        """(key, n_words, n_removed, kept) of a new batch, which is indexed unless
        it is the ``last`` one."""
        source = _source(documents, key, text)
        anchors = settle(_anchors(source), "anchors")
        texts = anchors.where("key IS NOT NULL").groupBy("key").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("top"))
        several = settle(texts.where("low <> top").select("key", F.lit(True).alias("several")), "several")
        own = _told_apart(source, None if several.isEmpty() else several)
        fresh = anchors.where("key IS NOT NULL").select(F.explode("anchors").alias("sign"), "key")
        together = fresh.withColumn("age", F.lit(1))
        signs = fresh.select("sign").distinct() if self.runs else None
        for path in self.runs:
            together = together.unionByName(self._run(path).hint("merge").join(signs, "sign", "left_semi").withColumn("age", F.lit(0)))
        kept = settle(keep_shared(together, "age"), "shared")
        shared = kept.groupBy("key", "age").agg(F.collect_list("sign").alias("anchors"))
        texts = own.withColumn("age", F.lit(1))
        for older in self.log:
            texts = texts.unionByName(_told_apart(older, None).withColumn("age", F.lit(0)))
        places = _repeated(_windows(texts.join(shared, ["key", "age"])))
        if not last:
            self._append(fresh)
            self.log.append(source)
            if len(self.runs) >= FANOUT:
                self.compact()
        discard(anchors, kept)
        return _kept(own.join(places, ["key", "twin"], "left"))


def deduplicate(documents: DataFrame, batches: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``documents`` to an empty index in ``batches`` ranges of ascending keys."""
    bounds = documents.select(F.col(key).cast("long").alias("key")).approxQuantile("key", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *sorted({int(b) for b in bounds}), None]
    index, out = WindowIndex(documents.sparkSession), None
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        own = documents
        if low is not None:
            own = own.where(F.col(key) >= low)
        if high is not None:
            own = own.where(F.col(key) < high)
        if low is None and high is not None:
            own = own.unionByName(documents.where(F.col(key).isNull()))
        done = index.add(own, key, text, last=i == len(edges) - 2)
        out = done if out is None else out.unionByName(done)
    return out.withColumnRenamed("key", key)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
f AS (SELECT doc_id, p, list(word) OVER ahead AS s FROM v WINDOW ahead AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
s AS (SELECT doc_id, p AS i, row_number() OVER (PARTITION BY array_to_string(s, ' ') ORDER BY doc_id, p) AS place FROM f WHERE len(s) = 20),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM s WHERE place > 1),
k AS (SELECT doc_id, p, word FROM v ANTI JOIN g USING (doc_id, p)),
t AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM k GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""
